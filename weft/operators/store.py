"""Stored tables: rows to append, keyed reads and updates, jobs, and histograms. Each is a DataFrame to a DataFrame; what is written is the caller's choice of sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import text
from weft.operators import ingest
from weft.sources.files import sanitize

#: Seconds that a job is kept; queues of the workers; events that a chat's listeners get.
JOB_SECONDS = 86_000
QUEUES = {"crawl": "crawler", "process": "processor", "chunk": "chunker", "summary": "summary", "embed": "embedder"}
EVENTS = (
    "status_update", "progress_update", "new_message", "user_joined", "user_left", "typing", "users_list", "pong",
    "crawl_progress", "crawl_summary", "crawl_error", "error", "complete",
)
ROLES = ("user", "assistant", "system")


def row_id(*columns: Column) -> Column:
    """A stable identifier from natural keys, in place of a random one."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def select(df: DataFrame, **keys) -> DataFrame:
    """Rows with these values; a key of None does not restrict, a list is one of."""
    for name, value in keys.items():
        if value is not None:
            df = df.where(F.col(name).isin(value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return df


def update(df: DataFrame, where: Column, **values) -> DataFrame:
    """The table with new values where the condition holds."""
    holds = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(holds, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in values.items()})


def affected(df: DataFrame, where: Column) -> DataFrame:
    """One row: how many rows an update or a delete touches."""
    return df.agg(F.count_if(F.coalesce(where, F.lit(False))).alias("affected"))


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def touch(df: DataFrame, where: Column, now: Column, column: str = "updated_at") -> DataFrame:
    return update(df, where, **{column: now})


def reopen(urls: DataFrame) -> DataFrame:
    """Failed urls are processed again."""
    return update(urls, F.col("status") == "FAILED", status="PROCESSING", error_message=F.lit(None).cast("string"))


def mark_processed(urls: DataFrame, where: Column) -> DataFrame:
    return update(urls, where, status="COMPLETED")


def owned(df: DataFrame, row: Column, user: Column, user_col: str = "user_id", key: str = "id") -> DataFrame:
    """The row, if it is the user's."""
    return df.where((F.col(key) == row) & (F.col(user_col) == user))


def versions(crawled: DataFrame, now: Column) -> DataFrame:
    """(page_id, url, html, content_hash, response_size, created_at) of crawled pages: without control characters, hashed."""
    html = sanitize(F.coalesce("html", F.lit("")))
    return crawled.select(row_id(F.col("url"), now).alias("page_id"), "url", html.alias("html"), text.sha256(html).alias("content_hash"), F.octet_length(html).cast("long").alias("response_size"), now.alias("created_at"))


def raw_documents(made: DataFrame) -> DataFrame:
    """A document for each page version, waiting to be processed."""
    return made.select(row_id(F.col("page_id"), F.col("content_hash")).alias("document_id"), "page_id", "url", F.col("html").alias("raw_content"), F.lit("PENDING").alias("processing_status"))


def to_process(documents: DataFrame) -> DataFrame:
    """Documents that no run has taken: each is processed once."""
    return documents.where(F.coalesce("processing_status", F.lit("PENDING")) == "PENDING")


def pending_counts(documents: DataFrame, chat: str = "chat_id") -> DataFrame:
    """The counter of pending documents, derived instead of incremented."""
    return documents.groupBy(chat).agg(F.count_if(F.col("processing_status").isin("PENDING", "PROCESSING")).alias("pending_documents"))


def attach(chunks: DataFrame, document: Column, version: Column) -> DataFrame:
    return chunks.withColumns({"document_id": document, "page_version_id": version, "embedding_status": F.lit("PENDING")})


def without_summary(documents: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents that have no summary chunk yet."""
    done = chunks.where((F.col("chunk_index") == -1) & F.col("entity_type").eqNullSafe(F.lit("summary"))).select(key)
    return documents.join(done, key, "left_anti")


def summaries(documents: DataFrame, content: Column, key: str = "document_id") -> DataFrame:
    """Summary chunks, which stand before the others."""
    return documents.select(key, content.alias("content")).withColumns({"chunk_index": F.lit(-1), "entity_type": F.lit("summary"), "chunk_hash": text.sha256(F.col("content"))})


def not_summary(entity: Column) -> Column:
    """Everything but page summaries, nulls included."""
    return ~entity.eqNullSafe(F.lit("summary"))


def embedded_chunks(chunks: DataFrame, vector: str = "embedding") -> DataFrame:
    return chunks.where((F.col("embedding_status") == "COMPLETED") & F.col(vector).isNotNull())


def chunks_of_urls(chunks: DataFrame, urls: DataFrame) -> DataFrame:
    """Chunks with the state of the url that their document came from."""
    return chunks.join(urls.select("document_id", F.col("id").alias("url_id"), F.col("status").alias("url_status")), "document_id")


def chat_ready(urls: DataFrame, chunks: DataFrame, chat: str = "chat_id") -> DataFrame:
    """By chat: complete if all urls are, none is active or failed and no chunk is open."""
    of_urls = urls.groupBy(chat).agg(F.count(F.lit(1)).alias("urls"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    open_chunks = chunks.groupBy(chat).agg(F.count_if(F.col("embedding_status") != "COMPLETED").alias("open"))
    joined = of_urls.join(open_chunks, chat, "left").withColumn("open", F.coalesce("open", F.lit(0)))
    return joined.withColumn("ready", (F.col("urls") == F.col("completed")) & (F.col("open") == 0))


def media_assets(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """Images that are no decoration and tables of parsed pages as assets: kind, place, source or first lines."""
    image = lambda x: F.struct(F.lit("image").alias("kind"), x["src"].alias("source"), x["alt"].alias("caption"), x["heading"].alias("heading"))
    table = lambda x: F.struct(F.lit("table").alias("kind"), F.lit(None).cast("string").alias("source"), F.array_join(F.slice(x["row_texts"], 1, 10), "\n").alias("caption"), x["heading"].alias("heading"))
    assets = F.concat(F.transform(F.slice(F.filter("page.images", lambda x: ~x["is_decorative"]), 1, 20), image), F.transform("page.tables", table))
    return parsed.select(key, F.posexplode(assets).alias("place", "a")).select(key, "place", "a.*")


def chat_state(states: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Chat states, the changes winning; arrays, maps and structs are kept as JSON."""
    held = {f.name: F.to_json(f.name) for f in changes.schema if f.dataType.typeName() in ("array", "map", "struct")}
    return ingest.upsert(states, changes.withColumns(held).withColumn("updated_at", now), ["chat_id"], [F.col("updated_at")])


def enqueue(jobs: DataFrame, now: Column, seconds: int = JOB_SECONDS) -> DataFrame:
    """Jobs (job_id, kind, payload) as rows of the job log: queued, with the time they are kept until."""
    queue = F.create_map(*(F.lit(x) for kv in QUEUES.items() for x in kv))
    made = F.coalesce(F.try_element_at(queue, "kind"), F.raise_error(F.concat(F.lit("no queue for "), "kind")))
    return jobs.select("job_id", "kind", made.alias("queue"), "payload", F.lit("queued").alias("status"), now.alias("at"), (now + F.expr(f"INTERVAL {seconds} SECONDS")).alias("expires_at"))


def job_states(log: DataFrame, now: Column) -> DataFrame:
    """The last state of each job that has not expired: of each field the latest value that is not null."""
    live = log.where(F.col("expires_at") > now)
    fields = [c for c in log.columns if c not in ("job_id", "at")]
    return live.groupBy("job_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in fields), F.max("at").alias("at"))


def queue_lengths(states: DataFrame) -> DataFrame:
    return states.where("status = 'queued'").groupBy("queue").agg(F.count(F.lit(1)).alias("n"))


def presence(events: DataFrame, chat: str = "chat_id") -> DataFrame:
    """Users present in each chat by their last event."""
    last = ingest.latest(events.where(F.col("type").isin("user_joined", "user_left")).select(chat, "user_id", "type", "at"), [chat, "user_id"], [F.col("at")])
    return last.where("type = 'user_joined'").groupBy(chat).agg(F.array_sort(F.collect_set("user_id")).alias("users"))


def render_modes(fetches: DataFrame, url: str = "url") -> DataFrame:
    """How each site was last rendered: httpx, playwright or brightdata, by origin."""
    site = F.lower(F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1))
    known = fetches.where(F.col("mode").isin("httpx", "playwright", "brightdata")).select(site.alias("site"), "mode", "at")
    return ingest.latest(known, ["site"], [F.col("at")]).select("site", "mode")


def status_counts(urls: DataFrame, chat: str, status: str = "status") -> DataFrame:
    """Histogram of url states by chat, as columns."""
    one = lambda name: F.count_if(F.lower(status) == name).alias(name)
    return urls.groupBy(chat).agg(F.count(F.lit(1)).alias("total"), *(one(s) for s in ingest.STATUS_PRIORITY))


def crawl_event(urls: DataFrame, chat: str = "chat_id", status: str = "status") -> DataFrame:
    """The snapshot that listeners get while a chat is crawled: histogram, share done, and urls by time."""
    done, busy, total = (F.count_if(F.lower(status) == "completed"), F.count_if(F.lower(status) == "processing"), F.count(F.lit(1)))
    listed = F.array_sort(F.collect_list(F.struct("created_at", "url", status)))
    return urls.groupBy(chat).agg(F.lit("crawl_progress").alias("type"), total.alias("total"), done.alias("completed"), busy.alias("processing"), ingest.crawl_percent(done, busy, total).alias("percent"), listed.alias("urls"))


def category_map(rows: DataFrame, category: str, *keys: str) -> DataFrame:
    """Counts of each category as one map."""
    counted = rows.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(category, F.lit("unknown")), "n")))).alias("counts"))


def chunk_report(chunks: DataFrame) -> DataFrame:
    """Histograms of chunk type, entity and category, and the words in all, one row a value."""
    kinds = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("chunk_type", "entity_type", "chunk_category")))).alias("x")
    return chunks.select(kinds, "token_count").groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("words"))


def ordered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows in the order of columns; a name with ``-`` in front falls."""
    return rows.orderBy(*(F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order))


def relative_position(rows: DataFrame, group: str, place: str) -> DataFrame:
    """Each unit's place from 0 to 1 within its group; 0 where it stands alone."""
    most = rows.groupBy(group).agg(F.max(place).alias("__most"))
    return rows.join(most, group).withColumn("relative_position", F.when(F.col("__most") > 0, F.col(place) / F.col("__most")).otherwise(0.0)).drop("__most")


def message_error(content: Column, role: Column) -> Column:
    """Why a message is refused; null if it is not."""
    return F.when(F.trim(F.coalesce(content, F.lit(""))) == "", "content must not be empty").when(~F.coalesce(role.isin(*ROLES), F.lit(False)), "role must be user, assistant or system")


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"), F.lit(False))


def text_or_object(c: Column) -> Column:
    """JSON text as a map of strings; null where it is no object."""
    return F.from_json(c, "map<string,string>")


def is_event(kind: Column) -> Column:
    return kind.isin(*EVENTS)
