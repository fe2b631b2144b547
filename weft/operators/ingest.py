"""Writes as table rebuilds: latest-wins upsert, insert-ignore, cascades, state machines and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Url states by priority, stages with their share of the progress.
STATUS_PRIORITY = ("completed", "processing", "pending", "failed")
STAGES = {"crawling": (5, 30), "processing": (30, 60), "chunking": (60, 80), "embedding": (80, 100)}
TERMINAL = ("completed", "answered", "failed")
FAILED_CHUNKS = 3


def _pick(rows: DataFrame, keys: list[str], order: list[Column], last: bool) -> DataFrame:
    """One row for each key by an aggregate that combines before it shuffles."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    best = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order))))
    return rows.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*").select(*rows.columns)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key with the greatest ``order`` (columns, compared in turn)."""
    return _pick(rows, keys, order, True)


def first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key with the least ``order``."""
    return _pick(rows, keys, order, False)


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Both together, one row for each key: a new one before an old one, then the greatest ``order``."""
    both = target.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.col("__new"), *order]).drop("__new")


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows to append: those that the target lacks, the first of each key."""
    return first(rows.join(target.select(*keys), keys, "left_anti"), keys, order)


def insert_counts(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many of the rows insert_ignore inserts and how many it skips."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    new = rows.join(target.select(*keys), keys, "left_anti").select(*keys).distinct().agg(F.count(F.lit(1)).alias("inserted"))
    return total.join(new).select("inserted", (F.col("total") - F.col("inserted")).alias("skipped"))  # one row each


def cascade_delete(parents: DataFrame, children: dict[str, DataFrame], doomed: DataFrame, key: str, foreign: str) -> dict[str, DataFrame]:
    """Parents and children without those of the doomed keys."""
    gone = doomed.select(F.col(key).alias("__gone")).distinct()
    out = {"": parents.join(gone, parents[key] == gone["__gone"], "left_anti")}
    return out | {name: t.join(gone, t[foreign] == gone["__gone"], "left_anti") for name, t in children.items()}


def merge_metadata(old: Column, new: Column) -> Column:
    """Map update: new keys win."""
    return F.map_concat(F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def next_status(status: Column, result: Column, stale: Column) -> Column:
    """Embedding state: failed and stale ones start again, running ones take their result."""
    return F.when((status == "FAILED") | ((status == "PROCESSING") & stale), "PENDING").when(status == "PENDING", "PROCESSING").when((status == "PROCESSING") & result.isNotNull(), F.when(result, "COMPLETED").otherwise("FAILED")).otherwise(status)


def readiness(chunks: DataFrame, document: str, status: str) -> DataFrame:
    """By document: counts, ready (some chunks, all complete), failed (FAILED_CHUNKS or more failed), warning (failed but some complete)."""
    c = F.col(status)
    counts = chunks.groupBy(document).agg(F.count(F.lit(1)).alias("total"), F.count_if(c == "COMPLETED").alias("completed"), F.count_if(c == "FAILED").alias("failed"))
    return counts.withColumns({"ready": (F.col("total") > 0) & (F.col("total") == F.col("completed")), "is_failed": F.col("failed") >= FAILED_CHUNKS, "warning": (F.col("failed") >= FAILED_CHUNKS) & (F.col("completed") > 0)})


def rechunk(chunks: DataFrame, document: str, status: str) -> DataFrame:
    """What to do with a document's chunks: keep, embed the rest, or chunk anew."""
    r = readiness(chunks, document, status)
    return r.select(document, F.when(F.col("ready"), "keep").when(F.col("completed") > 0, "embed").otherwise("rechunk").alias("action"))


def stage_progress(stage: Column, percent: Column) -> Column:
    """Overall progress of a stage's own percentage."""
    out = F.lit(None).cast("int")
    for name, (low, high) in STAGES.items():
        out = F.when(stage == name, low + F.floor(F.greatest(F.least(percent, F.lit(100)), F.lit(0)) / 100.0 * (high - low))).otherwise(out)
    return out.cast("int")


def stage_number(stage: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in (*STAGES, "completed", "answered"))), stage)


def crawl_percent(completed: Column, processing: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.round((completed + 0.5 * processing) / total * 95), F.lit(95.0))).otherwise(F.lit(0.0)).cast("int")


def status_rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATUS_PRIORITY)), status)


def friendly(status: Column) -> Column:
    """(message, is_ready, is_processing, is_failed) of a chat's state."""
    said = {"pending": "Waiting to start", "crawling": "Crawling pages", "processing": "Processing pages", "chunking": "Splitting content", "embedding": "Indexing content", "completed": "Ready", "answered": "Ready", "failed": "Failed"}
    message = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in said.items() for x in kv)), status), F.lit("Unknown"))
    return F.struct(message.alias("message"), status.isin("completed", "answered").alias("is_ready"), status.isin("pending", *STAGES).alias("is_processing"), (status == "failed").alias("is_failed"))


def clamp_update(progress: Column, step: Column, error: Column) -> Column:
    return F.struct(F.greatest(F.least(progress, F.lit(100)), F.lit(0)).alias("progress"), F.left(step, F.lit(200)).alias("step"), F.left(error, F.lit(500)).alias("error"))


def monotone(events: DataFrame, key: str, stage: Column, progress: str, order: list) -> DataFrame:
    """Events with the largest (stage, progress) before them, and whether each is shown: it is not behind, or it failed, and after completed or answered only those are."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.array_position(F.array(*(F.lit(s) for s in ("pending", *STAGES))), stage), F.lit(0)) - 1
    ended = stage.isin("completed", "answered")
    point = F.struct(F.when(stage.isin(*TERMINAL), F.lit(5)).otherwise(place).cast("int").alias("stage_no"), F.coalesce(F.col(progress), F.lit(0)).alias("progress"))
    best, over = F.max(point).over(before), F.coalesce(F.bool_or(ended).over(before), F.lit(False))
    shown = (~over | ended) & ((stage == "failed") | F.coalesce(point >= best, F.lit(True)))
    return events.withColumns({"best": best, "passes": shown})
