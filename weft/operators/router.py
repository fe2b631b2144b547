"""From a question to its evidence: structured answers over all rows, or hybrid retrieval with its gates; then the text that a model is asked with."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import scoring, urls
from weft.operators import collections, ingest, retrieval
from weft.plans import planner

LIMIT, PREVIEW = 10, 180
LEAST_CONFIDENCE, LEAST_TOP, KEYWORD_ONLY = 0.1, 0.1, 0.8


def scoped(chunks: DataFrame, entity: str | None = None, source_url: str | None = None) -> DataFrame:
    """Chunks that a search may return: embedded or not, not excluded, dense enough; of one entity and one page, if told.

    An entity may stand in the text, the section title or the heading path.
    """
    rows = chunks.where(scoring.retrievable(F.col("category"), F.col("information_density")))
    if entity:
        like = f"%{entity}%"
        rows = rows.where(F.col("content").ilike(like) | F.coalesce(F.col("section_title").ilike(like), F.lit(False)) | F.coalesce(F.array_join("heading_path", " ").ilike(like), F.lit(False)))
    return rows if source_url is None else rows.where(urls.strip_slashes(F.col("source_url")) == source_url.rstrip("/"))


def hybrid(chunks: DataFrame, vector: list[float], question: str, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(chunks, one row about them): both searches, fused where both find something, boosted, with the gate that holds for what was found.

    chunks: id, content, embedding, category, entity, ordinal. The second row
    has: strategy (fused, vector, keyword or none), lexical, top, gap,
    confidence, accepted. Chunks come back only where it accepts.
    """
    near = retrieval.vector_topk(chunks, vector, 3 * limit)
    terms = retrieval.query_terms(question)
    found = retrieval.keyword_topk(chunks, terms, 3 * limit) if terms else near.limit(0)
    rows = retrieval.fuse(near, found).join(chunks.drop("embedding"), "id")
    # at most 6 * limit rows from here on
    whole = Window.partitionBy()
    kind = F.when(F.count("vector_rank").over(whole) == 0, "keyword").when(F.count("keyword_rank").over(whole) == 0, "vector").otherwise("fused")
    rows = rows.withColumn("strategy", kind).withColumn("base", F.when(F.col("strategy") == "fused", F.col("rrf")).otherwise(F.col("similarity")))
    rows = rows.withColumn("adjusted", F.round(F.col("base") * scoring.boost(F.col("category"), F.col("entity")), 6))
    order = Window.orderBy(F.desc("adjusted"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"))
    rows = retrieval.promote(rows.withColumn("rank", F.row_number().over(order)), positional_kind(question), "ordinal", "rank")
    about = judge(rows)
    kept = rows.where(F.col("rank") <= limit).join(F.broadcast(about.where("accepted").select(F.lit(True).alias("__ok"))))
    return kept.drop("__ok", "base"), about


def positional_kind(question: str) -> str | None:
    """Whether the question asks for the first or the last content of a page."""
    hit = lambda p: re.search(p, question, re.I)
    return "first" if hit(planner.POSITION_FIRST) else "last" if hit(planner.POSITION_LAST) else None


def judge(rows: DataFrame) -> DataFrame:
    """The gate over ranked rows (strategy, adjusted, rank): one row, also for none."""
    score = lambda k: F.max(F.when(F.col("rank") == k, F.col("adjusted")))
    seen = rows.agg(F.max("strategy").alias("strategy"), score(1).alias("top"), score(2).alias("second"))
    top, gap = F.coalesce("top", F.lit(0.0)), F.round(F.coalesce("top", F.lit(0.0)) - F.coalesce("second", F.lit(0.0)), 6)
    kind = F.coalesce("strategy", F.lit("none"))
    fused_ok, vector_ok = top >= scoring.LEAST_FUSED, top >= scoring.LEAST_SIMILARITY
    sure = F.when(kind == "fused", F.when(fused_ok, scoring.fused_confidence(F.lit(True), top, gap)).otherwise(top)).when(kind == "vector", top).when(kind == "keyword", KEYWORD_ONLY).otherwise(0.0)
    accepted = F.when(kind == "fused", fused_ok).when(kind == "vector", vector_ok).otherwise(kind == "keyword")
    return seen.select(kind.alias("strategy"), kind.isin("fused", "keyword").alias("lexical"), top.alias("top"), gap.alias("gap"), sure.alias("confidence"), accepted.alias("accepted"))


def may_answer(about: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: whether an answer is written, from the gate's row and the chunks with anchors. Anchors have no score of their own."""
    scores = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(~F.col("is_anchor"), F.coalesce("adjusted", "similarity"))).alias("best"))
    enough = F.col("confidence") > LEAST_CONFIDENCE
    scored = (F.col("confidence") >= LEAST_CONFIDENCE) & (F.coalesce("best", F.lit(0.0)) >= LEAST_TOP)
    return about.join(scores).select((F.col("n") > 0).alias("any"), ((F.col("n") > 0) & F.when(F.col("lexical"), enough).otherwise(scored)).alias("answer"))


def count_of(chunks: DataFrame, pages: DataFrame, entity: str, source_url: str | None = None) -> DataFrame:
    """One row (entity, result): pages, or distinct contents of the entity; where there are none on a page, the size of its dominant collection."""
    if entity == "page":
        return pages.agg(F.lit("page").alias("entity"), F.count(F.lit(1)).alias("result"))
    own = chunks.where(F.col("entity") == entity).agg(F.countDistinct("content").alias("result"))
    if source_url is None:
        return own.select(F.lit(entity).alias("entity"), "result")
    here = chunks.where(urls.strip_slashes(F.col("source_url")) == source_url.rstrip("/"))
    kinds = ["chunk_type", "entity"]
    found = collections.dominant(here, kinds, "ordinal", collections.priority(F.col("chunk_type"), F.col("entity")))
    other = found.agg(F.coalesce(F.max("span"), F.lit(0)).alias("span"))
    falls = (F.col("result") == 0) & (F.col("span") > 0)
    return own.join(F.broadcast(other)).select(F.when(falls, "item").otherwise(F.lit(entity)).alias("entity"), F.when(falls, F.col("span")).otherwise(F.col("result")).alias("result"))


def listed(chunks: DataFrame, entity: str, terms: list[str] | None = None) -> DataFrame:
    """The first chunk of each content of an entity; of those that hold all terms, if there are terms."""
    rows = chunks.where(F.col("entity") == entity)
    if terms:
        rows = rows.where(retrieval.keyword_score(F.col("content"), terms).isNotNull())
    return ingest.first(rows, ["content"], [F.col("id")])


def structured(plan: planner.QueryPlan, chunks: DataFrame, pages: DataFrame, source_url: str | None = None) -> DataFrame:
    """Evidence of a plan about all rows: (id, content, result, operation). A plan with no such operation gives no row."""
    none = F.lit(None)
    out = lambda df, content, result, what: df.select(*([F.col("id").cast("string").alias("id")] if "id" in df.columns else [F.lit("structured").alias("id")]), content.alias("content"), result.cast("double").alias("result"), F.lit(what).alias("operation"))
    if plan.intent == "count":
        n = count_of(chunks, pages, plan.entity, source_url)
        said = F.concat(F.lit("Verified result: there are "), F.col("result").cast("string"), F.lit(" "), "entity", F.when(F.col("result") == 1, "").otherwise("s"), F.lit("."))
        return out(n, said, F.col("result"), "count")
    if plan.entity == "product" and plan.intent in ("filter", "sort", "aggregation"):
        priced = collections.priced(chunks.where("entity = 'product'"), "content", ["id"])
        if plan.intent == "aggregation":
            average = collections.price_average(priced).where("n > 0")
            return out(average, F.format_string("Verified average product price: %.2f across %d products.", "average_price", "n"), F.col("average_price"), "average")
        if condition := plan.filters.get("price") if plan.intent == "filter" else None:
            priced = collections.price_filter(priced, condition["operator"], float(condition["value"]))
        if plan.intent == "sort":
            priced = priced.orderBy(F.desc("price") if plan.sort_order == "desc" else F.asc("price"), "id")
        return out(priced, F.concat(F.lit("Name and price evidence:\n"), "content"), F.col("price"), plan.intent)
    if plan.intent in ("list", "exhaustive_search") and plan.entity != "content":
        term = re.search(r"\bmention(?:s|ing)?\s+(.+)$", plan.rewritten_query or "", re.I)
        return out(listed(chunks, plan.entity, retrieval.query_terms(term[1]) if term else None), F.col("content"), none, "list")
    return out(chunks.limit(0), F.col("content"), none, "unavailable")


def answer(question: str, vector: list[float] | None, chunks: DataFrame, pages: DataFrame, source_url: str | None = None, entity: str | None = None) -> DataFrame:
    """Evidence (id, content, result, operation) for a question: by its plan where that is about all rows and finds something, else by retrieval in the chunks of the entity and page."""
    plan = planner.analyze_with_retry(question)
    if plan.structured_search:
        found = structured(plan, chunks, pages, source_url)
        if vector is None or not found.isEmpty():
            return found
    if vector is None:
        raise ValueError("retrieval needs the question's vector")
    rows, _ = hybrid(scoped(chunks, entity, source_url), vector, question)
    return rows.orderBy("rank").select(F.col("id").cast("string").alias("id"), "content", F.col("adjusted").alias("result"), F.lit("retrieval").alias("operation"))


def topic(source_url: Column, entity: Column) -> Column:
    about = F.concat(F.lit("\n(The user has been asking about: "), source_url, F.coalesce(F.concat(F.lit(" — entity: "), entity), F.lit("")), F.lit(".)\n"))
    return F.coalesce(about, F.lit(""))


def context(chunks: DataFrame, order: list, content: str = "content") -> DataFrame:
    """One row: the texts of a result that are not blank, in order, ruled apart."""
    rows = chunks.withColumn("__n", F.row_number().over(Window.orderBy(*order))).where(F.trim(content) != "")
    parts = F.array_sort(F.collect_list(F.struct("__n", F.trim(content).alias("t"))))
    return rows.agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n---\n\n").alias("context"))


def prompt_body(question: Column, told: Column, about: Column, ranked: Column | None = None) -> Column:
    """What a model gets beside its instructions: a ranked list first, where there is one, then topic, context and question."""
    head = F.concat(F.lit("The ranked list below is the answer key.\n\n"), ranked, F.lit("\n")) if ranked is not None else F.lit(None).cast("string")
    return F.concat(F.coalesce(head, F.lit("")), about, F.lit("\n"), told, F.lit("\n\nThe user asked: "), question)


def clarification(top: Column, source: Column, active_url: Column, active_entity: Column) -> Column:
    """What is said instead of an answer: without a chunk what the page is about, else the start of the best one."""
    nothing = F.concat(F.lit("I couldn't find anything about that in "), F.coalesce(active_url, F.lit("the site")), F.lit(". The page covers "), F.coalesce(active_entity, F.lit("content")), F.lit("-related content. Try rephrasing, or ask about a specific item on the page."))
    preview = F.substring(F.replace(F.trim(top), F.lit("\n"), F.lit(" ")), 1, PREVIEW)
    closest = F.concat(F.lit('I\'m not fully sure what you meant. The closest thing I found is:\n\n"'), preview, F.lit('…"\n\nfrom '), F.coalesce(source, active_url, F.lit("the page")), F.lit(". Did you mean to ask something about that?"))
    return F.when(top.isNull(), nothing).otherwise(closest)
