"""Hybrid retrieval: vector and keyword candidates, fusion, boosts, promotion, gates and anchors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import scoring, text

#: Words that a keyword search leaves out.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from has have if in into is it its no not of on or such that the their then there these they this to was were will with what which who how when where why do does".split()
)


def query_terms(question: str) -> list[str]:
    """Distinct lower-cased words of a question that are no stop words."""
    return list(dict.fromkeys(w for w in re.findall(r"\w+", question.lower()) if w not in STOP_WORDS))


def candidates(chunks: DataFrame, score: Column, k: int, tie: str) -> DataFrame:
    """The k best rows by score, rounded to six places, and then by id; unscored rows are out."""
    scored = chunks.withColumn("similarity", F.round(score, 6)).where("similarity is not null")
    return scored.orderBy(F.desc("similarity"), tie).limit(k)


def vector_topk(chunks: DataFrame, query: list[float], k: int = 30, vector: str = "embedding", tie: str = "id", arrow: bool = False) -> DataFrame:
    similarity = scoring.cosine_arrow(query)(F.col(vector)) if arrow else scoring.cosine(F.col(vector), query)
    return candidates(chunks, similarity, k, tie)


def keyword_score(c: Column, terms: list[str]) -> Column:
    """Occurrences of the terms, null unless all of them occur."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(f"({text.WORD})"), F.lit(1))
    wanted = F.array(*map(F.lit, terms))
    hits = F.filter(tokens, lambda t: F.array_contains(wanted, t))
    return F.when(F.size(F.array_distinct(hits)) == len(terms), F.size(hits).cast("double"))


def keyword_topk(chunks: DataFrame, terms: list[str], k: int = 30, content: str = "content", tie: str = "id") -> DataFrame:
    """A row must hold every term; a plain substring test comes first and is cheap."""
    rows = chunks
    for t in terms:
        rows = rows.where(F.lower(F.col(content)).contains(t))
    return candidates(rows, keyword_score(F.col(content), terms), k, tie)


def _same(term: str):
    return lambda w: w == term


def bm25(docs: DataFrame, terms: list[str], key: str, content: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of rows with any of the terms, by Robertson and Zaragoza's formula. Counts and lengths are summed on executors."""
    tokens = docs.select(F.col(key).alias("k"), F.regexp_extract_all(F.lower(F.col(content)), F.lit(f"({text.WORD})"), F.lit(1)).alias("w"))
    counted = tokens.select("k", F.size("w").alias("n"), *(F.size(F.filter("w", _same(t))).alias(f"t{i}") for i, t in enumerate(terms)))
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log1p((F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        tf = F.col(f"t{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    hit = F.greatest(*(F.col(f"t{i}") for i in range(len(terms))), F.lit(0)) > 0
    return counted.where(hit).join(F.broadcast(stats)).select(F.col("k").alias(key), score.alias("score"))  # stats: one row


def ranked(top: DataFrame, name: str, tie: str) -> DataFrame:
    """``name``: the rank in a candidate list, which is short."""
    return top.withColumn(name, F.row_number().over(Window.orderBy(F.desc("similarity"), tie)))


def fuse(vector: DataFrame, keyword: DataFrame, key: str = "id") -> DataFrame:
    """Both candidate lists in one, with their ranks and the fused score; full outer on the key."""
    v = ranked(vector, "vector_rank", key).select(key, "vector_rank", F.col("similarity").alias("vector_similarity"))
    k = ranked(keyword, "keyword_rank", key).select(key, "keyword_rank", F.col("similarity").alias("keyword_score"))
    both = v.join(k, key, "full_outer")
    return both.withColumns({"rrf": scoring.rrf(F.col("vector_rank"), F.col("keyword_rank")), "similarity": F.greatest("vector_similarity", "keyword_score")})


def rerank(rows: DataFrame, score: str, category: Column, entity: Column, k: int, tie: list) -> DataFrame:
    """Boosted, sorted and cut to k; ``tie`` keeps the earlier order among equals."""
    return rows.withColumn("adjusted", F.round(F.col(score) * scoring.boost(category, entity), 6)).orderBy(F.desc("adjusted"), *tie).limit(k)


def promote(rows: DataFrame, kind: str | None, position: str, rank: str) -> DataFrame:
    """The content row with the least (``first``) or greatest (``last``) position goes in front."""
    if kind not in ("first", "last"):
        return rows.withColumn("promoted", F.lit(False))
    pick = (F.min if kind == "first" else F.max)(F.struct(position, F.col(rank) * (1 if kind == "first" else -1))).over(Window.partitionBy())
    chosen = F.struct(position, F.col(rank) * (1 if kind == "first" else -1)) == pick
    return rows.withColumn("promoted", chosen).withColumn(rank, F.row_number().over(Window.orderBy(F.desc("promoted"), rank)))


def gate(fused: DataFrame) -> DataFrame:
    """One row: top score, gap to the second, whether anything was lexical, accepted, confidence."""
    order = Window.orderBy(F.desc("adjusted"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"))
    tops = fused.withColumn("r", F.row_number().over(order)).agg(
        F.max(F.when(F.col("r") == 1, F.col("adjusted"))).alias("top"), F.max(F.when(F.col("r") == 2, F.col("adjusted"))).alias("second"), F.coalesce(F.bool_or(F.col("keyword_rank").isNotNull()), F.lit(False)).alias("lexical")
    )
    gap = F.round(F.col("top") - F.coalesce(F.col("second"), F.lit(0.0)), 6)
    accepted = F.coalesce(F.col("top") >= scoring.LEAST_FUSED, F.lit(False))
    return tops.select("top", gap.alias("gap"), "lexical", accepted.alias("accepted"), F.when(accepted, scoring.fused_confidence(F.col("lexical"), F.col("top"), gap)).otherwise(0.0).alias("confidence"))


def anchors(chunks: DataFrame, result: DataFrame, wanted: Column, order: list, key: str = "id", most: int = 3) -> DataFrame:
    """Up to ``most`` anchor rows that the result lacks, in front of it; ``place`` gives the order."""
    first = chunks.where(wanted).orderBy(*order).limit(most)
    new = first.join(result.select(key), key, "left_anti").withColumn("is_anchor", F.lit(True))
    return new.unionByName(result.withColumn("is_anchor", F.lit(False)), allowMissingColumns=True)


def vector_stats(chunks: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows and dimension of the stored vectors."""
    return chunks.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("dimension")).agg(F.count(F.lit(1)).alias("n"))
