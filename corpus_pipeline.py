"""A corpus pipeline of five stages, each by one operator of ``weft.llm``.

Language identification drops documents whose language it cannot tell, SimHash
keeps one document of each near-duplicate group, decontamination drops
documents with benchmark passages, mixing repeats or drops documents to its
sources' target sizes, and the rest is written as token records.

A null text, or one without a letter, has no language and is dropped by the first
stage. Rows with a null id or source go through like any other; of rows that
repeat a text one stays. Columns of any name pass unchanged. Empty tables give
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import decontaminate, language_id, mixing, simhash, token_output
from weft.llm.common import crc_fold, scratch_path, table, unused

#: Least mean posterior of a document's language.
LEAST_SCORE = 0.3
#: Near-duplicates: shingles of five words; fingerprints of up to so many different bits, cut into so many blocks.
SHINGLE, MAX_DISTANCE, BLOCKS = 5, 6, 9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sample = language_id.training_sample(docs, crc_fold(F.col("doc_id"), 5) != 0, "text", "lang", F.col("doc_id"))
    lang, score = unused(docs, "__lang", "__score")
    found = language_id.identify(docs, language_id.train(sample), lang_out=lang, score_out=score)
    return found.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words=SHINGLE, max_distance=MAX_DISTANCE, blocks=BLOCKS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items, edits = unused(docs, "__items", "__edits")
    marked = decontaminate.mark_leaks(docs, table(spark, sf_dir, "benchmark"), items_out=items, edits_out=edits)
    return marked.where(F.size(items) == 0).drop(items, edits)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document taken k times stands in k rows."""
    return mixing.repeat_taken(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.token_output(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("mix", mix), ("tokens", tokens)]

#: SQL has no tokenizer, forward-backward or balanced draw: tests hold each stage's decisions against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
