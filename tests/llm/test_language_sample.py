"""Languages with only long labelled texts are sampled as well."""

from pyspark.sql import functions as F

from weft.llm import language_id


def test_long_texts_are_cut_not_dropped(spark):
    long = "palabra " * 4000
    docs = spark.createDataFrame([(1, "short words", "en"), (2, long, "es"), (3, None, "fr")], "doc_id long, text string, lang string")
    got = language_id.training_sample(docs, F.lit(True), "text", "lang", F.col("doc_id"))
    assert sorted(got) == [("en", "short words"), ("es", long[: language_id.TRAIN_CHARS])]
