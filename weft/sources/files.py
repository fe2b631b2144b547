"""Saved pages in, chunks and retrieval logs out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import text


@F.pandas_udf(T.StringType())
def _decoded(raw: pd.Series, charset: pd.Series) -> pd.Series:
    def one(data, name):
        if data is None:
            return None
        for attempt in (name, "utf-8"):
            try:
                return bytes(data).decode(attempt)
            except (LookupError, UnicodeDecodeError):
                pass
        return bytes(data).decode("latin-1")

    return pd.Series([one(d, n) for d, n in zip(raw, charset)], dtype="object")


def decode_html(raw: Column, header: Column | None = None) -> Column:
    """Bytes to text: the charset of the header, else of a meta tag in the first 2048 bytes, else UTF-8, and Latin-1 where none of them fits. Only other charsets than UTF-8 leave the JVM."""
    head = F.decode(F.substring(raw, 1, 2048), "ISO-8859-1")
    of = lambda c, pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    told = of(F.coalesce(header, F.lit("")), r"(?i)charset=[\"']?([\w-]+)") if header is not None else F.lit(None).cast("string")
    named = F.lower(F.coalesce(told, of(head, r"(?i)<meta[^>]+charset=[\"']?([\w-]+)"), F.lit("utf-8")))
    plain = named.isin("utf-8", "utf8") & F.is_valid_utf8(raw.cast("string"))
    return F.coalesce(F.when(plain, raw.cast("string")), _decoded(F.when(~plain, raw), named))


def sanitize(c: Column) -> Column:
    """Without NUL and other control characters but tab, line feed and carriage return."""
    return F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML files of a folder: url (the path), html, content hash, size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    html = sanitize(decode_html(F.col("content")))
    return files.select(F.col("path").alias("url"), html.alias("html"), F.sha2(html, 256).alias("content_hash"), F.col("length").alias("response_size"))


def chunk_file(url: Column, chunk_id: Column) -> Column:
    """``<host>/chunk_<slug>_<id>.txt``."""
    host = text.slug(F.coalesce(F.nullif(F.regexp_extract(url, r"^[^:/?#]+://(?:[^@/?#]*@)?([^:/?#]*)", 1), F.lit("")), F.nullif(url, F.lit("")), F.lit("unknown_url")))
    name = F.coalesce(F.nullif(text.slug(F.coalesce(url, F.lit(""))), F.lit("")), F.lit("unknown_url"))
    return F.concat(F.coalesce(F.nullif(host, F.lit("")), F.lit("unknown_url")), F.lit("/chunk_"), name, F.lit("_"), chunk_id, F.lit(".txt"))


def write_chunks(chunks: DataFrame, path: str, url: str = "source_url", content: str = "content") -> None:
    """Chunk texts in one folder a host."""
    host = F.split(chunk_file(F.col(url), F.lit("")), "/")[0]
    chunks.select(host.alias("host"), F.col(content).alias("value")).write.mode("append").partitionBy("host").text(path)


def log_retrieval(result: DataFrame, path: str) -> None:
    result.write.mode("append").json(path)
