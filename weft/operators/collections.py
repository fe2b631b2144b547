"""Structured and ordinal questions: counts, first row of a content, dominant collections, positions, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text
from weft.operators.ingest import first

#: Collections (chunk type, entity) by falling preference, and the least size of one.
PRIORITY = (
    ("text", "content"), ("table", "table"), ("table", "country"), ("table", "product"), ("mixed", "card"), ("list", "list"),
    ("list_item", "list_item"), ("table_row", "table_row"), ("table_row", "country"), ("table_row", "product"),
)
LEAST_COLLECTION, RANKED_MOST = 5, 60


def first_of_each(rows: DataFrame, content: str, order: list[str]) -> DataFrame:
    """The first row of each content."""
    return first(rows, [content], [F.col(c) for c in order])


def collections(rows: DataFrame, kinds: list[str], ordinal: str) -> DataFrame:
    """Distinct positions (span) and rows of each kind of item."""
    return rows.where(F.col(ordinal).isNotNull()).groupBy(*kinds).agg(F.countDistinct(ordinal).alias("span"), F.count(F.lit(1)).alias("n"))


def priority(chunk_type: Column, entity: Column) -> Column:
    out = F.lit(len(PRIORITY))
    for k, (t, e) in enumerate(PRIORITY):
        out = F.when((chunk_type == t) & (entity == e), k).otherwise(out)
    return out


def dominant(rows: DataFrame, kinds: list[str], ordinal: str, prefer: Column | None = None, least: int = LEAST_COLLECTION) -> DataFrame:
    """The kind with the largest span, then rows, then preference, then name; none below ``least``."""
    order = [F.desc("span"), F.desc("n"), *([prefer] if prefer is not None else []), *kinds]
    return collections(rows, kinds, ordinal).orderBy(*order).limit(1).where(F.col("span") >= least)


def of_dominant(rows: DataFrame, found: DataFrame, kinds: list[str]) -> DataFrame:
    return rows.join(F.broadcast(found.select(*kinds)), kinds)  # one row


def nth(rows: DataFrame, ordinal: str, n: int, tie: list) -> DataFrame:
    """The row at position n from 1, or the last for -1; with its rank among the collection's own positions: one more than the distinct ones before it."""
    own = rows.where(F.col(ordinal).isNotNull())
    found = own.orderBy(F.desc(ordinal), *tie).limit(1) if n < 0 else own.where(F.col(ordinal) == max(0, n - 1)).orderBy(*tie).limit(1)
    at = found.select(F.col(ordinal).alias("__at"))  # one row
    before = own.join(F.broadcast(at), own[ordinal] < F.col("__at")).agg((F.countDistinct(ordinal) + 1).alias("collection_rank"))
    return found.join(F.broadcast(before))


def ranked_list(rows: DataFrame, ordinal: str, label: Column, tie: list, most: int = RANKED_MOST) -> DataFrame:
    """One row: the first items as numbered lines."""
    top = rows.where(F.col(ordinal).isNotNull()).orderBy(ordinal, *tie).limit(most)
    numbered = top.withColumn("__r", F.row_number().over(Window.orderBy(ordinal, *tie)))
    lines = F.array_sort(F.collect_list(F.struct("__r", F.concat((F.col(ordinal) + 1).cast("string"), F.lit(". "), label).alias("line"))))
    return numbered.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("ranked"), F.count(F.lit(1)).alias("n"))


def priced(rows: DataFrame, content: str, order: list) -> DataFrame:
    """First row of each content that has a price."""
    return first_of_each(rows, content, order).withColumn("price", text.price(F.col(content))).where("price is not null")


def price_filter(rows: DataFrame, operator: str, value: float) -> DataFrame:
    return rows.where(F.col("price") < value if operator == "lt" else F.col("price") > value)


def price_average(rows: DataFrame) -> DataFrame:
    return rows.agg(F.round(F.avg("price"), 2).alias("average_price"), F.count(F.lit(1)).alias("n"))
