"""Chats, messages, jobs: lists with counts, message pages, get-or-create."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_counts(chats: DataFrame, messages: DataFrame, key: str, foreign: str, time: str) -> DataFrame:
    """Each chat with the number of its messages and the time of the last; the most recent first, those without one last."""
    counted = messages.groupBy(F.col(foreign).alias("__chat")).agg(F.count(F.lit(1)).alias("message_count"), F.max(time).alias("last_message_at"))
    joined = chats.join(counted, chats[key] == counted["__chat"], "left").drop("__chat")
    return joined.withColumn("message_count", F.coalesce("message_count", F.lit(0))).orderBy(F.desc_nulls_last("last_message_at"), key)


def page(messages: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    return messages.orderBy(*order).offset(offset).limit(limit)


def latest(messages: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n, oldest first."""
    return messages.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)


def last_of_each(messages: DataFrame, chat: str, time: str, tie: str, columns: list[str]) -> DataFrame:
    return messages.groupBy(chat).agg(F.max_by(F.struct(*columns), F.struct(time, tie)).alias("m")).select(chat, "m.*")


def get_or_create(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Existing rows and those wanted that are missing; the first of each key wins."""
    new = wanted.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    return existing.unionByName(new, allowMissingColumns=True)
