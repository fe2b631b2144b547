"""Breadth-first crawl order over an edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import shared_dir


def bfs(edges: DataFrame, seeds: DataFrame, depth: int = 3, most: int | None = None, checkpoint: bool = True) -> DataFrame:
    """(url, depth) of what is reached, each at its least depth. ``most``: pages in all, by depth and url.

    edges: src, dst. seeds: url. Each level joins only the new urls and leaves
    out those seen; levels are written to the shared folder, so lineage does not
    grow and a level is computed once.
    """
    spark = edges.sparkSession
    folder = f"{shared_dir(spark)}/weft-frontier-{uuid.uuid4().hex}" if checkpoint else None
    seen = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    new = seen
    for level in range(1, depth + 1):
        found = new.join(edges, new["url"] == edges["src"]).select(F.col("dst").alias("url")).distinct()
        new = found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(level))
        if folder:
            new.write.parquet(f"{folder}/{level}")
            new = spark.read.parquet(f"{folder}/{level}")
        seen = seen.union(new)
        if new.isEmpty():
            break
    return seen if most is None else seen.orderBy("depth", "url").limit(most)
