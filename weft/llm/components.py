"""Connected components by alternating large-star and small-star, all in DataFrames.

Each round is written to the shared folder, so lineage stays short and a lost
executor costs one round. Both sides of every join on a node are plain shuffles
of written tables: adaptive execution splits the partitions of a node that many
edges share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import materialize

MAX_ROUNDS = 60


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component.

    Edges may repeat, stand in either direction or be loops; edges with a null are left out.
    """
    e = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null")
    e = materialize(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    nodes = e
    before = _state(e)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        # large star: every larger neighbour of a node is tied to the least of its neighbourhood
        both = e.union(e.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("n"), F.least("u", "w").alias("m")), "least")
        # the edge itself points down from u to v, so v's larger neighbour is u
        e = materialize(e.join(least, e["v"] == least["n"]).select("u", F.col("m").alias("v")).distinct(), "large")
        # small star: a node and its smaller neighbours are tied to the least of them
        least = materialize(e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n"), "least")
        tied = e.join(least, e["u"] == least["n"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(tied.union(least.select("n", "m")).distinct(), "small")
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = nodes.select(F.col("v").alias("node")).union(nodes.select("u")).distinct()
    return roots.join(e, roots["node"] == e["u"], "left").select("node", F.coalesce("v", "node").alias("root"))
