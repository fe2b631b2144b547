"""Links between texts whose word-shingle sets have a Jaccard similarity of at least ``LEAST``.

Candidates share the least hashes of a band of ``ROWS`` of ``BANDS * ROWS``
permutations: at a similarity of 0.8 a pair is missed with a probability of
(1 - 0.8 ** 4) ** 20, 3 in 100 000, and less above. Each candidate pair is
verified by its whole shingle sets. Only pairs that are not connected yet are
compared: all of a small bucket, and in a large one neighbours in a few random
orders first, which connects a group of near copies by a number of pairs in
proportion to its rows.

What large buckets still hold apart is joined exactly, whatever the bands: shingles
are put in one order, those held under one root only first, then the rarest.
Sets x and y of such a similarity have at least ``LEAST / (1 + LEAST) * (|x| + |y|)``
shingles in common, so behind the first common one, itself included, both hold as
many. Only the first ``(1 - LEAST) * |x|`` shingles and one more of a set can be that
one, and sets with more shingles of their own than that are in no link. Pairs are
made within a shingle, from sizes and positions alone; a group of texts that only
share a passage gives next to none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import materialize, shuffle_partitions
from weft.llm.components import connected_components

LEAST, BANDS, ROWS = 0.8, 20, 4
#: Sets of a bucket that are compared at once, and random orders in which larger buckets are first compared.
SMALL, ORDERS = 16, 3

#: An allowance for the product's rounding: counts are whole numbers.
EDGE = 1e-6
#: Pairs of sets that a task looks at at once.
PAIRS = 1 << 20

_STEP = 1 << 12
_SEEDS = np.random.default_rng(17).integers(1, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = np.random.default_rng(18).integers(1, 1 << 63, ROWS, np.uint64) | np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band from the hashes of a set that is not empty."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), _STEP):
        x = (hashes[None, at : at + _STEP] ^ _SEEDS[:, None]) * _PRIME
        x ^= x >> np.uint64(32)
        x *= _PRIME
        least = np.minimum(least, x.min(axis=1))
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    from weft.llm.simhash import shingle_hashes

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["s", "hashes"])


def _all_pairs(rows: DataFrame) -> DataFrame:
    a, b = (rows.select("band", "key", *(F.col(c).alias(f"{c}_{k}") for c in ("s", "part", "root"))) for k in (1, 2))
    return a.join(b, ["band", "key"]).where("s_1 < s_2 and root_1 <> root_2").select("s_1", "s_2", "part_1", "part_2")


def _neighbours(rows: DataFrame, order: int) -> DataFrame:
    by = Window.partitionBy("band", "key").orderBy(F.xxhash64("s", "band", F.lit(order)), "s")
    before = rows.select(*(F.col(c).alias(f"{c}_1") for c in ("s", "part", "root")), *(F.lag(c).over(by).alias(f"{c}_2") for c in ("s", "part", "root")))
    low = F.col("s_1") < F.col("s_2")
    ends = [F.when(low if k == 1 else ~low, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2")).alias(f"{c}_{k}") for c in ("s", "part") for k in (1, 2)]
    return before.where("root_1 <> root_2").select(*ends)


def _apart(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one root."""
    buckets = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "key", "n")
    return rows.drop("n").join(buckets, ["band", "key"])


def _prefix_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, n, at, s, root) come sorted by h and n: the pairs of sets under different roots that can have their first common shingle here."""
    share = LEAST / (1 + LEAST)
    held = [np.zeros(0, np.int64)] * 5

    def done(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, n, at, s, root = cols
        if not len(h):
            return
        group = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])) << 32
        rest = n - at + EDGE
        # the larger set follows the smaller, whose rest bounds its size
        ends = np.searchsorted(group + n, group + np.floor(rest / share - n).astype(np.int64), "right")
        size = np.maximum(ends - np.arange(len(n)) - 1, 0)
        total = np.cumsum(size)
        first = 0
        while first < len(n):
            stop = max(first + 1, int(np.searchsorted(total, total[first] - size[first] + PAIRS, "right")))
            m = size[first:stop]
            i = np.repeat(np.arange(first, stop), m)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
            near = (root[i] != root[j]) & (rest[j] >= share * (n[i] + n[j]))
            i, j = i[near], j[near]
            i, j = np.where(s[i] < s[j], i, j), np.where(s[i] < s[j], j, i)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s[i], s[j], root[i], root[j])], ["s_1", "s_2", "part_1", "part_2"])
            first = stop

    for batch in batches:
        cols = [np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
        # the last shingle may go on in the next batch
        last = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
        held = [c[last:] for c in cols]
        yield from done([c[:last] for c in cols])
    yield from done(held)


def _rest_pairs(rest: DataFrame, hashes: DataFrame) -> DataFrame:
    """(s_1, s_2, part_1, part_2): every pair of the sets of ``rest`` (s, root) under different roots that can reach ``LEAST``; parts are the roots."""
    rows = materialize(rest.join(hashes, "s").select("s", "root", "hashes"), "rest")
    each = rows.select("s", "root", F.explode("hashes").alias("h"))
    common = each.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("h").alias("w"), "df")
    held = each.join(common, F.col("h") == F.col("w")).groupBy(F.col("s").alias("of")).agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("common"))
    n = F.size("hashes")
    sized = rows.join(held, F.col("s") == F.col("of")).select("s", "root", n.alias("n"), (n - F.size("common")).alias("own"), "common")
    can = sized.withColumn("left", (F.floor((1 - LEAST) * F.col("n") + EDGE) + 1 - F.col("own")).cast("int")).where("left > 0")
    prefix = can.select("s", "root", "n", "own", F.posexplode(F.slice("common", F.lit(1), F.col("left"))).alias("k", "x"))
    dealt = prefix.select(F.col("x.h").alias("h"), F.col("n").cast("long"), (F.col("own") + F.col("k")).cast("long").alias("at"), "s", "root")
    dealt = dealt.repartition(shuffle_partitions(rest.sparkSession), "h").sortWithinPartitions("h", "n")
    return dealt.mapInArrow(_prefix_pairs, "s_1 long, s_2 long, part_1 long, part_2 long")


def _alike(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(u, v): the parts of those pairs whose whole shingle sets are alike."""
    pairs = materialize(pairs.distinct(), "candidates")
    a, b = (hashes.select(F.col("s").alias(f"s_{k}"), F.col("hashes").alias(f"x_{k}")) for k in (1, 2))
    both, sizes = F.size(F.array_intersect("x_1", "x_2")), F.size("x_1") + F.size("x_2")
    alike = pairs.join(a, "s_1").join(b, "s_2").where(both >= LEAST * (sizes - both) - EDGE)
    return materialize(alike.select(F.col("part_1").alias("u"), F.col("part_2").alias("v")).distinct(), "alike")


def jaccard_links(members: DataFrame, rooted: DataFrame, docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """(u, v): verified links between the roots of ``rooted`` (fp, root), enough of them to connect what any links connect.

    members: (text_hash, fp, set_id, bands), set_id null for a text without words; text_hash is xxhash64 of the text in ``docs``.
    """
    spark = docs.sparkSession
    sets = members.where("set_id is not null").groupBy("set_id", "fp").agg(F.min("text_hash").alias("text_hash"), F.first("bands").alias("bands"))
    sets = sets.join(rooted.select(F.col("fp").alias("f"), "root"), F.col("fp") == F.col("f")).select(F.xxhash64("set_id", "fp").alias("s"), "text_hash", F.col("root").alias("part"), "root", "bands")
    sets = materialize(sets, "shingle-sets")
    left = materialize(_apart(sets.select("s", "part", "root", F.posexplode("bands").alias("band", "key"))), "buckets")
    links = spark.createDataFrame([], "u long, v long")
    if left.isEmpty():
        return links
    needed = sets.join(left.select("s").distinct(), "s", "left_semi").select("s", "text_hash")
    texts = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).join(needed, F.col("h") == F.col("text_hash")).dropDuplicates(["s"])
    hashes = materialize(texts.select("s", "t").mapInArrow(lambda it: _sets(it, words), "s long, hashes array<long>"), "shingles")
    for order in range(ORDERS):
        large = left.where(F.col("n") > SMALL)
        pairs = _neighbours(large, order)
        new = _alike(pairs if order else _all_pairs(left.where(F.col("n") <= SMALL)).union(pairs), hashes)
        links = links.union(new)
        if large.isEmpty():
            return links
        if order and new.isEmpty():
            break
        roots = materialize(connected_components(links), "roots")
        again = large.drop("root").join(roots, large["part"] == roots["node"], "left").select("s", "part", "band", "key", F.coalesce("root", "part").alias("root"))
        left = materialize(_apart(again), "buckets")
        if left.isEmpty():
            return links
    return links.union(_alike(_rest_pairs(left.select("s", "root").distinct(), hashes), hashes))
