"""Mixing sources to target weights by the cube method.

Each source's share of all words sets how often its documents are taken on
average: a whole number of copies each, and a fraction that is drawn. The draw
is balanced: the vector of inclusion probabilities moves through the null space
of two constraints, the source's number of documents and its number of words,
until nearly every probability is 0 or 1. Three documents at a time span a
null space, so buckets of documents run this flight phase side by side; what
each leaves open, at most two documents a source, meets in fewer buckets, again
and again, until a landing step of at most two documents a source is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import arrow_limits, materialize, plain_keys, shuffle_partitions, unused

#: Documents of a bucket, and buckets that meet in one at the next level.
BUCKET_ROWS, FAN_IN = 512, 64
#: Documents of a source whose copies may be changed after landing; how near its target a source is left alone; most changes.
SPARE, NEAR, CHANGES = 64, 0.002, 64
_EPS = 1e-9

ROW = "doc_id long, source string, size long, source_size long, target double, whole long, p double, h long, bucket long, taken long, spare boolean, most long"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from one row for each source (source, source_size).

    Sources by code point, null last, take ``weights`` in turn and share
    ``share`` of all sizes; a target stops at ``most`` times its source's size
    and the excess is shared anew by weight until none is above.
    """
    one = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # the capped sources are those with the least cap for their weight
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(whole) * F.lit(share)
    leveled = ranked.withColumn("level", (total - before) / after).withColumn("total", total).withColumn("capped", F.col("cap") < F.col("w") * F.col("level"))
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(whole)
    open_weight = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(whole)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * left / open_weight)
    return leveled.select("source", "source_size", target.alias("target"))


def _uniform(h: int, salt: int) -> float:
    """A number in [0, 1) from a document's hash."""
    x = (h ^ (salt * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def _move(p: list[float], u: list[float], r: float) -> list[float]:
    """A random step along u or against it, to the edge of the unit cube; the mean stays p."""
    up = min(((1 - a) / b if b > 0 else -a / b) for a, b in zip(p, u) if b)
    down = min((a / b if b > 0 else (a - 1) / b) for a, b in zip(p, u) if b)
    step = up if r * (up + down) < down else -down
    return [0.0 if (x := a + step * b) < _EPS else 1.0 if x > 1 - _EPS else x for a, b in zip(p, u)]


def null_vector(x: list[float]) -> list[float]:
    """A vector orthogonal to (1, 1, 1) and to x."""
    u = [x[1] - x[2], x[2] - x[0], x[0] - x[1]]
    return u if any(u) else [1.0, -1.0, 0.0]


def land(units: list[tuple[float, float, int]], salt: int) -> list[float]:
    """Whole decisions for what the flight leaves: the words' constraint is given up first, then the documents'."""
    p = [a[0] for a in units]
    while len(left := [k for k, a in enumerate(p) if 0 < a < 1]) > 1:
        i, j = left[:2]
        p[i], p[j] = _move([p[i], p[j]], [1.0, -1.0], _uniform(units[i][2], salt))
    for k in left:
        p[k] = 1.0 if _uniform(units[k][2], salt + 1) < p[k] else 0.0
    return p


def settle(copies: list[int], most: list[int], sizes: list[int], mass: float, near: float) -> list[int]:
    """Copies whose words are within ``near`` of ``mass``, or as near as changes of one or two documents by one copy bring them. No document gets more than its ``most``."""
    c, top, x = np.array(copies, np.int64), np.array(most, np.int64), np.array(sizes, float)
    n = len(c)
    for _ in range(CHANGES):
        off = float(c @ x - mass)
        if abs(off) <= near or not n:
            break
        # what one copy more of each document does, then one copy less
        turn = np.concatenate([np.where(c < top, x, np.inf), np.where(c > 0, -x, np.inf)])
        one = np.abs(off + turn)
        both = np.abs(off + turn[:, None] + turn[None, :])
        both[np.isnan(both)] = np.inf
        k = np.arange(2 * n)
        both[(k[:, None] % n) == (k[None, :] % n)] = np.inf  # two different documents
        i, j = np.unravel_index(int(np.argmin(both)), both.shape)
        best = int(np.argmin(one))
        picked = [best] if one[best] <= max(near, both[i, j]) else [int(i), int(j)]
        if min(one[best], both[i, j]) >= abs(off) - 1e-6:
            break
        for m in picked:
            c[m % n] += 1 if m < n else -1
    return c.tolist()


def _fly(batches: Iterator[pa.RecordBatch], level: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and source; runs of both fly on their own. Decided rows get ``taken``; the others keep null and their new probability."""
    group, key = None, object()

    def rows_out(rows: list[list]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in ROW.split(", ")])

    out: list[list] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if (row[8], row[1]) != key:
                if group:
                    out += group.end()
                key, group = (row[8], row[1]), _Flight(level, last)
            out += group.push(list(row))
        if out:
            yield rows_out(out)
            out = []
    if group and (out := group.end()):
        yield rows_out(out)


class _Flight:
    """The flight of one source's documents in one bucket, a row at a time.

    Holds two rows at most, but at the last level all rows it gets: a bucket's,
    or what FAN_IN buckets left open, and the spare ones.
    """

    def __init__(self, level: int, last: bool):
        self.level, self.last, self.n, self.held = level, last, 0, []
        self.all: list[tuple[list, float]] = []

    def _out(self, rows: list[list]) -> list[list]:
        """Decided rows go, but spare ones go on to the last level."""
        for row in rows:
            if not row[10]:
                row[9] = (row[5] + int(row[6])) * row[2]
        return [] if self.last else rows

    def push(self, row: list) -> list[list]:
        self.n += 1
        if self.last:
            self.all.append((row, row[6]))
        if row[6] <= _EPS or row[6] >= 1 - _EPS:
            row[6] = 0.0 if row[6] <= _EPS else 1.0
            return self._out([row])
        self.held.append(row)
        done = []
        while len(self.held) == 3:
            moved = _move([a[6] for a in self.held], null_vector([float(a[2]) for a in self.held]), _uniform(self.held[2][7], 1000 * self.level + self.n))
            for a, q in zip(self.held, moved):
                a[6] = q
            done += [a for a in self.held if a[6] in (0.0, 1.0)]
            self.held = [a for a in self.held if a[6] not in (0.0, 1.0)]
        return self._out(done)

    def end(self) -> list[list]:
        if not self.last:
            return self.held
        for a, q in zip(self.held, land([(a[6], a[2], a[7]) for a in self.held], 7)):
            a[6] = q
        # the flight keeps the words' sum, so what is off is what landing gave up
        off = sum(a[2] * (a[6] - p) for a, p in self.all)
        spare = [a for a, _ in self.all if a[10]]
        copies = [a[5] + int(a[6]) for a in spare]
        mass = sum(c * a[2] for c, a in zip(copies, spare)) - off
        for a, c in zip(spare, settle(copies, [a[11] for a in spare], [a[2] for a in spare], mass, NEAR * (spare[0][4] if spare else 0))):
            a[6] = float(c - a[5])
        for a, _ in self.all:
            a[9] = (a[5] + int(a[6])) * a[2]
        return [a for a, _ in self.all]


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken, copies.

    size counts the words ``[^\\x20\\x09-\\x0D]+`` of the text (0 for a null);
    taken is copies times size, and near the target in each source's sum. A null
    source is a source of its own, ordered last. Draws come from hashes of the
    id and size, so reruns agree; repeated rows are drawn one by one. Other
    columns are not read. An empty table gives no row.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    words = F.coalesce(F.regexp_count(F.col("t"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("t")).select("doc_id", "source", words.alias("size"))
    rows = materialize(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes, "source-sizes")
    n = sizes.agg(F.sum("n")).first()[0] or 0
    shares = source_targets(sizes.select("source", "source_size"), weights, share, most).withColumnRenamed("source", "s")
    targets = materialize(shares.join(sizes.select(F.col("source").alias("of"), "n"), F.col("s").eqNullSafe(F.col("of"))).drop("of"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = rows.join(targets, rows["source"].eqNullSafe(targets["s"]))
    buckets = max(1, math.ceil(n / BUCKET_ROWS))
    h = F.xxhash64("doc_id", "size", F.coalesce("source", F.lit("")))
    start = joined.select("doc_id", "source", "size", "source_size", "target", F.floor(rate).cast("long").alias("whole"), (rate - F.floor(rate)).alias("p"), h.alias("h"), "n").withColumn("bucket", F.pmod(F.shiftright("h", 8), F.lit(buckets))).withColumn("taken", F.lit(None).cast("long"))
    drawn = F.pmod(F.xxhash64("h", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.lit(SPARE / 2.0) * (1 / F.col("n") + F.col("size") / F.greatest("source_size", F.lit(1)))
    start = start.withColumn("spare", drawn).withColumn("most", F.lit(math.floor(most)).cast("long")).drop("n")
    open_rows, decided = start, []
    level = 0
    while True:
        last = buckets == 1
        flown = _level(open_rows, level, last)
        decided.append(flown.where("taken is not null"))
        if last:
            break
        buckets = max(1, math.ceil(buckets / FAN_IN))
        open_rows = flown.where("taken is null").withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
        level += 1
    out = decided[0]
    for d in decided[1:]:
        out = out.union(d)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", (F.col("whole") + F.col("p").cast("long")).alias("copies"))


def _level(rows: DataFrame, level: int, last: bool) -> DataFrame:
    """Fly every bucket. Documents of size 0 weigh nothing but count; ties keep the order of hash and id."""
    n = shuffle_partitions(rows.sparkSession)
    dealt = rows.repartition(n, "bucket", "source").sortWithinPartitions("bucket", "source", "h", "doc_id", "size")
    return materialize(dealt.mapInArrow(lambda it: _fly(it, level, last), ROW), f"flight-{level}")


def repeat_taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    Rows with the same id, source and size share out their copies between them,
    in the order of a hash of all their columns; rows with a null id do so too.
    An empty table gives no row.
    """
    taken = mix_sources(docs, id_col, text_col, source_col, **options)
    names = unused(docs, "__id", "__no_id", "__source", "__no_source", "__words")
    share, copies, rows, copy = unused(docs, "__share", "__copies", "__rows", "__copy")
    keyed = taken.select("copies", *(c.alias(n) for n, c in zip(names, [*plain_keys((F.col("doc_id"), "long"), (F.col("source"), "string")), F.col("size")])))
    keys = materialize(keyed.groupBy(*names).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows)).where(F.col(copies) > 0), "taken")
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = docs.withColumns(dict(zip(names, [*plain_keys((F.col(id_col), "long"), (F.col(source_col), "string")), words])))
    # texts are dealt by these keys whatever the size of the list, once for the join and the order of repeated rows
    joined = sized.join(keys.hint("merge"), names)
    order = F.xxhash64(*(c for c, t in docs.dtypes if "map<" not in t))
    nth = F.when(F.col(rows) == 1, F.lit(0)).otherwise(F.row_number().over(Window.partitionBy(*names).orderBy(order)) - 1)
    part = F.floor(F.col(copies) / F.col(rows)) + (nth < F.col(copies) % F.col(rows)).cast("long")
    counted = joined.withColumn(share, part.cast("int")).where(F.col(share) > 0)
    return counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(share)))).select(*docs.columns)
