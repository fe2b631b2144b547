"""Exact dedup by content-defined chunk recipes.

A normalised text is cut into chunks where a rolling hash of its last bytes has
its low bits zero, so equal texts give equal chunks. A chunk's identifier is
its 64-bit hash, verified over the corpus: equal hashes of different bytes get
different identifiers. A text's recipe is its list of identifiers. Texts are
equal exactly if their recipes are, and recipes, a hundredth as long, are what
is grouped, shuffled and compared. Chunk bytes move once, copies in a task not
at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import arrow_limits, materialize

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Chunk sizes in bytes. The least size covers the rolling hash's window, so that a cut depends on the chunk's own bytes.
LEAST, MEAN_BITS, MOST = 256, 10, 8192
_WINDOW_STEPS = 5  # the hash sees the last 2**5 bytes
_PART = 1 << 20

#: A pseudo-random number for each byte value, by a multiplicative rule.
_GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)).astype(np.uint32)


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the window that ends at each byte: sum of gear numbers, the j-th byte back shifted by j bits."""
    h = _GEAR[data]
    for step in range(_WINDOW_STEPS):
        back = 1 << step
        shifted = h[:-back] << np.uint32(back)
        h = h.copy()
        h[back:] += shifted
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; none for an empty text."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    top = np.uint32(32 - MEAN_BITS)
    found = []
    for at in range(0, n, _PART):  # bounds what a very long text holds at once
        lead = min(at, 1 << _WINDOW_STEPS)
        found.append(np.flatnonzero(_rolling(raw[at - lead : at + _PART])[lead:] >> top == 0) + (at + 1))
    marks = np.concatenate(found)
    ends, start = [], 0
    while n - start > LEAST:
        k = int(np.searchsorted(marks, start + LEAST))
        end = min(start + MOST, int(marks[k]) if k < len(marks) else n, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace").translate(_LOWER) for t in column.to_pylist()]


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        recipes, digests = [], []
        for data in _bytes_of(batch.column(1)):
            ends = cuts(data)
            recipes.append([xxhash.xxh64_intdigest(data[a:b]) - (1 << 63) for a, b in zip([0, *ends], ends)])
            digests.append(hashlib.sha256(data).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(recipes, pa.list_(pa.int64())), pa.array(digests)], ["doc_id", "recipe", "text_sha256"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct chunks of each batch with their hashes."""
    import xxhash

    for batch in batches:
        seen: set[bytes] = set()
        for data in _bytes_of(batch.column(0)):
            ends = cuts(data)
            seen.update(data[a:b] for a, b in zip([0, *ends], ends))
        chunks = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(c) - (1 << 63) for c in chunks], pa.int64()), pa.array(chunks, pa.binary())], ["id", "chunk"])


def _verified(docs: DataFrame) -> DataFrame:
    """(id, chunk, n) of the hashes that different chunks share, n from 0 in the order of the chunks' bytes. Empty but for a hash collision."""
    distinct = docs.select("t").mapInArrow(_chunks, "id long, chunk binary").distinct()
    # chunk bytes move once, to be told apart; their hashes alone are counted
    shared = materialize(distinct.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id"), "shared-hashes")
    if shared.isEmpty():
        return shared
    both = distinct.join(shared, "id")
    # copies of one colliding hash: as many rows as different chunks share it
    ranked = both.groupBy("id").agg(F.sort_array(F.collect_set("chunk")).alias("chunks"))
    return materialize(ranked.select("id", F.posexplode("chunks").alias("n", "chunk")), "collisions")


def _resolve(batches: Iterator[pa.RecordBatch], known: dict[tuple[int, bytes], int]) -> Iterator[pa.RecordBatch]:
    """Recipes in which each colliding chunk's identifier is followed by its number."""
    import xxhash

    for batch in batches:
        recipes, digests = [], []
        for data in _bytes_of(batch.column(1)):
            ends = cuts(data)
            recipe = []
            for a, b in zip([0, *ends], ends):
                i = xxhash.xxh64_intdigest(data[a:b]) - (1 << 63)
                recipe += [i, known[i, data[a:b]]] if (i, data[a:b]) in known else [i]
            recipes.append(recipe)
            digests.append(hashlib.sha256(data).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(recipes, pa.list_(pa.int64())), pa.array(digests)], ["doc_id", "recipe", "text_sha256"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical after lower-casing A-Z; a null is empty. Of
    equal texts the row with the largest id stays; rows that repeat that id all
    count as it. A null id is less than any other, and stays only where a group
    has no other. Other columns are not read.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    schema = "doc_id long, recipe array<long>, text_sha256 string"
    collisions = _verified(rows)
    if "chunk" in collisions.columns:
        # as many as pairs of different chunks with one 64-bit hash: about n*n/2**65
        known = {(r["id"], bytes(r["chunk"])): r["n"] for r in collisions.collect()}
        made = rows.mapInArrow(lambda it: _resolve(it, known), schema)
    else:
        made = rows.mapInArrow(_recipes, schema)
    recipes = materialize(made, "recipes")
    groups = materialize(recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1").withColumnRenamed("recipe", "r"), "copies")
    # both sides are plain shuffles of written tables: adaptive execution splits a recipe that very many rows share
    joined = recipes.join(groups, recipes["recipe"] == groups["r"], "left")
    # no group: a text that stands alone
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"))
