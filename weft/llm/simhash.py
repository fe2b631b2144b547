"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints: a bit is 1 if it is set in over half the XXH64 values of the
document's word shingles, repeats included.

``keep_one`` also links texts by the exact similarity of their shingle sets (``weft.llm.jaccard``).

Links: a fingerprint is cut into ``blocks`` blocks. Two fingerprints that differ
in at most ``max_distance`` bits agree in at least ``blocks - max_distance``
whole blocks, so they share a key made of so many blocks. Distinct fingerprints
are dealt by those keys; within a key each is compared with the others and the
Hamming distance decides. A key gives a spanning forest of its links, never all
pairs. Keys that very many distinct fingerprints share are dealt as pairs of
bounded tiles, each to a task of its own. Copies meet once, in their common
fingerprint. For a larger corpus take more blocks: unrelated pairs a key grow
with the square of the rows and shrink by 2 to the power of its bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import arrow_limits, materialize, plain_keys, shuffle_partitions, unused
from weft.llm.components import connected_components
from weft.llm.jaccard import band_keys, jaccard_links

#: Distinct fingerprints of a key that one task compares; larger keys are dealt in tiles of this size.
TILE = 4096
#: Tiles of oversized keys are looked up by broadcast only up to so many keys.
HOT_BROADCAST = 5_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STEP = 1 << 15
#: Side of a fingerprint in a tile pair: 0 and 1 of two tiles, or this where a tile meets itself.
WITHIN = 2


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; none for a text without words."""
    import xxhash

    split = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not split:
        return np.zeros(0, np.uint64)
    joined = b" ".join(split)
    size = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    if len(split) < words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(split) - words + 1], ends[words - 1 :]
    digest = xxhash.xxh64_intdigest
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), _STEP):
        a, b = starts[at : at + _STEP].tolist(), ends[at : at + _STEP].tolist()
        out[at : at + _STEP] = np.fromiter((digest(joined[i:j], 42) for i, j in zip(a, b)), np.uint64, len(a))
    return out


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        total += np.unpackbits(hashes[at : at + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((total * 2 > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int) -> int:
    """The unsigned 64-bit fingerprint; 0 for a text without words."""
    return _majority(shingle_hashes(text, words))


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def _signatures(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        fps, sets, bands = [], [], []
        for text in batch.column(2).to_pylist():
            hashes = shingle_hashes(text, words)
            fps.append(_majority(hashes))
            hashes = np.unique(hashes)
            sets.append(_signed(xxhash.xxh64_intdigest(hashes.tobytes())) if len(hashes) else None)
            bands.append(band_keys(hashes).view(np.int64) if len(hashes) else None)
        made = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sets, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "text_hash", "fp", "set_id", "bands"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(lambda it: _fingerprints(it, words), "doc_id long, fp long")


def block_masks(blocks: int, max_distance: int) -> list[int]:
    """One mask for each choice of ``blocks - max_distance`` blocks of 64 bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, blocks - max_distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Positions of the links (a, b) that join parts not joined before; n nodes."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[y] = x
            kept.append(k)
    return np.array(kept, np.int64)


def _first_key(u: np.ndarray, v: np.ndarray, masks: np.ndarray, mask: int | np.ndarray) -> np.ndarray:
    """Whether ``mask`` is the first mask under which the two are equal: each link belongs to one key only."""
    return ((u ^ v)[:, None] & masks[None, :] == 0).argmax(axis=1) == mask


def _near(fp: np.ndarray, other: np.ndarray | None, most: int, masks: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links that belong to this key, within ``fp`` or between it and ``other``."""
    whole = fp if other is None else np.concatenate([fp, other])
    base = 0 if other is None else len(fp)
    right = fp if other is None else other
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(fp), 256):
        i, j = np.nonzero(np.bitwise_count(fp[at : at + 256, None] ^ right[None, :]) <= most)
        i += at
        if other is None:
            i, j = i[j > i], j[j > i]
        own = _first_key(fp[i], right[j], masks, mask)
        i, j = i[own], j[own]
        us.append(i)
        vs.append(j + base)
        if sum(map(len, us)) > 4 * len(whole):  # thin out what is held
            u, v = np.concatenate(us), np.concatenate(vs)
            keep = _forest(u, v, len(whole))
            us, vs = [u[keep]], [v[keep]]
    u, v = np.concatenate(us), np.concatenate(vs)
    keep = _forest(u, v, len(whole))
    return whole[u[keep]], whole[v[keep]]


def _links(batches: Iterator[pa.RecordBatch], most: int, mask_list: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key (mask, block bits, tile pair): emits a forest of the verified links that belong to each key."""
    masks = np.array(mask_list, np.uint64)
    empty = np.zeros(0, np.int64)
    held = [empty] * 5

    def done(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        mask, key, pair, side, fp = cols
        if not len(fp):
            return None
        change = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
        starts = np.concatenate([[0], change])
        ends = np.append(change, len(fp))
        size = ends - starts
        bits = fp.view(np.uint64)
        us, vs = [bits[:0]], [bits[:0]]
        # small keys: all of them at once, by distance in the sorted order
        small = np.repeat((size <= 64) & (size > 1) & (pair[starts] < 0), size)
        group = np.repeat(np.arange(len(size)), size)
        near_i, near_j = [empty], [empty]
        for step in range(1, int(size[size <= 64].max(initial=1))):
            i = np.flatnonzero(small[:-step] & (group[step:] == group[:-step]))
            if not len(i):
                break
            i = i[np.bitwise_count(bits[i] ^ bits[i + step]) <= most]
            near_i.append(i)
            near_j.append(i + step)
        i, j = np.concatenate(near_i), np.concatenate(near_j)
        own = _first_key(bits[i], bits[j], masks, mask[i])
        i, j = i[own], j[own]
        keep = _forest(i, j, len(bits)) if len(i) else empty
        us.append(bits[i[keep]])
        vs.append(bits[j[keep]])
        for k in np.flatnonzero((size > 64) | ((pair[starts] >= 0) & (size > 1))):
            f, s = bits[starts[k] : ends[k]], side[starts[k] : ends[k]]
            m = int(mask[starts[k]])
            u, v = _near(f, None, most, masks, m) if s[0] == WITHIN else _near(f[s == 0], f[s == 1], most, masks, m)
            us.append(u)
            vs.append(v)
        u, v = np.concatenate(us), np.concatenate(vs)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in batches:
        cols = [np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
        mask, key, pair = cols[:3]
        last = len(mask)
        if last:  # the last key may go on in the next batch
            same = (mask == mask[-1]) & (key == key[-1]) & (pair == pair[-1])
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        held = [c[last:] for c in cols]
        if (out := done([c[:last] for c in cols])) is not None:
            yield out
    if (out := done(held)) is not None:
        yield out


def near_links(fps: DataFrame, max_distance: int = 4, blocks: int = 7, tile: int = TILE) -> DataFrame:
    """Verified links (u, v) between the distinct fingerprints of the column ``fp``: enough of them to connect what any links connect."""
    spark = fps.sparkSession
    arrow_limits(spark)
    plain = block_masks(blocks, max_distance)
    masks = [_signed(m) for m in plain]
    n = shuffle_partitions(spark)
    keyed = fps.select("fp").select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("mask", "key"))
    counts = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("c"))
    hot = materialize(counts.where(F.col("c") > tile).select(F.col("mask").alias("hot_mask"), F.col("key").alias("hot_key"), F.ceil(F.col("c") / tile).cast("int").alias("tiles")), "hot-keys")
    n_hot = hot.count()
    if n_hot:
        side = F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot
        joined = keyed.join(side, (F.col("mask") == F.col("hot_mask")) & (F.col("key") == F.col("hot_key")), "left")
        t = F.col("tiles")
        own = F.pmod(F.xxhash64("fp", F.lit(1)), t).cast("int")
        pair = lambda i, j: F.least(i, j) * t + F.greatest(i, j)
        roles = F.transform(F.sequence(F.lit(0), t - 1), lambda j: F.struct(pair(own, j).alias("pair"), F.when(own == j, WITHIN).when(own < j, 0).otherwise(1).alias("side")))
        once = F.array(F.struct(F.lit(-1).alias("pair"), F.lit(WITHIN).alias("side")))
        keyed = joined.select("mask", "key", F.explode(F.when(t.isNull(), once).otherwise(roles)).alias("r"), "fp").select("mask", "key", "r.pair", "r.side", "fp")
    else:
        keyed = keyed.select("mask", "key", F.lit(-1).alias("pair"), F.lit(WITHIN).alias("side"), "fp")
    dealt = keyed.repartition(n, "mask", "key", "pair").sortWithinPartitions("mask", "key", "pair", "side")
    return dealt.select("mask", "key", "pair", "side", "fp").mapInArrow(lambda it: _links(it, max_distance, plain), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_distance: int = 4, blocks: int = 7) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), fp (the same as a long), component_id, group_size (rows of the component).

    component_id is the smallest id that links reach. A null or blank text has
    fingerprint zero and is linked like any other. Rows with a null id take part;
    component_id is null only where all ids of the component are. Repeated rows
    each give a row. Other columns are not read.
    """
    members = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    by_fp = _component_of(_rooted(members, max_distance, blocks))
    return members.join(by_fp, members["fp"] == by_fp["f"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "fp", "component_id", "group_size")


def _rooted(members: DataFrame, max_distance: int, blocks: int) -> DataFrame:
    """(fp, root, least, n): the distinct fingerprints, the root that links of few bits give, the least id and the rows."""
    classes = materialize(members.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprint-classes")
    roots = materialize(connected_components(near_links(classes, max_distance, blocks)), "fingerprint-roots")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n")
    return materialize(rooted, "rooted")


def _component_of(rooted: DataFrame) -> DataFrame:
    """(f, component_id, group_size) of each fingerprint f."""
    summed = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size")), "components")
    return materialize(rooted.join(summed, "root").select(F.col("fp").alias("f"), "component_id", "group_size"), "component-of")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, max_distance: int = 6, blocks: int = 9) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one of each near-duplicate group: the smallest id stays, of its rows one. Of a group's rows with a null id one stays too.

    Two texts are linked if their fingerprints differ in at most ``max_distance``
    bits or if their sets of word shingles have a Jaccard similarity of at least
    ``jaccard.LEAST``; groups are what links connect. Of rows that repeat both id
    and text, the one with the least hash of all its columns stays. A null or
    blank text has fingerprint zero and is grouped like any other. An empty table
    gives no row.
    """
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("t"))
    members = materialize(rows.mapInArrow(lambda it: _signatures(it, words), "doc_id long, text_hash long, fp long, set_id long, bands array<long>"), "signatures")
    rooted = _rooted(members, max_distance, blocks)
    joined = materialize(connected_components(jaccard_links(members, rooted, docs, text_col, words)), "joined-roots")
    whole = rooted.withColumnRenamed("root", "part").join(joined, F.col("part") == F.col("node"), "left")
    rooted_by = materialize(whole.select(F.col("fp").alias("f"), F.coalesce("root", "part").alias("root")), "rooted-whole")
    # a row is known by its id and its text; the group by its fingerprint
    own = members.join(rooted_by, members["fp"] == rooted_by["f"]).select("doc_id", "text_hash", "root").distinct()
    own = materialize(own, "rows-of-groups")
    first = own.groupBy(F.col("root").alias("r"), F.col("doc_id").isNull().alias("blank")).agg(F.min(F.struct("doc_id", "text_hash")).alias("m"))
    other = (F.col("root") == F.col("r")) & (F.col("doc_id").isNull() == F.col("blank"))
    drop = own.join(first, other).where(~(F.col("doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("text_hash") == F.col("m.text_hash"))))
    drop = materialize(drop.select(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_text")), "drop")
    names = unused(docs, "__id", "__no_id", "__text")
    at = unused(docs, "__row")[0]
    gone = drop.select(*(c.alias(n) for n, c in zip(names, [*plain_keys((F.col("drop_id"), "long")), F.col("drop_text")])))
    hashed = docs.withColumns(dict(zip(names, [*plain_keys((F.col(id_col), "long")), F.xxhash64(text_col)])))
    # texts are dealt once, for the join and for the choice of one of rows that repeat both id and text
    kept = hashed.join(gone.hint("merge"), names, "left_anti")
    order = F.xxhash64(*(c for c, t in docs.dtypes if "map<" not in t))
    return kept.withColumn(at, F.row_number().over(Window.partitionBy(*names).orderBy(order))).where(F.col(at) == 1).select(*docs.columns)
