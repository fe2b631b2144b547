"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared letter by letter after lower-casing and with runs of white
space as one space. A benchmark item is searched as passages: itself, or, where
long, overlapping windows of it. If a passage of m characters occurs in a text
with at most e edits, the two share at least m - q + 1 - q*e of the passage's
q-grams, and all these matches lie in one band of e + 1 diagonals (text position
less passage position). So matches are counted in bands of diagonals that
overlap by e, bands that reach the bound are retained, and each retained region
is verified by an alignment in that band.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import arrow_limits

#: Characters of a q-gram; edits allowed, as a share of a passage's characters.
Q, EDITS = 10, 0.08
#: Characters of a passage, and by how many windows of a long item are apart: every excerpt of PASSAGE + STRIDE - 1 characters holds a whole window.
PASSAGE, STRIDE = 160, 12
#: Characters of benchmark items that are searched in one pass over the texts.
BLOCK_CHARS = 1_200_000
_GROUP_CHARS = 1_000_000
#: Matches of q-grams that are counted in bands at once.
_MATCHES = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, item_id long, edits int, start_char long, end_char long"


def _lower_table() -> np.ndarray:
    """Lower case of each code point whose lower case is one code point."""
    out = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x1E944):
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    for i in range(0x3001):
        if chr(i).isspace():
            out[i] = 32
    return out


_tables: list[np.ndarray] = []


def normalize(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points, position of each in the text) after lower-casing; of white space only the first of a run stays, as a space, and none at the ends."""
    if not _tables:
        _tables.append(_lower_table())
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = _tables[0][raw]
    space = low == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(keep)
    if len(at) and low[at[-1]] == 32:
        at = at[:-1]
    return low[at], at


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q-gram that starts at each position."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    n = len(codes) - q + 1
    h = np.zeros(n, np.uint64)
    power: dict[int, np.ndarray] = {1: codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)}
    size = 1
    factor = _BASE
    factors = {1: _BASE}
    while size * 2 <= q:  # hashes of 1, 2, 4, ... characters, each from two of half the size
        half = power[size]
        power[size * 2] = half[:-size] * factors[size] + half[size:]
        factors[size * 2] = np.uint64(pow(int(factor), size * 2, 1 << 64))
        size *= 2
    at = 0
    for size in sorted(power, reverse=True):
        if at + size <= q:
            h = h * factors[size] + power[size][at : at + n]
            at += size
    return h ^ (h >> np.uint64(29))


def passages(item: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of an item's passages."""
    if len(item) <= PASSAGE:
        return [(0, len(item))]
    starts = [*range(0, len(item) - PASSAGE, STRIDE), len(item) - PASSAGE]
    return [(a, a + PASSAGE) for a in starts]


def budget(m: int, q: int = Q, edits: float = EDITS) -> int:
    """Edits allowed in a passage of m characters: so few that the q-gram bound stays positive."""
    return max(0, min(math.floor(m * edits), (m - q) // q))


def banded_distance(passage: np.ndarray, text: np.ndarray, shift: int, width: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits of ``passage`` against any part of ``text`` along diagonals shift to shift + width; None above ``most``.

    Returns (edits, start, end) in the text. Rows of the alignment are vectors
    over the band; the start of each path is carried along.
    """
    big = most + 1
    lanes = np.arange(width + 1)
    pos = shift + lanes  # text position before row 0's character on each diagonal
    inside = (pos >= 0) & (pos <= len(text))
    cost = np.where(inside, 0, big)
    start = pos.copy()
    padded = np.concatenate([text, [np.uint32(0xFFFFFFFF)]])
    for i, c in enumerate(passage):
        at = pos + i
        ok = (at >= 0) & (at < len(text))
        hit = padded[np.where(ok, at, len(text))] == c
        diagonal = np.where(ok, cost + ~hit, big)
        # drop a passage character: same text position, so the diagonal to the right in the row above
        drop = np.append(cost[1:] + 1, big)
        new = np.minimum(diagonal, drop)
        first = np.where(diagonal <= drop, start, np.append(start[1:], 0))
        # insert text characters: along the row, a running minimum
        run = np.minimum.accumulate(new - lanes) + lanes
        src = np.maximum.accumulate(np.where(new - lanes == np.minimum.accumulate(new - lanes), lanes, 0))
        cost = np.minimum(np.where((at + 1 >= 0) & (at + 1 <= len(text)), run, big), big)
        start = first[src]
        if cost.min() > most:
            return None
    best = int(np.argmin(cost))
    return (int(cost[best]), int(start[best]), int(pos[best] + len(passage))) if cost[best] <= most else None


class Index:
    """q-grams of all passages of a block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edits: float = EDITS):
        self.q = q
        codes, owner, place = [], [], []
        self.item: list[int] = []
        self.passage: list[np.ndarray] = []
        self.short: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            norm, _ = normalize(text or "")
            if not len(norm):
                continue
            if len(norm) < q:
                self.short.append((item_id, norm))
                continue
            seen: set[bytes] = set()  # windows of a repetitive item are alike
            for a, b in passages(norm):
                if (raw := norm[a:b].tobytes()) in seen:
                    continue
                seen.add(raw)
                g = grams(norm[a:b], q)
                codes.append(g)
                owner.append(np.full(len(g), len(self.item)))
                place.append(np.arange(len(g)))
                self.item.append(item_id)
                self.passage.append(norm[a:b])
        m = np.array([len(p) for p in self.passage], np.int64)
        self.edits = np.array([budget(int(x), q, edits) for x in m], np.int64)
        self.bound = m - q + 1 - q * self.edits
        #: Bands are this wide and begin at each multiple of ``step``, so neighbours overlap by the largest budget.
        self.step = 1 << max(3, int(self.edits.max(initial=0)).bit_length())
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        code = cat(codes, np.uint64)
        order = np.argsort(code, kind="stable")
        self.code, self.owner, self.place = code[order], cat(owner, np.int64)[order], cat(place, np.int64)[order]
        self.bits = max(16, min(24, int(16 * max(1, len(code))).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.code >> np.uint64(64 - self.bits)] = True

    def regions(self, codes: np.ndarray, base: np.ndarray) -> list[tuple[int, int, int]]:
        """(text number, passage, first diagonal within the text) of each band that reaches its passage's bound.

        codes: texts one after another, apart by a code that no text has; base: start of each text.
        """
        if not len(self.code):
            return []
        h = grams(codes, self.q)
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - self.bits)])
        lo = np.searchsorted(self.code, h[at], "left")
        n = np.searchsorted(self.code, h[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if not len(at):
            return []
        text = np.searchsorted(base, at, "right") - 1
        place = at - base[text]
        starts = np.concatenate([[0], np.flatnonzero(text[1:] != text[:-1]) + 1, [len(at)]])
        total = np.concatenate([[0], np.cumsum(n)])[starts]
        out: list[tuple[int, int, int]] = []
        k = 0
        while k < len(starts) - 1:  # whole texts, as many as have so many matches
            stop = max(k + 1, int(np.searchsorted(total, total[k] + _MATCHES, "right")) - 1)
            part = slice(starts[k], starts[stop])
            if total[stop] - total[k] > _MATCHES:
                out += self._windows(place[part], text[part], lo[part], n[part])
            else:
                out += self._bands(place[part], text[part], lo[part], n[part])
            k = stop
        return out

    def _windows(self, place, text, lo, n) -> list[tuple[int, int, int]]:
        """One text with very many matches: some of its diagonals and of the passages at a time.

        All matches of a band lie within ``reach`` positions from its first diagonal on.
        """
        reach = 2 * self.step + max(map(len, self.passage))
        out: list[tuple[int, int, int]] = []
        low = -reach
        while (a := int(np.searchsorted(place, low))) < len(place):
            low = max(low, int(place[a]) - reach)
            high = low + 8 * reach
            part = slice(a, int(np.searchsorted(place, high + reach)))
            parts = min(len(self.item), int(n[part].sum()) // _MATCHES + 1)
            edges = [len(self.item) * k // parts for k in range(parts + 1)]
            for owners in zip(edges, edges[1:]):
                out += self._bands(place[part], text[part], lo[part], n[part], (low, high), owners)
            low = high
        return out

    def _bands(self, place, text, lo, n, window: tuple[int, int] | None = None, owners: tuple[int, int] | None = None) -> list[tuple[int, int, int]]:
        """Bands that reach their bound: of all diagonals and passages, or those that begin in a window, and of some passages."""
        found = []
        step = len(n) if owners is None else max(1, _MATCHES * len(n) // int(n.sum()))
        for a in range(0, len(n), step):
            m = n[a : a + step]
            pick = np.repeat(lo[a : a + step] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            passage, t = self.owner[pick], np.repeat(text[a : a + step], m)
            diagonal = np.repeat(place[a : a + step], m) - self.place[pick]
            if owners is not None:
                own = (passage >= owners[0]) & (passage < owners[1])
                passage, t, diagonal = passage[own], t[own], diagonal[own]
            found.append(np.stack([t, passage, diagonal]))
        t, passage, diagonal = np.concatenate(found, axis=1)
        band = np.floor_divide(diagonal, self.step)
        # a match in the first ``edits`` diagonals of a band lies in the band before as well
        early = diagonal - band * self.step < self.edits[passage]
        keys = np.stack([np.concatenate([t, t[early]]), np.concatenate([passage, passage[early]]), np.concatenate([band, band[early] - 1])])
        if window is not None:
            begin = keys[2] * self.step
            keys = keys[:, (begin >= window[0]) & (begin < window[1])]
        if not keys.shape[1]:
            return []
        keys = keys[:, np.lexsort(keys)]
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        starts = np.concatenate([[0], change])
        count = np.diff(np.append(starts, keys.shape[1]))
        keep = starts[count >= self.bound[keys[1, starts]]]
        return [(int(a), int(b), int(c) * self.step) for a, b, c in keys[:, keep].T]

    def verify(self, norm: np.ndarray, passage: int, first: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best alignment of a passage in a band of a text."""
        e = int(self.edits[passage])
        p = self.passage[passage]
        # cheap way out: the passage itself on one diagonal of the band
        for d in range(max(0, first), min(first + self.step + e, len(norm) - len(p) + 1)):
            if norm[d] == p[0] and np.array_equal(norm[d : d + len(p)], p):
                return 0, d, d + len(p)
        # edits can lead e diagonals out of the band that holds the q-gram matches
        return banded_distance(p, norm, first - e, self.step + 3 * e, e)


def search(texts: list[str | None], index: Index) -> list[list[tuple[int, int, int, int]]]:
    """For each text the best match of each item: (item, edits, start, end), positions in the text as given."""
    found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= _GROUP_CHARS):
            size += len(texts[end] or "")
            end += 1
        norms = [normalize(t or "") for t in texts[at:end]]
        gap = np.array([0x110000], np.uint32)
        codes = np.concatenate([x for n, _ in norms for x in (n, gap)])
        base = np.cumsum([0, *(len(n) + 1 for n, _ in norms)])[:-1]
        for t, passage, first in sorted(index.regions(codes, base), key=lambda r: (r[0], r[2])):
            norm, where = norms[t]
            item = index.item[passage]
            known = found[at + t].get(item)
            # an exact match can only give way to an earlier one
            if known and known[0] == 0 and where[max(0, min(first, len(where) - 1))] >= known[1]:
                continue
            if (hit := index.verify(norm, passage, first)) and (known is None or (hit[0], where[hit[1]]) < known[:2]):
                last = where[hit[2] - 1] + 1 if hit[2] > hit[1] else where[hit[1]]
                found[at + t][item] = (hit[0], int(where[hit[1]]), int(last))
        for t, (norm, where) in enumerate(norms):
            for item, short in index.short:  # no q-gram to count: found letter by letter
                windows = np.lib.stride_tricks.sliding_window_view(norm, len(short)) if len(norm) >= len(short) else norm[:0].reshape(0, len(short))
                hits = np.flatnonzero((windows == short).all(axis=1))
                if len(hits):
                    found[at + t][item] = (0, int(where[hits[0]]), int(where[hits[0] + len(short) - 1] + 1))
        at = end
    return [[(i, *v) for i, v in sorted(f.items())] for f in found]


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Blocks of items of bounded size."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("t")).where("item is not null and t is not null")
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    for k in range(blocks):
        # texts that share an id are one item, so they share a block
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        yield [(r["item"], r["t"]) for r in part.orderBy("item", "t").collect()]


_indexes: dict[str, Index] = {}


def _index(shared, name: str) -> Index:
    """The worker's index of a block, built once."""
    if name not in _indexes:
        while len(_indexes) > 1:
            _indexes.pop(next(iter(_indexes)))
        _indexes[name] = Index(shared.value)
    return _indexes[name]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item found in it (``SCHEMA``): fewest edits, and the span in the document's characters.

    Items and documents that are null, empty or blank match nothing. Items of
    fewer than Q characters match only letter by letter. Repeated rows of
    documents each give their rows. Other columns are not read. The benchmark is
    searched in blocks of about BLOCK_CHARS characters, one pass over the
    documents each.
    """
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    out = None
    for items in _items(benchmark, item_col, item_text_col):
        shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
        part = rows.mapInArrow(lambda it, shared=shared, name=name: _find(it, shared, name), SCHEMA)
        out = part if out is None else out.union(part)
    return out


def _find(batches: Iterator[pa.RecordBatch], shared, name: str) -> Iterator[pa.RecordBatch]:
    index = _index(shared, name)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = [(d, *hit) for d, hits in zip(ids, search(texts, index)) for hit in hits]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], ["doc_id", "item_id", "edits", "start_char", "end_char"])


def _mark(batches: Iterator[pa.RecordBatch], shared, name: str, column: int, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    index = _index(shared, name)
    for batch in batches:
        hits = search(batch.column(column).to_pylist(), index)
        extra = [
            pa.array([[h[0] for h in x] for x in hits], pa.list_(pa.int64())),
            pa.array([min((h[1] for h in x), default=None) for x in hits], pa.int32()),
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *names])


def mark_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", items_out: str = "leaked_items", edits_out: str = "least_edits") -> DataFrame:
    """``docs`` with the columns ``items_out`` (ids, ascending; empty if clean) and ``edits_out`` (null if clean).

    Passes over the documents once for each block of the benchmark. A null or
    blank text is clean; repeated rows are each marked. A column of ``docs``
    with one of the two names is replaced.
    """
    arrow_limits(docs.sparkSession)
    out = docs.drop(items_out, edits_out)
    names = items_out + "__", edits_out + "__"
    first = True
    for items in _items(benchmark, item_col, item_text_col):
        shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
        at = out.columns.index(text_col)
        schema = T.StructType([*out.schema, T.StructField(names[0], T.ArrayType(T.LongType())), T.StructField(names[1], T.IntegerType())])
        marked = out.mapInArrow(lambda it, shared=shared, name=name, at=at: _mark(it, shared, name, at, names), schema)
        if first:
            out, first = marked.withColumnsRenamed({names[0]: items_out, names[1]: edits_out}), False
        else:
            both = F.array_sort(F.array_distinct(F.concat(items_out, names[0])))
            out = marked.withColumns({items_out: both, edits_out: F.least(edits_out, names[1])}).drop(*names)
    return out
