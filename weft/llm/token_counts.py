"""Token counts by offset-mapped attribution.

A document is encoded once, whole. Every token has a character span in the
text: its first byte's character up to its last byte's. Token spans are joined
with the spans of the document's sections by interval, and each token counts
for exactly one section. A token that crosses a boundary goes where most of its
bytes lie; on a tie, to the earlier section (``rule="majority"``), or always to
the section of its first byte (``"first"``) or last byte (``"last"``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import tokens
from weft.llm.common import arrow_limits

RULES = ("majority", "first", "last")
SCHEMA = "doc_id long, section int, start_char int, end_char int, n_tokens long, n_crossing long"


def line_sections(text: str) -> np.ndarray:
    """Start characters of the sections of a text: its lines, each with its line feed."""
    starts = [0]
    at = text.find("\n")
    while 0 <= at < len(text) - 1:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(starts, np.int64)


def attribute(token_bytes: np.ndarray, bounds: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section.

    token_bytes: bytes of each token, in order. bounds: byte at which each
    section starts, ascending, the first 0. Sections cover the text.
    """
    ends = np.cumsum(token_bytes)
    starts = ends - token_bytes
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, np.maximum(ends - 1, starts), "right") - 1
    owner = last.copy() if rule == "last" else first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "majority":
        edge = np.append(bounds, ends[-1] if len(ends) else 0)
        for t in crossing:
            parts = np.arange(first[t], last[t] + 1)
            held = np.minimum(edge[parts + 1], ends[t]) - np.maximum(edge[parts], starts[t])
            owner[t] = parts[np.argmax(held)]
    n = len(bounds)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def _count(batches: Iterator[pa.RecordBatch], vocab: str, rule: str, fields: int) -> Iterator[pa.RecordBatch]:
    enc = tokens.encoder(vocab)
    if not enc.byte_level:
        raise ValueError(f"{vocab} is no byte-level tokenizer: its tokens do not tell the bytes they stand for")
    names = ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"]
    for batch in batches:
        ids = batch.column(0).to_pylist()
        if fields:
            parts = [[v or "" for v in row] for row in zip(*(batch.column(1 + k).to_pylist() for k in range(fields)))]
            texts = ["".join(p) for p in parts]
        else:
            parts, texts = None, [t or "" for t in batch.column(1).to_pylist()]
        out: list[tuple[np.ndarray, ...]] = []
        for k, (text, code) in enumerate(zip(texts, enc.encode(texts))):
            if parts is None:
                starts = line_sections(text)
            else:
                starts = np.concatenate([[0], np.cumsum([len(p) for p in parts[k]])[:-1]]).astype(np.int64)
            if text.isascii():
                bounds = starts
            else:
                lead = (np.frombuffer(text.encode("utf-8", "replace"), np.uint8) & 0xC0) != 0x80
                bounds = np.append(np.flatnonzero(lead), len(lead))[starts]
            n, crossing = attribute(enc.n_bytes[np.frombuffer(code, enc.dtype)], bounds, rule)
            out.append((np.arange(len(starts)), starts, np.append(starts[1:], len(text)), n, crossing))
        if not out:
            continue
        owners = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), [len(x[0]) for x in out])))
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([owners, *(pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), types))], names)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str | None = "text", fields: list[str] | None = None, vocab: str | None = None, rule: str = "majority") -> DataFrame:
    """One row for each section of each document (``SCHEMA``): its span, tokens, and those of them that cross its edge.

    Sections are the lines of ``text_col``, or else the columns ``fields``,
    which are encoded as one text in that order. Spans count characters. A null
    is empty; an empty text has one section of no tokens; an empty field is a
    section of none (a boundary shared by empty fields belongs to the last of
    them). Other columns are not read. The tokens of a document's sections sum
    to those of its whole text. The tokenizer must be byte-level.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    arrow_limits(docs.sparkSession)
    vocab = vocab or tokens.default_vocab()
    cols = fields or [text_col]
    rows = docs.select(F.col(id_col).cast("long").alias("i"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(cols)))
    n = len(fields or [])
    return rows.mapInArrow(lambda it: _count(it, vocab, rule, n), SCHEMA)
