"""Text, hash and array functions as Spark columns; only the SimHash of chunks runs Python, in Arrow batches."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases that mark an answer as holding nothing.
UNHELPFUL = (
    "i don't have enough information", "i don't have that information", "i don't have enough specific information",
    "i couldn't find", "i can't find", "i'm not sure",
)

#: Labels that are no headings.
NOT_HEADINGS = (
    "updated every", "last updated", "learn more", "read more", "sign up", "subscribe", "follow us", "share this",
    "posted on", "published on", "written by",
)

WORD = r"[\p{L}\p{N}_]+"
LABEL_LINE = r"(?m)^[A-Za-z][A-Za-z' \-]{1,25}:\s*-?[\d,]+(?:\.\d+)?%?\s*$"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def squeeze_lower(c: Column) -> Column:
    return F.lower(squeeze(c))


def word_tokens(c: Column) -> Column:
    """Number of word tokens, for splitting and scores."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD))


def words(c: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Number of white-space separated words, the stored count."""
    return F.size(words(c))


def is_empty(c: Column) -> Column:
    """Null or blank, only sentence marks, one template mark, or one bracketed line."""
    t = strip(F.coalesce(c, F.lit("")))
    return (t == "") | t.rlike(r"^[.,;:!?]+$") | t.rlike(r"^\{\{.*\}\}$") | t.rlike(r"^\[.*\]$")


def is_junk(c: Column) -> Column:
    """At most one character, or only marks and white space."""
    t = F.coalesce(c, F.lit(""))
    return (F.length(strip(t)) <= 1) | t.rlike(r"""^[.,;:!?()\[\]{}"' \n\t]*$""")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def normalized_md5(c: Column) -> Column:
    """Dedupe and ordinal key: MD5 of the squeezed, lower-cased text."""
    return F.md5(squeeze_lower(c))


@F.pandas_udf(T.LongType())
def chunk_simhash(texts: pd.Series) -> pd.Series:
    """64-bit SimHash of lower-cased word tokens with repeats: the first eight MD5 bytes of each, a bit set where more tokens have it than lack it; 0 for no token."""
    known: dict[str, int] = {}
    out = []
    for c in texts:
        tokens = re.findall(r"\w+", c.lower()) if c else []
        for w in set(tokens).difference(known):
            known[w] = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
        h = np.array([known[w] for w in tokens], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits((bits * 2 > len(h)).astype(np.uint8), bitorder="little").view(np.int64)[0]))
        if len(known) > 200_000:
            known.clear()
    return pd.Series(out, dtype="int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def information_density(c: Column) -> Column:
    """Words for each link word plus one."""
    w = words(c)
    return F.size(w) / (F.size(F.filter(w, lambda x: x.startswith("http://") | x.startswith("https://"))) + F.lit(1.0))


def heading_path(path: Column, heading: Column, title: Column, suffix: Column | None = None) -> Column:
    """The section's own path, else title and heading; empty parts left out; an optional last part."""
    made = F.when(F.coalesce(F.nullif(heading, F.lit("")), title) != title, F.array(title, heading)).otherwise(F.array(title))
    out = F.filter(F.when(F.size(F.coalesce(path, F.array().cast("array<string>"))) > 0, path).otherwise(made), lambda p: p.isNotNull() & (p != ""))
    return out if suffix is None else F.when(suffix.isNull(), out).otherwise(F.concat(out, F.array(suffix)))


def context_prefix(path: Column) -> Column:
    """The path without its leaf, joined."""
    return F.array_join(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), " > ")


def word_windows(c: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of words: one starts at each step while there are words."""
    w, step = words(c), max(1, size - overlap)
    n = F.ceil(F.size(w) / F.lit(float(step))).cast("int")
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * step + 1, size), " ")))


def glued_pairs(c: Column) -> Column:
    """``12Rank 7Votes`` as ``Rank: 12`` and ``Votes: 7``, with leading text first; other text as it is.

    Cells that start with a currency sign or hold a percent sign are not split.
    """
    pair = r"(\d[\d,\.]*)\s*([A-Z][A-Za-z ]{1,30})"
    numbers, labels = F.regexp_extract_all(c, F.lit(pair), F.lit(1)), F.regexp_extract_all(c, F.lit(pair), F.lit(2))
    made = F.zip_with(numbers, labels, lambda n, label: F.concat(F.trim(label), F.lit(": "), n))
    lead = F.regexp_replace(F.regexp_extract(c, r"(?s)^(.*?)\d[\d,\.]*\s*[A-Z][A-Za-z ]{1,30}", 1), r"^[ ,]+|[ ,]+$", "")
    split = F.when(F.length(lead) > 1, F.concat(F.array(lead), made)).otherwise(made)
    tries = c.rlike(r"\d[A-Z]") & ~F.trim(c).rlike("^[$£€¥₹]") & ~c.contains("%")
    return F.when(tries & (F.size(numbers) > 0), split).otherwise(F.array(c))


def looks_like_heading(c: Column) -> Column:
    bad = F.lit(False)
    for phrase in NOT_HEADINGS:
        bad = bad | F.lower(c).contains(phrase)
    return c.isNotNull() & (c != "") & (F.length(c) <= 120) & ~bad & ~c.rlike(r"^\d{4}-\d{2}-\d{2}") & ~c.rlike(r"^[A-Z][a-z]+ \d{1,2}, \d{4}")


def label_lines(c: Column) -> Column:
    """Number of ``Label: number`` lines."""
    return F.regexp_count(c, F.lit(LABEL_LINE))


def truncate(c: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - len(suffix)), F.lit(suffix)))


def parse_time(c: Column) -> Column:
    """ISO first, then four common layouts; null where none fits."""
    layouts = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy"]
    return F.coalesce(F.try_to_timestamp(c), *(F.try_to_timestamp(c, F.lit(x)) for x in layouts))


def price(c: Column, thousands: bool = False) -> Column:
    """The first price: ``price:`` or a currency sign, then digits.

    By default a comma takes at most two digits after it as its fraction, so
    ``$1,299`` is 129; with ``thousands`` commas group digits and it is 1299.
    """
    number = r"([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{1,2})?|[0-9]+(?:\.[0-9]{1,2})?)" if thousands else r"([0-9]+(?:[.,][0-9]{1,2})?)"
    found = F.regexp_extract(c, r"(?i)(?:price\s*:\s*[$€£]?\s*|[$€£]\s*)" + number, 1)
    return F.replace(F.nullif(found, F.lit("")), F.lit(","), F.lit("")).try_cast("double")


def mentioned_url(c: Column) -> Column:
    found = F.regexp_extract(c, r"https?://[^\s]+", 0)
    return F.nullif(F.regexp_replace(found, r"[.,!?)\]}]+$", ""), F.lit(""))


def mentioned_entity(c: Column) -> Column:
    """``~word`` first, else two joined capitalised words."""
    tilde, camel = F.regexp_extract(c, r"~(\w+)", 1), F.regexp_extract(c, r"\b([A-Z][a-z]+[A-Z][A-Za-z]+)\b", 1)
    return F.coalesce(F.nullif(tilde, F.lit("")), F.nullif(camel, F.lit("")))


def mention_term(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)\bmention(?:s|ing)?\s+([A-Za-z0-9][A-Za-z0-9 \-]*)", 1), F.lit(""))


def holds_number(answer: Column, n: Column) -> Column:
    """Whether ``n`` stands in the answer as a whole number."""
    return F.array_contains(F.regexp_extract_all(answer, F.lit(r"(\d+)"), F.lit(1)), n.cast("string"))


def is_unhelpful(c: Column) -> Column:
    out = F.coalesce(strip(c), F.lit("")) == ""
    for phrase in UNHELPFUL:
        out = out | F.lower(c).contains(phrase)
    return out


def fit_vector(c: Column, size: int = 2048) -> Column:
    """Cut or padded with zeros to ``size``."""
    v = F.coalesce(c, F.array().cast("array<float>"))
    return F.when(F.size(v) >= size, F.slice(v, 1, size)).otherwise(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), F.lit(size) - F.size(v))))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9.-]+", "_"), r"^[._]+|[._]+$", "")


def numbered(items: Column, head: str) -> Column:
    """A list as text: head, then numbered lines."""
    lines = F.transform(items, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x))
    return F.concat(F.lit(head + "\n"), F.array_join(lines, "\n"))
