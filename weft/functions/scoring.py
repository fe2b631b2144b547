"""Boosts, chunk scores, similarity, fusion and confidence as Spark columns."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query-time boosts by category and by entity.
CATEGORY_BOOST = {"main_content": 1.0, "header_nav": 0.8, "footer": 0.7, "sidebar": 0.5, "excluded": 0.0, "ui_summary": 0.6}
ENTITY_BOOST = {
    "product": 1.3, "article_body": 1.2, "faq": 1.4, "code_example": 1.1, "table": 1.1, "card": 1.0, "image": 1.05,
    "content": 1.0, "navigation": 0.5, "footer": 0.4,
}
EXCLUDED = ("excluded", "filter", "modal", "cookie")

#: The boosts used when chunks are made.
CHUNK_CATEGORY_WEIGHT = {"main_content": 1.0, "header_nav": 0.75, "footer": 0.65, "sidebar": 0.5, "excluded": 0.0}
CHUNK_ENTITY_BOOST = {
    "product": 1.3, "article_body": 1.2, "code_example": 1.1, "table": 1.1, "list": 1.05, "card": 1.05, "content": 1.0,
    "structured_data": 1.3, "table_row": 1.4, "list_item": 1.25, "country": 1.25, "nation": 1.15, "organization": 1.1,
    "location": 1.0, "faq": 1.15, "image": 0.85, "image_description": 0.85, "summary": 0.6,
}
SINGLE_FACTS = ("table_row", "list_item", "card")

RRF_K = 60
LEAST_SIMILARITY, LEAST_FUSED, LEAST_GAP = 0.1, 0.02, 0.05


def lookup(c: Column, values: dict[str, float], unknown: float, missing: float | None = None) -> Column:
    """A constant table's value; ``unknown`` for other keys, ``missing`` for null."""
    found = F.coalesce(F.try_element_at(F.create_map(*chain(*((F.lit(k), F.lit(v)) for k, v in values.items()))), F.coalesce(c, F.lit(""))), F.lit(unknown))
    return found if missing is None else F.when(c.isNull(), F.lit(missing)).otherwise(found)


def boost(category: Column, entity: Column) -> Column:
    """Query-time: a missing category counts as main content, an unknown one half."""
    return lookup(category, CATEGORY_BOOST, 0.5, 1.0) * lookup(entity, ENTITY_BOOST, 1.0)


def retrievable(category: Column, density: Column) -> Column:
    """Not an excluded category (nor a null one), and dense enough."""
    return ~category.isin(*EXCLUDED) & (F.coalesce(density, F.lit(1.0)) >= 0.01)


def structured_boost(table: Column, listed: Column, structured: Column) -> Column:
    one = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    return F.lit(1.0) + one(table, 0.2) + one(listed, 0.15) + one(structured, 0.25)


def relevance(words: Column, depth: Column, entity: Column, category: Column, table: Column, listed: Column, images: Column, structured: Column, digits: int = 4) -> Column:
    fact = F.when(entity.isin(*SINGLE_FACTS), F.lit(1.0)).otherwise(F.least(words / F.lit(200.0), F.lit(1.0)))
    base = F.lit(0.35) * F.least(depth / F.lit(4.0), F.lit(1.0)) + F.lit(0.45) * fact + F.when(table | listed | images | structured, F.lit(0.2)).otherwise(F.lit(0.0))
    return F.round(F.least(base, F.lit(1.0)) * lookup(category, CHUNK_CATEGORY_WEIGHT, 0.5) * lookup(entity, CHUNK_ENTITY_BOOST, 1.0) * structured_boost(table, listed, structured), digits)


def quality(words: Column, blank: Column, table: Column, listed: Column, structured: Column, digits: int = 4) -> Column:
    one = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(0.5) * F.least(words / F.lit(160.0), F.lit(1.0)) + one(table, 0.2) + one(listed, 0.2) + one(structured, 0.1) + one(~blank, 0.1), F.lit(1.0)), digits)


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine similarity with a constant vector; null for a zero vector or another length."""
    q = F.array(*(F.lit(float(x)) for x in query))
    d = v.cast("array<double>")
    dot = F.aggregate(F.zip_with(d, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    own = float(np.sqrt(sum(float(x) ** 2 for x in query)))
    return F.when(F.size(v) == len(query), dot / F.nullif(norm * F.lit(own), F.lit(0.0)))


def cosine_arrow(query: list[float]):
    """The same as an Arrow function over whole batches: for long vectors, where column arithmetic is slow."""
    q = np.asarray(query, np.float64)
    own = float(np.linalg.norm(q))

    @F.pandas_udf(T.DoubleType())
    def similarity(v: pd.Series) -> pd.Series:
        out = np.full(len(v), np.nan)
        fits = [k for k, x in enumerate(v) if x is not None and len(x) == len(q)]
        if fits and own:
            m = np.stack([v.iloc[k] for k in fits]).astype(np.float64)
            norms = np.linalg.norm(m, axis=1) * own
            out[fits] = np.divide(m @ q, norms, out=np.full(len(fits), np.nan), where=norms > 0)
        return pd.Series(out).where(~np.isnan(out), None)

    return similarity


def rrf(*ranks: Column, k: int = RRF_K) -> Column:
    """Reciprocal rank fusion; a null rank adds nothing."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(F.lit(1.0) / (F.lit(float(k)) + r), F.lit(0.0))
    return out


def fused_confidence(has_lexical: Column, top: Column, gap: Column) -> Column:
    """At the usual k the last two terms cannot arise: the largest fused score is 0.0459. They are kept as defined."""
    one = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    return one(has_lexical, 0.4) + one(top > 0.05, 0.3) + one(gap > LEAST_GAP, 0.2)
