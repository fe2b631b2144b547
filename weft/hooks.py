"""Pluggable models: callables over batches as Arrow functions, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashed_embedding(texts: list[str], size: int = 64) -> list[list[float]]:
    """A stand-in: signed counts of hashed words."""
    out = []
    for t in texts:
        v = [0.0] * size
        for w in (t or "").lower().split():
            h = hashlib.md5(w.encode()).digest()
            v[h[0] % size] += 1.0 if h[1] % 2 else -1.0
        out.append(v)
    return out


def embedding(model: Callable[[list[str]], list[list[float]]] = hashed_embedding):
    """A column function text -> array<float>; a batch that fails is tried again text by text, and what still fails is null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(model(list(texts)))
        except Exception:
            out = []
            for t in texts:
                try:
                    out.append(model([t])[0])
                except Exception:
                    out.append(None)
            return pd.Series(out)

    return embed


def text_model(model: Callable[[list[str]], list[str]]):
    """A column function text -> text: rewriting, generation, description."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model(list(texts)))

    return run
