"""Model stages: embedders and scorers, pluggable, with deterministic stand-ins that need no weights."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 64
WORD = re.compile(r"[^\W_]+")


def hashed_embedding(texts: list[str | None], dimensions: int = DIMENSIONS, role: str = "document") -> np.ndarray:
    """Counts of hashed words; queries and documents differ only in that a query's words count once.

    A word's md5 gives its dimension (first byte) and its sign (second byte), so that any engine can make the same vectors.
    """
    out = np.zeros((len(texts), dimensions), np.float32)
    for i, text in enumerate(texts):
        words = WORD.findall((text or "").lower())
        for w in set(words) if role == "query" else words:
            at, sign = _place(w)
            out[i, at % dimensions] += sign
    return out


@lru_cache(maxsize=200_000)
def _place(word: str) -> tuple[int, int]:
    h = hashlib.md5(word.encode(), usedforsecurity=False).digest()
    return h[0], 1 if h[1] < 128 else -1


def embedder(load: Callable[[], Callable[[list[str | None]], np.ndarray]] | None = None, role: str = "document") -> Callable[[Column], Column]:
    """A column function from text to array<float>. ``load`` is called once for each worker and gives the model.

    A vector with NaN becomes zeros, which the search leaves out.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load() if load else lambda texts: hashed_embedding(texts, role=role)
        for texts in batches:
            vectors = np.nan_to_num(model(texts.tolist()), nan=0.0)
            yield pd.Series(list(vectors.astype(np.float32)))

    return embed


def scorer(load: Callable[[], Callable[[list[str], list[str]], np.ndarray]] | None = None) -> Callable[[Column, Column], Column]:
    """A column function from query and text to a logit. The stand-in takes the share of the query's words, centred."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load() if load else None
        for queries, texts in batches:
            if model:
                yield pd.Series(np.asarray(model(queries.tolist(), texts.tolist()), float))
                continue
            shares = [len(set(q.lower().split()) & set(t.lower().split())) / max(1, len(set(q.lower().split()))) if q and t else 0.0 for q, t in zip(queries, texts)]
            yield pd.Series(np.array(shares) * 6 - 3)

    return score
