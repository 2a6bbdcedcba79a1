"""Places where a model is plugged in, with offline stand-ins.

An embedder and a scorer are functions from Column to Column, so a caller passes a pandas UDF that loads its
model once per worker; a generator turns prompts into answers on the caller's side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

Embedder = Callable[[Column], Column]
Scorer = Callable[[Column, Column], Column]
Generator = Callable[[str], str]

DIMENSIONS = 64


def embed_text(text: str | None, dimensions: int = DIMENSIONS) -> list[float] | None:
    """Unit vector of signed hashed words; None for a text without words.

    A deterministic stand-in for a sentence model: likeness is shared words, not meaning.
    """
    words = (text or "").lower().split()
    if not words:
        return None
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    signs = np.where(hashes >> np.uint64(63), 1.0, -1.0)
    out = np.bincount((hashes % np.uint64(dimensions)).astype(np.int64), signs, dimensions)
    norm = float(np.linalg.norm(out))
    return (out / norm).tolist() if norm else None


@cache
def hashing_embedder(dimensions: int = DIMENSIONS) -> Embedder:
    """Embedder of ``embed_text``, in Arrow batches."""

    @F.pandas_udf(S.ArrayType(S.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: embed_text(t, dimensions)).astype(object).where(lambda s: s.notna(), None)

    return embed
