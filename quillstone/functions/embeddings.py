"""Deterministic hash embeddings, and the interface for others."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DIM = 16


SIGNS = np.where(np.arange(DIM) % 2 == 0, 1.0, -1.0)


def _digest(word: str) -> np.ndarray:
    return SIGNS * np.frombuffer(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=DIM).digest(), np.uint8) / 255.0


def hash_embedding(text: str | None, known: dict[str, np.ndarray] | None = None) -> list[float]:
    """A unit vector from the digests of the words; zeros for an empty or null text. ``known`` keeps digests between texts."""
    known = {} if known is None else known
    total = np.zeros(DIM)
    for word in (text or "").split():
        if word not in known:
            known[word] = _digest(word)
        total += known[word]
    norm = np.linalg.norm(total)
    return (np.round(total / norm, 6) if norm else total).tolist()


@F.pandas_udf(ArrayType(FloatType()))
def hash_embeddings(texts: pd.Series) -> pd.Series:
    """A distinct word is hashed once per batch."""
    known: dict[str, np.ndarray] = {}
    return texts.map(lambda t: hash_embedding(t, known))


#: Embedding models by name; register a function from Column to Column to add one.
MODELS: dict[str, Callable[[Column], Column]] = {"hash-16": hash_embeddings}


def embedded(records: DataFrame, text: Column, model: str = "hash-16") -> DataFrame:
    """``records`` with embedding_model, embedding_dim and dense_vector of ``text``."""
    if model not in MODELS:
        raise ValueError(f"unknown embedding model {model!r}; known: {sorted(MODELS)}")
    rows = records.withColumn("dense_vector", MODELS[model](text))
    return rows.withColumns({"embedding_model": F.lit(model), "embedding_dim": F.size("dense_vector")})
