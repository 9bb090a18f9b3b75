"""Slots for models, each with a deterministic default.

A slot is a Column function. A model that is asked for must load: nothing falls back in silence, and a
mock must be asked for by name."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.rules import query_guard

DIMENSIONS = 64


def hashed_embedding(texts: list[str], dimensions: int = DIMENSIONS, n: int = 3) -> np.ndarray:
    """Unit vectors of hashed character n-grams; zeros for a text without letters or digits."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for row, text in zip(out, texts, strict=True):
        padded = f" {' '.join((text or '').lower().split())} "
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if any(map(str.isalnum, gram)):
                h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
                row[h % dimensions] += 1 if h >> 63 else -1
        norm = float(np.linalg.norm(row))
        if norm > 0:
            row /= norm
    return out


def embedder(load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None, prefix: str = "") -> Callable[[Column], Column]:
    """text -> array<float>. The model is loaded once for each worker's share of rows."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load() if load else hashed_embedding
        for texts in batches:
            yield pd.Series(list(model([prefix + (t or "") for t in texts])))

    return embed


def translator(name: str | None, load: Callable[[str], Callable] | None = None, mock: bool = False) -> Callable[[Column, str], Column]:
    """(text, language) -> text. Without a model only the mock is there, and it must be allowed."""
    if name and load:
        model = load(name)
        return lambda c, lang: F.pandas_udf(lambda s: pd.Series(model(s.tolist(), lang)), "string")(c)
    if name:
        raise ValueError(f"translation model {name} can't be loaded")
    if not mock:
        raise ValueError("no translation model; a mock must be allowed by name")
    return lambda c, lang: F.concat(F.lit(f"[{lang.upper()}] "), c)


def reranker(name: str, load: Callable[[str], Callable] | None = None) -> Callable[[Column, Column], Column] | None:
    """(query, passage) -> score; none for the heuristic, which must be named."""
    if name == "heuristic":
        return None
    if load is None:
        raise ValueError(f"reranker {name} can't be loaded")
    model = load(name)

    @F.pandas_udf("double")
    def score(queries: pd.Series, passages: pd.Series) -> pd.Series:
        true, false = model(queries.tolist(), passages.tolist())
        return pd.Series(np.asarray(true, float) - np.asarray(false, float))

    return score


def guard(name: str | None = None, load: Callable[[str], Callable[[Column], Column]] | None = None) -> Callable[[Column], Column]:
    """text -> struct(allowed, labels, reason, backend)."""
    if name is None:
        return query_guard
    if load is None:
        raise ValueError(f"guard {name} can't be loaded")
    return load(name)
