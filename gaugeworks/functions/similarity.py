"""Similarity of texts and vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, in code points; two empty texts are equal."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(F.least(F.greatest(1 - F.levenshtein(a, b) / longer, F.lit(0.0)), F.lit(1.0)))


def cosine(a: Column, b: Column) -> Column:
    """In double precision over the shorter length; 0 if either norm is 0; within [-1, 1]."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    def squares(values: Column) -> Column:
        return total(F.transform(values, lambda v: v.cast("double") * v.cast("double")))

    dot = total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    norm = F.sqrt(squares(x)) * F.sqrt(squares(y))
    return F.when(norm == 0, F.lit(0.0)).otherwise(F.greatest(F.least(dot / norm, F.lit(1.0)), F.lit(-1.0)))


def rescaled(c: Column) -> Column:
    """Cosine to [0, 1]."""
    return (c + 1) / 2


def hashing_embedder(texts: list[str], size: int = 64) -> np.ndarray:
    """A stand-in without a model: character trigrams hashed into a vector."""
    import zlib

    out = np.zeros((len(texts), size), np.float32)
    for i, t in enumerate(texts):
        t = f" {t} "
        for k in range(len(t) - 2):
            h = zlib.crc32(t[k : k + 3].encode())
            out[i, h % size] += 1 if h & 1 << 20 else -1
    return out


def embedded(text: Column, embedder: Callable[[list[str]], np.ndarray] = hashing_embedder) -> Column:
    """Vectors by an embedder that sees Arrow batches; one embedder per Python worker."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder(texts.fillna("").tolist())))

    return run(text)


def text_cosine(a: Column, b: Column, embedder: Callable[[list[str]], np.ndarray] = hashing_embedder) -> Column:
    return rescaled(cosine(embedded(a, embedder), embedded(b, embedder)))


#: Name -> function of (predicted, golden). The first is the default.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {"cosine": text_cosine, "levenshtein": levenshtein_similarity}


def measure(name: str | None = None) -> Callable[[Column, Column], Column]:
    if name is None:
        return text_cosine
    if name not in MEASURES:
        raise ValueError(f"unknown similarity measure {name!r}; known: {', '.join(MEASURES)}")
    return MEASURES[name]
