"""Text embeddings without a given model: a randomised truncated SVD of hashed n-gram counts.

A text is a row of `buckets` weights: the byte 3- to 5-grams of its folded form, hashed, each counted as 1 + log(n) times
its inverse document frequency, the row scaled to length 1. The space of the `dims` largest singular directions is found
by a block power method on a random start: a pass gives A'(A G) for the current block G, of which each task adds up its
own share, and the driver makes the block orthonormal. Two such passes and one for the small factor suffice; with the
pass for document frequencies that is four. What comes to the driver has buckets x (dims + 16) numbers, whatever the
number of texts. Sums over tasks may differ in their last bits between runs; signs and order of directions are fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAMS, MORE = (3, 4, 5), 16
BATCH = 64


@dataclass(frozen=True)
class Embedding:
    weights: np.ndarray  #: inverse document frequencies by bucket
    directions: np.ndarray  #: buckets x dims, orthonormal columns
    values: np.ndarray  #: singular values, falling


def _counts(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, occurrences) of a text's byte n-grams; lower case, blanks run together, framed by blanks."""
    raw = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode(), np.uint8).astype(np.uint64)
    found = []
    for n in GRAMS:
        if len(raw) >= n:
            h = np.full(len(raw) - n + 1, 0xCBF29CE484222325 + n, np.uint64)
            for i in range(n):
                h = (h ^ raw[i : len(raw) - n + 1 + i]) * np.uint64(0x100000001B3)
            found.append(((h ^ (h >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64))
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _rows(texts: list, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), len(weights)))
    for r, text in enumerate(texts):
        at, n = _counts(text, len(weights))
        own = (1 + np.log(n)) * weights[at]
        size = np.sqrt((own * own).sum())
        if size:
            out[r, at] = own / size
    return out


def _parts(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[np.ndarray]:
    for batch in batches:
        for low in range(0, batch.num_rows, BATCH):
            yield _rows(batch.column(0).slice(low, BATCH).to_pylist(), weights)


def _summed(texts: DataFrame, share, rows: int, columns: int) -> np.ndarray:
    """The sum over tasks of share(batches), a matrix of fixed size."""

    def run(batches):
        own = share(batches)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), *[pa.array(own[:, i]) for i in range(columns)]], names=["at", *[f"c{i}" for i in range(columns)]])

    names = [f"c{i}" for i in range(columns)]
    told = texts.mapInArrow(run, "at int" + "".join(f", {n} double" for n in names)).groupBy("at").agg(*[F.sum(n).alias(n) for n in names])
    out = np.zeros((rows, columns))
    for r in told.collect():  # `rows` rows
        out[r["at"]] = [r[n] for n in names]
    return out


def fit(texts: DataFrame, column: str, dims: int = 64, buckets: int = 4096, seed: int = 0) -> Embedding:
    """Null texts count as empty. Fewer directions if the texts have fewer."""
    texts = texts.select(column)

    def seen(batches):
        own = np.zeros((buckets + 1, 1))
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at, _ = _counts(text, buckets)
                own[at, 0] += 1
                own[buckets, 0] += 1
        return own if own[buckets, 0] else None

    frequency = _summed(texts, seen, buckets + 1, 1)[:, 0]
    n, wide = frequency[buckets], min(dims + MORE, buckets)
    weights = np.log((1 + n) / (1 + frequency[:buckets])) + 1
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, wide)))[0]

    def grown(batches):
        own, some = np.zeros((buckets, wide)), False
        for x in _parts(batches, weights):
            own, some = own + x.T @ (x @ block), True
        return own if some else None

    def squared(batches):
        own, some = np.zeros((wide, wide)), False
        for x in _parts(batches, weights):
            y = x @ block
            own, some = own + y.T @ y, True
        return own if some else None

    for _ in range(2):
        block = np.linalg.qr(_summed(texts, grown, buckets, wide))[0]
    values, turn = np.linalg.eigh(_summed(texts, squared, wide, wide))
    kept = [i for i in np.argsort(-values)[:dims] if values[i] > 1e-9]
    directions = block @ turn[:, kept]
    directions *= np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(len(kept))])  # the largest weight is positive
    return Embedding(weights, directions, np.sqrt(values[kept]))


def embedded(rows: DataFrame, column: str, model: Embedding, name: str = "embedding") -> DataFrame:
    """rows with a unit vector for each text; zeros for a text without any known direction."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH):
                part = batch.slice(low, BATCH)
                y = _rows(part[column].to_pylist(), model.weights) @ model.directions
                size = np.sqrt((y * y).sum(axis=1, keepdims=True))
                y = np.divide(y, size, out=np.zeros_like(y), where=size > 1e-12)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, name])

    return rows.mapInArrow(run, rows.select("*", F.array().cast("array<double>").alias(name)).schema)


def similarities(rows: DataFrame, a: str, b: str, model: Embedding, name: str = "similarity") -> DataFrame:
    """rows with the cosine of two texts' vectors, rescaled to 0..1 as similarity.rescaled() has it."""
    from gaugeworks.functions.similarity import rescaled

    both = embedded(embedded(rows, a, model, "_a"), b, model, "_b")
    dot = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return both.withColumn(name, rescaled(dot)).drop("_a", "_b")
