"""Embedding whitening: principal components by Spark MLlib's computeSVD, scaled to unit variance.

A component c of a vector is the integer floor(256 * c). The fit list has each distinct integer vector once, with n
vectors and sums S by dimension, all exact. Its rows less S / n, in the JVM, are a RowMatrix whose computeSVD gives unit
right singular vectors v and singular values s; with divisor n the eigenvalues of the covariance are s^2 / n, and a
vector's whitened values are (x - S / n) . v / sqrt(s^2 / n). The total variance comes apart from that, as the exact sum
of sum_d (n * x_d - S_d)^2 over the fit list, divided by n^3. The covariance of the whitened fit list, by Spark's own
centred moments, is held against the identity.

A pass over the table makes the fit list (equal vectors are folded in the tasks that read them), which is written; sums,
decomposition and moments read it. The driver holds vectors of one length and a matrix of length x components.

Cases: rows whose vector is null or has null or non-finite entries are dropped; repeated rows and equal vectors count
once in the fit list and are all in the result. Components without variance aren't whitened, so one distinct vector, or
none, gives no rows, and there are fewer than `components` if the rank is lower. Vectors of another length than the
commonest aren't in the fit list and keep one row with null component, deviation and whitened. A deviation beyond a long
is null. Entries of 2^45 or more raise. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from gaugeworks.llm.common import materialise, released
from gaugeworks.llm.vectors import dimension, embeddings, matrix, usable

COMPONENTS, SCALE = 4, 256
LARGEST = 2**53


def integers(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(values * SCALE)
    if scaled.size and np.abs(scaled).max() >= LARGEST:
        raise ValueError("an entry of 2^45 or more has no exact integer here")
    return scaled.astype(np.int64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """sum over dimensions of (n * x - S)^2, exact."""
    most = max([0, *map(abs, sums)]) + n * (int(np.abs(x).max()) if x.size else 0)
    kind = np.int64 if most * most * max(1, x.shape[1]) < 2**63 else object
    apart = n * x.astype(kind) - np.array(sums, dtype=kind)
    return (apart * apart).sum(axis=1).tolist()


def _fit_list(rows: DataFrame, dims: int) -> DataFrame:
    """x: each distinct integer vector."""

    @released
    def scaled(batches):
        for batch in batches:
            x = integers(matrix(batch["vec"], dims)[1])
            offsets = np.arange(len(x) + 1, dtype=np.int32) * dims
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1)))], names=["x"])

    return rows.select("vec").mapInArrow(scaled, "x array<long>").distinct()


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """n and the exact sums by dimension: each task's as decimal text, whole numbers of any size."""

    @released
    def added(batches):
        n, total = 0, [0] * dims
        for batch in batches:
            x = matrix_of(batch["x"], dims)
            high, low = x >> 26, x & (2**26 - 1)  # sums of both parts fit 64 bits
            n += len(x)
            total = [t + (int(h) << 26) + int(l) for t, h, l in zip(total, high.sum(axis=0), low.sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n] * dims, "at": pa.array(range(dims), pa.int32()), "total": [str(t) for t in total]})

    told = fit.mapInArrow(added, "n long, at int, total string").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")).collect()
    sums = {r["at"]: int(r["total"]) for r in told}  # one row a dimension
    return (told[0]["n"] if told else 0), [sums.get(i, 0) for i in range(dims)]


def matrix_of(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of longs, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def components(fit: DataFrame, n: int, sums: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension x k unit eigenvectors, k eigenvalues) of the covariance with divisor n, falling, those without variance left out."""
    centre = F.array(*[F.lit(s / n) for s in sums])
    centred = fit.select(array_to_vector(F.zip_with("x", centre, lambda a, b: a - b)).alias("row"))
    # All singular values are asked for: Spark then decomposes the Gram matrix itself instead of iterating to 1e-10.
    told = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "row"), n, len(sums)).computeSVD(len(sums))
    values = np.array(told.s.toArray()) ** 2 / n
    some = np.flatnonzero(values > 1e-9)[:most]
    return told.V.toArray()[:, some], values[some]


def projected(values: np.ndarray, n: int, sums: list[int], vectors: np.ndarray, eigen: np.ndarray) -> np.ndarray:
    return (values - np.array([s / n for s in sums])) @ vectors / np.sqrt(eigen)


def whitening(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error. rows: vec_id, embedding."""
    kept = usable(rows, "vec_id")
    schema = StructType([kept.schema["vec_id"], StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType())])
    dims = dimension(kept)
    if not dims:
        return rows.sparkSession.createDataFrame([], schema)
    fit = materialise(_fit_list(kept, dims), "whitening-fit")
    n, sums = _sums(fit, dims)
    if n < 2:
        return rows.sparkSession.createDataFrame([], schema)
    vectors, eigen = components(fit, n, sums, most)
    k = len(eigen)

    @released
    def measured(batches):
        for batch in batches:
            x = matrix_of(batch["x"], dims)
            w = projected(x, n, sums, vectors, eigen)
            yield pa.RecordBatch.from_arrays([pa.array(map(str, deviations(x, n, sums)), pa.string()), *[pa.array(w[:, i]) for i in range(k)]], names=["deviation", *[f"w{i}" for i in range(k)]])

    pairs = list(combinations_with_replacement(range(k), 2))
    total = F.sum(F.col("deviation").cast(DecimalType(38, 0))).cast("string").alias("total")
    told = fit.mapInArrow(measured, "deviation string" + "".join(f", w{i} double" for i in range(k))).agg(total, *[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    identity = max((abs(told[f"c{i}_{j}"] - (i == j)) for i, j in pairs), default=0.0)
    trace = int(told["total"]) / n**3
    explained = [e / trace for e in eigen.tolist()]

    @released
    def whitened(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                whole, values = matrix(part["vec"], dims)
                x = integers(values)
                w = projected(x, n, sums, vectors, eigen)
                apart = [d if d < 2**63 else None for d in deviations(x, n, sums)]
                yield _rows(part["vec_id"].filter(pa.array(whole)), np.tile(np.arange(1, k + 1), len(x)), k, apart, w.reshape(-1), explained * len(x))
                odd = part["vec_id"].filter(pa.array(~whole))
                if len(odd):
                    yield _rows(odd, [None] * len(odd), 1, [None] * len(odd), [None] * len(odd), [None] * len(odd))

    def _rows(ids, component, times, apart, w, share):
        each = pa.array(np.repeat(np.arange(len(ids)), times))
        columns = [ids.take(each), pa.array(component, pa.int32()), pa.array([n] * len(each), pa.int64()), pa.array(apart, pa.int64()).take(each), pa.array(w, pa.float64()), pa.array(share, pa.float64()), pa.array([identity] * len(each), pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(whitened, schema)


def op13_whitening(spark, sf_dir):
    return whitening(embeddings(spark, sf_dir))
