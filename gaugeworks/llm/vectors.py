"""What the operators on embeddings share: usable rows, their length, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embeddings(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def usable(rows: DataFrame, *columns: str) -> DataFrame:
    """The named columns and `vec`, the embedding, of rows whose vector isn't null and has only finite components."""
    c = F.col("embedding")
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(c.isNotNull() & ~bad).select(*columns, c.alias("vec"))


def dimension(rows: DataFrame) -> int | None:
    """The commonest length of a vector, the longer one of ties; None for no rows."""
    told = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return None if told is None else told["d"]


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(which lists have `dims` items, their values as a matrix of doubles)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    whole = pc.equal(pc.list_value_length(column), dims)
    values = column.filter(whole).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return whole.to_numpy(zero_copy_only=False), values.reshape(-1, dims)
