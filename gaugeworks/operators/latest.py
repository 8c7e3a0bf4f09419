"""Latest-state views over append-only records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.session import written


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row that is last by `order`. One aggregate that combines before it shuffles, no window."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def last_values(points: DataFrame, key: Sequence[str], name: str, value: str, order: Sequence[str]) -> DataFrame:
    """Per key a map name -> value, the last of repeated names."""
    single = points.groupBy(*key, name).agg(F.max_by(value, F.struct(*order)).alias("_v"))
    return single.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(name, "_v"))).alias("metrics"))


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """rows with a dense 0-based place within their group (`by`, none for all rows) in `order`; null keys are a group.

    No task holds a group: rows are dealt by ranges of (group, order) and written with the number of their range, each
    range numbers its part of a group, and the parts' sizes, added up in the order of ranges, shift it. Ties stay in one
    range, in any order.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    placed = written(rows.withColumn("_g", group).repartitionByRange("_g", *order).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = placed.groupBy("_g", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("_g", "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_g", "_part").orderBy(*order))
    return placed.join(starts, ["_g", "_part"]).withColumn(name, (F.col("_start") + nth - 1).cast("long")).drop("_g", "_part", "_start")


def indexed(rows: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """A dense 0-based index in global order, without one task that holds all rows."""
    return ranked(rows, [], order, name)


def page(rows: DataFrame, order: Sequence[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows [offset, offset + limit) in order."""
    if limit is not None and limit < 1:
        raise ValueError("a limit is at least 1")
    rows = rows.orderBy(*order).offset(offset) if offset else rows.orderBy(*order)
    return rows.limit(limit) if limit is not None else rows
