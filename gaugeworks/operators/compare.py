"""Comparison of two runs: steps, outputs field by field, metric vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.json_values import field_differences
from gaugeworks.operators.latest import latest, ranked


def step_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join on step_key: presence, and whether input, status and output differ.

    Steps: step_key, input_hash, status, output, started_at, id; of repeated keys the later (started_at, id) counts. Two
    null outputs are equal, a step that one run lacks differs in everything.
    """
    columns = ("input_hash", "status", "output")

    def side(rows: DataFrame, name: str) -> DataFrame:
        rows = latest(rows, ["step_key"], ["started_at", "id"])
        return rows.select("step_key", *[F.col(c).alias(f"{c}_{name}") for c in columns], F.lit(True).alias(f"in_{name}"))

    both = side(a, "a").join(side(b, "b"), "step_key", "full_outer")
    here_a, here_b = F.coalesce("in_a", F.lit(False)), F.coalesce("in_b", F.lit(False))
    differs = {f"{c.split('_')[0]}_differs": ~(here_a & here_b) | ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in columns}
    presence = F.when(here_a & here_b, "both").when(here_a, "only_a").otherwise("only_b")
    return both.withColumns({"presence": presence, **differs}).select("step_key", "presence", "status_a", "status_b", *differs, "output_a", "output_b")


def output_differences(steps: DataFrame) -> DataFrame:
    """step_key, path, run_a, run_b for steps of both runs whose outputs differ; a missing output reads `(none)`."""
    texts = steps.filter("presence = 'both'").select("step_key", F.coalesce("output_a", F.lit("(none)")).alias("raw_a"), F.coalesce("output_b", F.lit("(none)")).alias("raw_b"))
    return field_differences(texts.filter("raw_a <> raw_b"), "raw_a", "raw_b", "step_key")


def metric_pairs(a: DataFrame, b: DataFrame, order: tuple[str, ...] = ("created_at", "ord")) -> DataFrame:
    """metric_name, position, in_a, in_b, value_a, value_b, delta (b - a): the points of both runs place by place.

    A row for each place of the longer vector; what one run lacks is null. Places are ranks over ranges of points, so a
    metric's vector is never in one task.
    """
    sides = [p.select("metric_name", F.col("metric_value").cast("double").alias("value"), *order, F.lit(i).alias("_side")) for i, p in enumerate((a, b))]
    placed = ranked(sides[0].unionByName(sides[1]), ["_side", "metric_name"], order)
    left, right = (placed.filter(F.col("_side") == i).select("metric_name", "position", F.col("value").alias(f"value_{n}"), F.lit(True).alias(f"in_{n}")) for i, n in enumerate("ab"))
    both = left.join(right, ["metric_name", "position"], "full_outer")
    here = {f"in_{n}": F.coalesce(f"in_{n}", F.lit(False)) for n in "ab"}
    return both.withColumns(here).withColumn("delta", F.col("value_b") - F.col("value_a"))


def metric_rows(pairs: DataFrame) -> DataFrame:
    """metric_name, n_a, n_b, delta_sum, unmatched, direction, same of metric_pairs().

    Direction: up, down, mixed or same by the signs of the deltas. Same: equal length and values, exact and in order; NaN
    equals nothing.
    """
    a, b, d = F.col("value_a"), F.col("value_b"), F.col("delta")
    alike = F.col("in_a") & F.col("in_b") & (a.eqNullSafe(b)) & ~(F.isnan(F.coalesce(a, F.lit(0.0))))
    told = pairs.groupBy("metric_name").agg(
        F.count_if("in_a").alias("n_a"), F.count_if("in_b").alias("n_b"), F.sum(d).alias("delta_sum"), F.count_if(d.isNull()).alias("unmatched"),
        F.coalesce(F.bool_or((d > 0) & ~F.isnan(d)), F.lit(False)).alias("_up"), F.coalesce(F.bool_or(d < 0), F.lit(False)).alias("_down"), F.bool_and(alike).alias("same"),
    )
    way = F.when(F.col("_up") & F.col("_down"), "mixed").when(F.col("_up"), "up").when(F.col("_down"), "down").otherwise("same")
    return told.select("metric_name", "n_a", "n_b", "delta_sum", "unmatched", way.alias("direction"), "same")


def metric_vectors(pairs: DataFrame) -> DataFrame:
    """metric_name, run_a, run_b, deltas as arrays, with direction and same: for showing run-level metrics, which are few points a name."""
    at = F.array_sort(F.collect_list(F.struct("position", "in_a", "in_b", "value_a", "value_b", "delta")))
    own = lambda n: F.transform(F.filter("_p", lambda p: p[f"in_{n}"]), lambda p: p[f"value_{n}"]).alias(f"run_{n}")
    told = pairs.groupBy("metric_name").agg(at.alias("_p")).select("metric_name", own("a"), own("b"), F.transform("_p", lambda p: p["delta"]).alias("deltas"))
    return told.join(metric_rows(pairs).select("metric_name", "direction", "same"), "metric_name")


def differs(steps: DataFrame, metrics: DataFrame, input_same: bool, output_same: bool) -> bool:
    """Whether two runs differ in any step, any metric, or their input or output; names, status and times don't count."""
    step = steps.agg(F.coalesce(F.bool_or(F.col("input_differs") | F.col("status_differs") | F.col("output_differs")), F.lit(False)).alias("d")).first()["d"]
    metric = metrics.agg(F.coalesce(F.bool_or(~F.col("same")), F.lit(False)).alias("d")).first()["d"]
    return step or metric or not input_same or not output_same
