"""Confusion matrices with a column for unparsed answers, and the F1 metrics that follow from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.stats import safe_ratio

METRICS = ("f1", "confusion")


def matrix(rows: DataFrame, golden: str, predicted: str, labels: Sequence[str], strict: bool = True) -> DataFrame:
    """golden_idx, predicted_idx (null: unparsed), n: every cell of the grid, zeros too. Unknown labels raise if strict."""
    spark = rows.sparkSession
    known = F.array(*[F.lit(x) for x in labels])
    g, p = F.array_position(known, F.col(golden)), F.array_position(known, F.col(predicted))
    if strict:
        g = F.when(g > 0, g).otherwise(F.raise_error(F.concat(F.lit("unknown golden label "), F.coalesce(F.col(golden), F.lit("null")))).cast("long"))
        p = F.when(F.col(predicted).isNull() | (p > 0), p).otherwise(F.raise_error(F.concat(F.lit("unknown predicted label "), F.col(predicted))).cast("long"))
    seen = rows.select((g - 1).cast("int").alias("golden_idx"), (p - 1).cast("int").alias("predicted_idx")).groupBy("golden_idx", "predicted_idx").agg(F.count(F.lit(1)).alias("n"))
    k = len(labels)
    grid = spark.createDataFrame([(i, j) for i in range(k) for j in [*range(k), None]], "golden_idx int, predicted_idx int")  # labels squared
    cell = (grid.golden_idx == seen.golden_idx) & grid.predicted_idx.eqNullSafe(seen.predicted_idx)
    return grid.join(seen, cell, "left").select(grid.golden_idx, grid.predicted_idx, F.coalesce(seen.n, F.lit(0)).alias("n"))


def f1_scores(cells: DataFrame) -> DataFrame:
    """label_idx, support, precision, recall, f1. Support counts unparsed answers; they are nobody's false positives."""
    rows = cells.groupBy(F.col("golden_idx").alias("label_idx")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("golden_idx") == F.col("predicted_idx"), F.col("n")).otherwise(0)).alias("tp"))
    columns = cells.filter("predicted_idx is not null").groupBy(F.col("predicted_idx").alias("label_idx")).agg(F.sum("n").alias("predicted"))
    told = rows.join(columns, "label_idx").withColumns({"precision": safe_ratio(F.col("tp"), F.col("predicted")), "recall": safe_ratio(F.col("tp"), F.col("support"))})
    return told.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label_idx", "support", "precision", "recall", "f1")


def f1_metrics(cells: DataFrame) -> DataFrame:
    """f1_label_<i>, macro_f1 (over all labels, supported or not) and weighted_f1 as (metric_name, metric_value)."""
    scores = f1_scores(cells)
    single = scores.select(F.concat(F.lit("f1_label_"), "label_idx").alias("metric_name"), F.col("f1").alias("metric_value"))
    whole = scores.agg(F.avg("f1").alias("macro"), safe_ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted"))
    return single.unionByName(whole.select(F.expr("stack(2, 'macro_f1', macro, 'weighted_f1', weighted) as (metric_name, metric_value)")))


def confusion_metrics(cells: DataFrame) -> DataFrame:
    name = F.concat(F.lit("confusion_matrix_"), F.col("golden_idx"), F.lit("_"), F.coalesce(F.col("predicted_idx").cast("string"), F.lit("unparsed")))
    return cells.select(name.alias("metric_name"), F.col("n").cast("double").alias("metric_value"))


def selected(metrics: Sequence[str | dict], as_json: bool) -> list[str]:
    """Which output metrics to compute: a bare name shows in JSON only, {"name", "show": "all"} always."""
    out = []
    for m in metrics:
        name, show = (m, "json") if isinstance(m, str) else (m["name"], m.get("show", "json"))
        if name not in METRICS or show not in ("json", "all"):
            raise ValueError(f"unknown output metric {m!r}")
        if as_json or show == "all":
            out.append(name)
    return out


def output_metrics(steps: DataFrame, labels: Sequence[str], metrics: Sequence[str | dict], as_json: bool) -> DataFrame | None:
    """Derived metrics of stored step outputs; nothing is parsed unless something is asked for."""
    names = selected(metrics, as_json)
    if not names:
        return None
    parsed = steps.filter("status = 'completed'").select(F.from_json("output", "golden string, parsed_response string", {"mode": "FAILFAST"}).alias("o")).select("o.golden", "o.parsed_response")
    cells = matrix(parsed, "golden", "parsed_response", labels)
    parts = {"f1": f1_metrics, "confusion": confusion_metrics}
    out = parts[names[0]](cells)
    for n in names[1:]:
        out = out.unionByName(parts[n](cells))
    return out
