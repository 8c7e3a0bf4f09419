"""Reports as JSON and as text. Only what a report shows comes to the driver: a run's row, its metrics, one page of samples."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import duration_text, number_text, numbers_text, timestamp_text


def json_rows(rows: DataFrame) -> DataFrame:
    """One JSON object per row, nulls kept; timestamps as the engine writes them."""
    shown = [timestamp_text(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in rows.schema.fields]
    return rows.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("json"))


def listed(runs: DataFrame) -> DataFrame:
    """id, name, status, samples, created, duration as text; runs that go on have no duration."""
    return runs.select("id", F.col("workflow_name").alias("name"), "status", "samples", timestamp_text(F.col("started_at")).alias("created"), duration_text(F.col("started_at"), F.col("finished_at")).alias("duration"))


def metric_table(points: DataFrame) -> DataFrame:
    """metric_name and its value with the unit."""
    return points.select("metric_name", F.concat_ws(" ", number_text(F.col("metric_value")), F.col("unit")).alias("value"))


def metric_map(points: DataFrame) -> DataFrame:
    """One map of names to values; the last of a name wins."""
    last = points.groupBy("metric_name").agg(F.max_by("metric_value", "created_at").alias("v"))
    return last.agg(F.map_from_entries(F.collect_list(F.struct("metric_name", "v"))).alias("metrics"))


def comparison_table(metrics: DataFrame) -> DataFrame:
    return metrics.select("metric_name", numbers_text(F.col("run_a")).alias("run_a"), numbers_text(F.col("run_b")).alias("run_b"), numbers_text(F.col("deltas"), True).alias("delta"), "direction")


def shown_json(told: dict[str, DataFrame], samples: int | None = None) -> dict:
    """What evaluate.shown() tells, as one object; `samples` bounds how many of them come along."""
    run = json.loads(json_rows(told["run"]).first()["json"])
    page = told["samples"].orderBy("step_key")
    page = page if samples is None else page.limit(samples)
    return {"run": run, "metrics": [json.loads(r["json"]) for r in json_rows(told["metrics"]).collect()], "samples": [json.loads(r["sample"]) for r in page.collect()]}


def compared_json(told: dict) -> dict:
    """What evaluate.compared() tells, as one object: differing steps only."""
    steps = told["steps"].filter("input_differs or status_differs or output_differs").orderBy("step_key")
    return {
        "differs": told["differs"], "warning": told["warning"],
        "steps": [json.loads(r["json"]) for r in json_rows(steps).collect()],
        "outputs": [r.asDict() for r in told["outputs"].orderBy("step_key", "path").collect()],
        "metrics": [json.loads(r["json"]) for r in json_rows(told["metrics"].orderBy("metric_name")).collect()],
    }


def exit_code(told: dict) -> int:
    """1 if the runs differ, as a comparison in a script wants it."""
    return int(told["differs"])
