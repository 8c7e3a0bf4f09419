"""Metric points: Parquet folders of each run, made visible by its commit log."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from gaugeworks.sources.commits import CommitLog
from gaugeworks.sources.tables import POINTS

_STORED = ", ".join(c for c in POINTS.split(", ") if not c.startswith("run_id"))


class MetricStore:
    """Points by run.

    mode `append` (default) keeps what earlier flushes of the run wrote; `replace` lets a flush that has points replace
    them, in one commit: a reader sees the old points or the new ones. A flush without points does nothing in either mode.
    """

    def __init__(self, spark: SparkSession, root: str, mode: str = "append"):
        if mode not in ("append", "replace"):
            raise ValueError("mode is 'append' or 'replace'")
        self.spark, self.root, self.mode = spark, root.rstrip("/"), mode
        self.log = CommitLog(spark, self.root)
        self._of_run: dict[int, DataFrame] = {}
        self._mixed: DataFrame | None = None

    @property
    def pending(self) -> DataFrame | None:
        """Points that aren't flushed, or None."""
        held = [*self._of_run.values(), *([] if self._mixed is None else [self._mixed])]
        return functools.reduce(DataFrame.unionByName, held) if held else None

    def emit(self, points: DataFrame, run_id: int | None = None) -> None:
        """Queue points (run_id, step_id, metric_name, metric_value, unit); they are stamped now and kept as a plan. run_id, if they are all of one run."""
        now = time.time_ns()
        stamp = F.timestamp_micros(F.lit(now // 1000))
        points = points.select("run_id", "step_id", "metric_name", "metric_value", "unit", stamp.alias("created_at"), (F.monotonically_increasing_id() + F.lit(now)).alias("ord"))
        if run_id is None:
            self._mixed = points if self._mixed is None else self._mixed.unionByName(points)
        else:
            self._of_run[run_id] = self._of_run[run_id].unionByName(points) if run_id in self._of_run else points

    def emit_one(self, run_id: int, name: str, value: float, unit: str | None = None, step_id: int | None = None) -> None:
        row = self.spark.createDataFrame([(run_id, step_id, name, float(value), unit)], "run_id long, step_id long, metric_name string, metric_value double, unit string")
        self.emit(row, run_id)

    def _pending_of(self, run_id: int) -> DataFrame | None:
        held = [self._of_run[run_id]] if run_id in self._of_run else []
        held += [] if self._mixed is None else [self._mixed.filter(F.col("run_id") == run_id)]
        return functools.reduce(DataFrame.unionByName, held) if held else None

    def flush(self, run_id: int, batch: str | None = None) -> None:
        """Write the run's pending points. A batch name that is committed already adds nothing, so a repeated batch counts once."""
        mine = self._pending_of(run_id)
        if mine is None:
            return
        self.write(run_id, mine, batch)
        self._of_run.pop(run_id, None)
        if self._mixed is not None:
            rest = self._mixed.filter(F.col("run_id") != run_id)
            self._mixed = rest if rest.limit(1).count() else None

    def write(self, run_id: int, points: DataFrame, batch: str | None = None) -> bool:
        """Add points in one commit; False if there are none, or the batch is there. What a failed write leaves, no commit names."""
        before = self.log.entries(run_id)
        if batch is not None and any(e.get("batch") == batch for e in before):
            return False
        path, seen = self.log.place(run_id), Observation()
        try:
            points.select(*[c.split()[0] for c in _STORED.split(", ")]).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
            some = seen.get["n"] > 0
            if some:
                self.log.commit(run_id, before, points=path, mode=self.mode, batch=batch)
        except Exception:
            self.log.files.delete(path)
            raise
        if not some:
            self.log.files.delete(path)
        return some

    def stream_sink(self, run_id: int, name: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: points (step_id, metric_name, metric_value, unit, created_at, ord) of a stream, each batch once, whatever is run again."""
        return lambda rows, number: self.write(run_id, rows, f"{name}/{number}") and None

    def points(self, run_id: int) -> DataFrame:
        """Committed points of a run; only its own files are read."""
        paths: list[str] = []
        for e in self.log.entries(run_id):
            paths = [e["points"]] if e["mode"] == "replace" else [*paths, e["points"]]
        schema = _parse_datatype_string(_STORED)
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.withColumn("run_id", F.lit(run_id).cast("long"))

    def query(self, run_id: int, aggregate_only: bool = False) -> DataFrame:
        return scan(self.points(run_id), run_id, aggregate_only)

    def sample_values(self, run_id: int, name: str | None = None) -> DataFrame:
        """Values of a sample-level metric (of all, with metric_name, if none is named), persisted first, then pending (a bag union)."""
        told, mine = self.points(run_id), self._pending_of(run_id)
        if mine is not None:
            told = told.unionByName(mine)
        told = told.filter(F.col("step_id").isNotNull())
        return told.select("metric_name", "metric_value") if name is None else told.filter(F.col("metric_name") == name).select("metric_value")


def scan(points: DataFrame, run_id: int | None = None, aggregate_only: bool = False) -> DataFrame:
    """step_id, metric_name, metric_value, unit, created_at by name, then time; points without a step are aggregates."""
    if run_id is not None:
        points = points.filter(F.col("run_id") == run_id)
    if aggregate_only:
        points = points.filter(F.col("step_id").isNull())
    ordinal = [c for c in ("ord",) if c in points.columns]
    told = points.orderBy(F.asc_nulls_last("metric_name"), F.asc_nulls_last("created_at"), *ordinal)
    return told.select("step_id", "metric_name", "metric_value", "unit", "created_at")
