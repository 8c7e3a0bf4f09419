"""Runs, steps and events: a log of changes for each run, with latest-state views.

A change of a run is one commit (sources/commits.py). It holds the run's new row and its events as they are, for they
are few, and names a Parquet folder with the records of the steps it changes. A record is a step's whole state with a
growing number `seq` and the event the change means, so state and events become visible together or not at all. A view
reads the last snapshot's folder and those of the changes since, of its own run only, and takes each step's last record.
After `compact_after` such folders the next change is followed by a snapshot of the state.

Begin and finish are one job each: what contradicts the stored state raises in the tasks that would write, and nothing
is committed. Of two writers that change a run at once the second is refused.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from gaugeworks.operators.latest import latest
from gaugeworks.sources import tables
from gaugeworks.sources.commits import CommitConflict, CommitLog
from gaugeworks.sources.metrics import MetricStore


class StoreError(ValueError):
    pass


#: A step's record: its state, and the change that made it. An event is told unless its type is null.
RECORD = tables.STEPS + ", seq long, event string, message string, changed_at timestamp"
_TIMES = ("started_at", "finished_at", "created_at")
_CLASH, _UNKNOWN = "a step is asked for again with another input", "a result belongs to no step"


def _fields(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _micros(schema: str) -> str:
    """The schema as commits write it: times in microseconds."""
    return ", ".join(c.replace(" timestamp", " long") for c in schema.split(", "))


def _timed(path: str, schema: str) -> list[Column]:
    return [(F.timestamp_micros(f"{path}.{f}") if f in _TIMES else F.col(f"{path}.{f}")).alias(f) for f in _fields(schema)]


class Store:
    def __init__(self, spark: SparkSession, root: str, flush_mode: str = "append", compact_after: int = 16):
        self.spark, self.root, self.compact_after = spark, root.rstrip("/"), compact_after
        self.metrics = MetricStore(spark, f"{self.root}/metric_points", flush_mode)
        self.log = CommitLog(spark, f"{self.root}/runs")
        self._seq = time.time_ns()
        self._lock = threading.Lock()

    def _next(self) -> int:
        with self._lock:
            self._seq = max(self._seq + 1, time.time_ns())
            return self._seq

    # Views

    def _inline(self) -> DataFrame:
        return self.log.table(f"run struct<{_micros(tables.RUNS).replace(' ', ': ').replace(',:', ',')}>, events array<struct<{_micros(tables.EVENTS).replace(' ', ': ').replace(',:', ',')}>>, steps string, snapshot string")

    def records(self, name: str) -> DataFrame:
        """All records of all runs with their `seq`: `runs`, `steps` or `events`."""
        if name == "runs":
            return self._inline().filter("run is not null").select(*_timed("run", tables.RUNS), F.col("version").alias("seq"))
        told = self._inline().select(F.element_at(F.split("steps", "/"), -1).alias("folder")).filter("folder is not null")
        steps = self.log.data(RECORD).join(told, "folder", "left_semi")
        if name == "steps":
            return steps.select(*_fields(tables.STEPS), "seq")
        own = self._inline().select(F.explode("events").alias("e")).select(*_timed("e", tables.EVENTS), F.col("e.id").alias("seq"))
        return own.unionByName(_step_events(steps))

    def runs(self) -> DataFrame:
        return latest(self.records("runs"), ["id"], ["seq"]).drop("seq")

    def _state(self, run_id: int, entries: list[dict]) -> DataFrame | None:
        """The run's steps after the given changes; None if there were none. The folders are fixed, so later changes don't show."""
        base = next((e for e in reversed(entries) if "snapshot" in e), {"snapshot": None, "upto": 0})
        paths = [p for p in (base["snapshot"], *(e.get("steps") for e in entries if e["version"] > base["upto"])) if p]
        if not paths:
            return None
        rows = self.spark.read.schema(_parse_datatype_string(RECORD)).parquet(*paths).select(*_fields(tables.STEPS), "seq")
        return (rows if len(paths) == 1 else latest(rows, ["run_id", "step_key"], ["seq"])).drop("seq")

    def steps(self, run_id: int | None = None) -> DataFrame:
        if run_id is None:
            return latest(self.records("steps"), ["run_id", "step_key"], ["seq"]).drop("seq")
        told = self._state(run_id, self.log.entries(run_id))
        return self.spark.createDataFrame([], tables.STEPS) if told is None else told.select(*_fields(tables.STEPS))

    def list_steps(self, run_id: int) -> DataFrame:
        return self.steps(run_id).orderBy("started_at", "id")

    def events(self, run_id: int) -> DataFrame:
        """The run's events in order; only its own commits and folders are read."""
        entries = self.log.entries(run_id)
        own = [tuple(e[f] for f in _fields(tables.EVENTS)) for x in entries for e in x.get("events", ())]
        rows = self.spark.createDataFrame(own, _micros(tables.EVENTS)).withColumn("created_at", F.timestamp_micros("created_at"))
        paths = [e["steps"] for e in entries if "steps" in e]
        if paths:
            rows = rows.unionByName(_step_events(self.spark.read.schema(_parse_datatype_string(RECORD)).parquet(*paths)).drop("seq"))
        return rows.orderBy("created_at", "id")

    def workflows(self) -> DataFrame:
        folder = f"{self.root}/workflows"
        if not self.log.files.exists(folder):
            return self.spark.createDataFrame([], tables.WORKFLOWS)
        return self.spark.read.schema(_micros(tables.WORKFLOWS)).json(folder).withColumn("created_at", F.timestamp_micros("created_at"))

    def create_tables(self) -> None:
        """The store's folders where there are none yet; harmless if they are there."""
        for folder in ("runs/commits", "runs/data", "workflows"):
            fs, at = self.log.files._at(f"{self.root}/{folder}")
            fs.mkdirs(at)

    # Runs

    def _event(self, run_id: int, kind: str, message: str | None = None, data: str | None = None) -> dict:
        return {"id": self._next(), "run_id": run_id, "step_id": None, "event_type": kind, "message": message, "data": data, "created_at": time.time_ns() // 1000}

    def _row(self, entries: list[dict]) -> dict | None:
        return next((e["run"] for e in reversed(entries) if "run" in e), None)

    def event(self, run_id: int, kind: str, message: str | None = None, data: str | None = None) -> None:
        self._change(run_id, (kind, message, data))

    def _workflow(self, name: str) -> int:
        """Found or made: a workflow's name is its file."""
        import hashlib

        path = f"{self.root}/workflows/{hashlib.sha256(name.encode()).hexdigest()}.json"
        if not self.log.files.exists(path):
            self.log.files.create(path, json.dumps({"id": self._next(), "name": name, "created_at": time.time_ns() // 1000}))
        return json.loads(self.log.files.read(path))["id"]

    def create_run(self, workflow: str, input_json: str | None = None) -> int:
        run_id = self._next()
        row = dict.fromkeys(_fields(tables.RUNS)) | {"id": run_id, "workflow_id": self._workflow(workflow), "workflow_name": workflow, "status": "running", "input": input_json, "started_at": time.time_ns() // 1000}
        self.log.commit(run_id, [], run=row, events=[self._event(run_id, "run.started")])
        return run_id

    def get_run(self, run_id: int) -> Row | None:
        """The run's row with the model its input names, or None."""
        from datetime import UTC, datetime, timedelta

        row = self._row(self.log.entries(run_id))
        if row is None:
            return None
        try:
            given = json.loads(row["input"] or "null")
        except ValueError:
            given = None
        model = given.get("model") if isinstance(given, dict) else None
        at = {f: datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=row[f]) for f in _TIMES if row.get(f) is not None}
        return Row(**(row | at), model=model if isinstance(model, str) else None)

    def _change(self, run_id: int, event: tuple | None = None, steps: str | None = None, entries: list[dict] | None = None, **columns) -> None:
        """Commit a new row of the run, an event, and a folder of steps, whichever are given. Without steps, a change that was overtaken is made anew."""
        while True:
            before = self.log.entries(run_id) if entries is None else entries
            row = self._row(before)
            if row is None:
                raise StoreError(f"there is no run {run_id}")
            try:
                self.log.commit(run_id, before, run=row | columns if columns else None, events=[self._event(run_id, *event)] if event else None, steps=steps)
                break
            except CommitConflict as e:
                if entries is not None:
                    raise StoreError(f"run {run_id} was changed meanwhile") from e
        if steps is not None:
            self._compact_when_due(run_id)

    def set_output(self, run_id: int, output_json: str) -> None:
        self._change(run_id, output=output_json)

    def set_input(self, run_id: int, input_json: str) -> None:
        self._change(run_id, input=input_json)

    def complete_run(self, run_id: int) -> None:
        self._change(run_id, ("run.completed",), status="completed", finished_at=time.time_ns() // 1000, error=None)
        self.metrics.flush(run_id)

    def fail_run(self, run_id: int, error: str) -> None:
        """Also fails the run's steps that are still running, in the same commit."""
        entries = self.log.entries(run_id)
        known, path = self._state(run_id, entries), None
        if known is not None:
            open_ = known.filter("status = 'running'").withColumns({"status": F.lit("failed"), "error": F.lit("run failed"), "finished_at": F.current_timestamp()})
            path = self._write(run_id, open_, F.lit(None).cast("string"), F.lit(None).cast("string"))
        self._change(run_id, ("run.failed", error), path, entries, status="failed", finished_at=time.time_ns() // 1000, error=error)
        self.metrics.flush(run_id)

    def resume_run(self, run_id: int) -> None:
        """Running again; its output stays."""
        self._change(run_id, ("run.resumed",), status="running", finished_at=None, error=None)

    # Steps

    def _write(self, run_id: int, steps: DataFrame, event: Column, message: Column) -> str:
        """Records in a folder that no commit names yet."""
        path = self.log.place(run_id)
        rows = steps.withColumns({"seq": F.lit(self._next()), "event": event, "message": message, "changed_at": F.current_timestamp()})
        try:
            rows.select(*_fields(RECORD)).write.parquet(path)
        except Exception as e:
            self.log.files.delete(path)
            told = next((t for t in (_CLASH, _UNKNOWN) if t in str(e)), None)
            if told:
                raise StoreError(told) from e
            raise
        return path

    def begin_steps(self, run_id: int, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """wanted: step_key, input_hash and more. Returns (to execute, with step_id; reused, with their output).

        A key with two hashes, or whose stored step has another hash, is an error. Completed steps are reused; running
        ones are executed under their id, failed ones are started again under it, new ones are started. Of rows that
        share key and hash the one that is first as JSON is executed.
        """
        entries = self.log.entries(run_id)
        stored, rest = self._state(run_id, entries), [c for c in wanted.columns if c not in ("step_key", "input_hash")]
        row = F.struct(*rest) if rest else F.struct(F.lit(0))
        once = wanted.groupBy("step_key").agg(F.min("input_hash").alias("input_hash"), F.max("input_hash").alias("_other"), F.min_by(row, F.to_json(row)).alias("_row"))
        if stored is None:
            none = {"_id": "long", "_hash": "string", "_status": "string", "_output": "string", "_started": "timestamp"}
            both = once.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
        else:
            both = once.join(stored.select("step_key", F.col("id").alias("_id"), F.col("input_hash").alias("_hash"), F.col("status").alias("_status"), F.col("output").alias("_output"), F.col("started_at").alias("_started")), "step_key", "left")
        both = both.withColumn("step_id", F.coalesce("_id", F.xxhash64(F.lit(run_id), "step_key")))
        clash = ~F.col("input_hash").eqNullSafe(F.col("_other")) | (F.col("_hash").isNotNull() & ~F.col("_hash").eqNullSafe(F.col("input_hash")))
        starts = F.col("_status").isNull() | (F.col("_status") == "failed")
        start = both.filter(F.when(clash, F.raise_error(F.lit(_CLASH)).cast("boolean")).otherwise(starts)).select(
            F.col("step_id").alias("id"), F.lit(run_id).alias("run_id"), "step_key", "input_hash", F.lit("running").alias("status"), F.lit(None).cast("string").alias("output"),
            F.lit(None).cast("string").alias("error"), F.coalesce("_started", F.current_timestamp()).alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), "_id",
        )
        path = self._write(run_id, start, F.lit("step.started"), F.concat(F.when(F.col("_id").isNull(), "Started step ").otherwise("Retried step "), "step_key"))
        self._change(run_id, steps=path, entries=entries)
        shown = ["step_key", "input_hash", *[F.col(f"_row.`{c}`") for c in rest]]
        todo = both.filter("_status is null or _status <> 'completed'").select(*shown, "step_id").select(*[F.col(f"`{c}`") for c in wanted.columns], "step_id")
        reused = both.filter("_status = 'completed'").select(*shown, F.col("_output").alias("output"))
        return todo, reused.select(*[F.col(f"`{c}`") for c in wanted.columns], "output")

    def finish_steps(self, run_id: int, results: DataFrame) -> None:
        """results: step_key and output, or error where it isn't null. An unknown step is an error; of repeated results a failure counts, then the last output."""
        entries = self.log.entries(run_id)
        known = self._state(run_id, entries)
        if known is None:
            known = self.spark.createDataFrame([], tables.STEPS)
        told = results.groupBy("step_key").agg(F.max(F.struct("error", "output")).alias("_r"))
        done = told.join(known, "step_key", "left").withColumn("id", F.when(F.col("id").isNull(), F.raise_error(F.lit(_UNKNOWN)).cast("long")).otherwise(F.col("id")))
        failed = F.col("_r.error").isNotNull()
        done = done.withColumns({"status": F.when(failed, "failed").otherwise("completed"), "output": F.when(~failed, F.col("_r.output")), "error": F.col("_r.error"), "finished_at": F.current_timestamp()})
        path = self._write(run_id, done, F.concat(F.lit("step."), "status"), F.when(F.col("status") == "failed", F.col("error")).otherwise(F.concat(F.lit("Completed step "), F.col("id").cast("string"))))
        self._change(run_id, steps=path, entries=entries)

    def _compact_when_due(self, run_id: int) -> None:
        entries = self.log.entries(run_id)
        since = next((e["upto"] for e in reversed(entries) if "snapshot" in e), 0)
        if sum("steps" in e and e["version"] > since for e in entries) >= self.compact_after:
            self.compact(run_id)

    def compact(self, run_id: int) -> None:
        """Write the steps' state into one folder, which readers take in place of those before. Events stay where they are."""
        entries = self.log.entries(run_id)
        known = self._state(run_id, entries)
        if known is None:
            return
        path = self._write(run_id, known, F.lit(None).cast("string"), F.lit(None).cast("string"))
        try:
            self.log.commit(run_id, entries, snapshot=path, upto=entries[-1]["version"])
        except CommitConflict:
            self.log.files.delete(path)  # a later change compacts


def _step_events(records: DataFrame) -> DataFrame:
    """The events that records of steps tell."""
    told = records.filter("event is not null")
    return told.select(F.xxhash64("id", "event", "seq").alias("id"), "run_id", F.col("id").alias("step_id"), F.col("event").alias("event_type"), "message", F.lit(None).cast("string").alias("data"), F.col("changed_at").alias("created_at"), "seq")


def list_runs(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Newest first, with the number of steps (0 too) and the duration of finished ones. Steps are counted before they are joined."""
    n = steps.groupBy("run_id").agg(F.count(F.lit(1)).alias("samples"))
    told = runs.join(n, runs["id"] == n["run_id"], "left").select(runs["*"], F.coalesce("samples", F.lit(0)).alias("samples"))
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / F.lit(1e6)
    return told.withColumn("duration_s", seconds).orderBy(F.desc("started_at"), F.desc("id"))


def sample_objects(steps: DataFrame, points: DataFrame) -> DataFrame:
    """step_key and one JSON object per sample: the output's fields, overridden by the step's own, and its metrics."""
    from gaugeworks.operators.latest import last_values

    of_step = last_values(points.filter("step_id is not null"), ["step_id"], "metric_name", "metric_value", ["created_at", "ord"])
    told = steps.join(of_step, steps["id"] == of_step["step_id"], "left")
    v = F.try_parse_json("output")
    fields = F.coalesce(F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
    own = {"step_key": F.col("step_key"), "status": F.col("status"), "input_hash": F.col("input_hash"), "started_at": F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
           "finished_at": F.date_format("finished_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "error": F.col("error"), "metrics": F.to_json(F.coalesce("metrics", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))))}
    kept = F.map_filter(fields, lambda k, _: ~k.isin(*own))
    values = [F.struct(F.lit(k).alias("key"), (F.try_parse_json(c) if k == "metrics" else F.try_parse_json(F.to_json(F.array(c))).cast("array<variant>")[0]).alias("value")) for k, c in own.items()]
    mine = F.filter(F.array(*values), lambda x: ~x.key.isin("error", "finished_at") | (F.to_json(x["value"]) != "null"))
    return told.select("step_key", F.to_json(F.map_concat(kept, F.map_from_entries(mine))).alias("sample"))


def event_states(events: DataFrame, order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """The status that the event log implies for each run."""
    last = events.filter("event_type like 'run.%'").groupBy("run_id").agg(F.max_by("event_type", F.struct(*order)).alias("last"))
    return last.select("run_id", F.when(F.col("last").isin("run.started", "run.resumed"), "running").otherwise(F.substring_index("last", ".", -1)).alias("status"))
