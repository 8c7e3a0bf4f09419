"""Custom code: a handler gets a run and records steps, metrics and an output."""

from __future__ import annotations

import inspect
import json
import os
import time
import traceback
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import functions as F

from gaugeworks.functions.hashing import canonical
from gaugeworks.plans.evaluate import Report, _guarded
from gaugeworks.plans.store import Store, StoreError

#: Names under which an outer process hands over a run.
RUN_ID, WORKFLOW_NAME, INPUT = "GAUGEWORKS_RUN_ID", "GAUGEWORKS_WORKFLOW_NAME", "GAUGEWORKS_INPUT"


@dataclass
class Run:
    store: Store
    run_id: int

    @classmethod
    def current(cls, store: Store) -> Run:
        if RUN_ID not in os.environ:
            raise StoreError("outside of a run")
        return cls(store, int(os.environ[RUN_ID]))

    def step(self, key: str, params: Any, function: Callable[[], Any]) -> Any:
        """The function's result, stored under key; a finished step gives its stored result without a call."""
        import hashlib

        digest = hashlib.sha256(canonical(params).encode()).hexdigest()
        spark = self.store.spark
        wanted = spark.createDataFrame([(key, digest)], "step_key string, input_hash string")
        todo, reused = self.store.begin_steps(self.run_id, wanted)
        stored = reused.select("output").first()
        if stored is not None:
            return json.loads(stored["output"]) if stored["output"] is not None else None
        schema = "step_key string, output string, error string"
        began = time.perf_counter()
        try:
            value = function()
        except Exception:
            self.store.finish_steps(self.run_id, spark.createDataFrame([(key, None, traceback.format_exc())], schema))
            raise
        self.store.finish_steps(self.run_id, spark.createDataFrame([(key, json.dumps(value), None)], schema))
        self.store.metrics.emit_one(self.run_id, "latency_ms", (time.perf_counter() - began) * 1000, "ms", todo.select("step_id").first()["step_id"] if todo.limit(1).count() else self.store.steps(self.run_id).filter(F.col("step_key") == key).first()["id"])
        return value

    def emit(self, name: str, value: float, unit: str | None = None) -> None:
        """A run-level metric."""
        self.store.metrics.emit_one(self.run_id, name, value, unit)


@dataclass
class Workflow:
    name: str
    handler: Callable

    def run(self, store: Store, given: Any = None, run_id: int | None = None) -> Report:
        """The handler takes the run, or the run and the input; what it returns is the run's output."""
        if run_id is None:
            run_id = store.create_run(self.name, json.dumps(given) if given is not None else None)
        run = Run(store, run_id)

        def body():
            takes = len(inspect.signature(self.handler).parameters)
            out = self.handler(run) if takes == 1 else self.handler(run, given)
            if out is not None:
                store.set_output(run_id, json.dumps(out))

        return _guarded(store, run_id, body)


def workflow(name: str, handler: Callable) -> Workflow:
    return Workflow(name, handler)


def entrypoint(flow: Workflow, store: Store) -> Report:
    """Run with what the environment says; a run handed over by an outer process is continued."""
    given = json.loads(os.environ[INPUT]) if os.environ.get(INPUT) else None
    return flow.run(store, given, int(os.environ[RUN_ID]) if RUN_ID in os.environ else None)
