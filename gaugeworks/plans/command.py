"""Running an evaluation by its name."""

from __future__ import annotations

import json
import os
import subprocess

from pyspark.sql import DataFrame

from gaugeworks.plans.evaluate import BUILTINS, Report, _guarded, run_nocode
from gaugeworks.plans.store import Store, StoreError
from gaugeworks.plans.workflow import INPUT, RUN_ID, WORKFLOW_NAME
from gaugeworks.sources.config import Evaluation, assembled
from gaugeworks.sources.datasets import Catalog, effective_limit


def rows_of(catalog: Catalog, table: dict | str, limit: int | None = None) -> tuple[DataFrame, int]:
    """A configured dataset's rows, and how many of them are wanted."""
    table = {"name": table} if isinstance(table, str) else table
    source = table["name"] if "://" in table["name"] else f"hf://{table['name']}"
    at = catalog.resolved(source, table.get("config_name"), table.get("split"), table.get("revision"))
    n = effective_limit(limit, catalog.total_rows(at))
    return catalog.rows(at, n), n


def run(store: Store, name: str, evaluations: dict[str, Evaluation], given: dict | None = None, rows: DataFrame | None = None, catalog: Catalog | None = None, order: list[str] | None = None, run_id: int | None = None) -> Report:
    """A configured evaluation, else a built-in one, else an error. `rows` replaces the configured dataset."""
    found = evaluations.get(name)
    if found is None and name not in BUILTINS:
        raise StoreError(f"there is no evaluation {name!r}; there are {', '.join(sorted({*evaluations, *BUILTINS}))}")
    if found is None:
        return BUILTINS[name](store, rows, **(given or {}), run_id=run_id)
    found.validate()
    params, _ = assembled(found, given)
    if found.kind == "custom_code":
        return _command(store, name, params, run_id)
    if rows is None:
        rows, params["limit"] = rows_of(catalog, params["dataset"], params.get("limit"))
    if found.kind == "builtin":
        return BUILTINS[params.pop("builtin", name)](store, rows, run_id=run_id, **params)
    with open(params["prompt_template_file"], encoding="utf-8") as f:
        prompt = f.read()
    return run_nocode(store, name, rows, found.style, prompt, order or rows.columns[:1], params.get("model"), params.get("limit"), run_id=run_id)


def _command(store: Store, name: str, params: dict, run_id: int | None) -> Report:
    """A command of its own; it gets the run by the environment, and its exit code decides the status."""
    given = {k: v for k, v in params.items() if k != "command"}
    run_id = run_id if run_id is not None else store.create_run(name, json.dumps(given))

    def body():
        env = os.environ | {RUN_ID: str(run_id), WORKFLOW_NAME: name, INPUT: json.dumps(given)}
        done = subprocess.run(params["command"], env=env, capture_output=True, text=True, check=False)
        if done.returncode:
            raise StoreError((done.stderr or f"exit code {done.returncode}").strip().splitlines()[-1])

    return _guarded(store, run_id, body)
