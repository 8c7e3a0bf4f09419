"""Evaluations as one lazy plan: prepare, render, sample, parse, score, then steps, metrics and reports."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import hashing, similarity, text
from gaugeworks.operators import compare as cmp
from gaugeworks.operators import confusion, embedding, prepare, sampling, stats, template
from gaugeworks.operators.latest import indexed
from gaugeworks.plans.store import Store, StoreError, list_runs, sample_objects
from gaugeworks.sources.config import Style


@dataclass
class Report:
    """What a run leaves: its id, its run-level metrics by name, and its output."""

    run_id: int
    metrics: dict[str, float]
    output: dict


def prepared(rows: DataFrame, style: Style, index: str = "row_index") -> DataFrame:
    """rows with golden, choices (array of label and text, or null) and labels."""
    style.validate()
    i = F.col(index)
    if style.kind == "exact_match":
        golden = F.coalesce(F.col(f"`{style.answer_column}`").cast("string"), F.raise_error(F.concat(F.lit("row "), i.cast("string"), F.lit(": golden is missing"))).cast("string"))
        return rows.withColumns({"golden": golden, "choices": F.lit(None).cast("array<" + prepare.CHOICE + ">"), "labels": F.lit(None).cast("array<string>")})
    if style.choice_columns:
        choices = prepare.choices_from_columns(style.choice_columns)
    else:
        column = rows.schema[style.choice_column].dataType.typeName()
        source = F.col(f"`{style.choice_column}`")
        choices = source.cast("array<string>") if column == "array" else prepare.choices_from_json(source if column == "string" else F.to_json(source), style.labels, i)
    rows = rows.withColumn("_choices", prepare.checked_choices(choices, style.labels, i))
    n = F.size("_choices")
    if style.index_column is not None:
        correct = prepare.index_answer(F.col(f"`{style.index_column}`"), n, style.index_base, i)
    elif style.label_column is not None:
        correct = prepare.label_answer(F.col(f"`{style.label_column}`"), style.labels, n, i)
    else:
        correct = prepare.column_answer(style.correct_column, style.choice_columns)
    seed = F.col(f"`{style.seed_column}`") if style.seed_column else None
    told = rows.withColumn("_p", prepare.labelled(F.col("_choices"), correct, style.labels, seed))
    return told.withColumns({"golden": F.col("_p.golden"), "choices": F.col("_p.choices"), "labels": F.transform("_p.choices", lambda c: c["label"])}).drop("_p", "_choices")


def scored(rows: DataFrame, style: Style) -> DataFrame:
    """rows with response to rows with parsed_response and is_correct."""
    if style.kind == "exact_match":
        return rows.withColumns({"parsed_response": text.utrim(F.col("response")), "is_correct": text.exact_match(F.col("response"), F.col("golden"))})
    told = rows.withColumn("parsed_response", text.choice_label(F.col("response"), F.col("labels")))
    return told.withColumn("is_correct", text.label_match(F.col("parsed_response"), F.col("golden")))


def _execute(store: Store, run_id: int, ready: DataFrame, answer: Callable[[DataFrame], DataFrame], fields: list[str]) -> DataFrame:
    """Steps of `ready` (step_key, input_hash, ...) that aren't done are executed and stored; returns all outputs of the run's keys."""
    todo, _ = store.begin_steps(run_id, ready)
    results = answer(todo).withColumn("output", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    path = f"{store.root}/results/{run_id}-{store._next()}"
    results.select("step_key", "step_id", "output", "is_correct", "parsed_response", "latency_ms").write.parquet(path)  # a sampler runs once
    results = store.spark.read.parquet(path)
    store.finish_steps(run_id, results.select("step_key", "output", F.lit(None).cast("string").alias("error")))
    sample = F.expr("stack(3, 'latency_ms', latency_ms, 'is_correct', cast(is_correct as double), 'response_parsed', cast(parsed_response is not null as double)) as (metric_name, metric_value)")
    store.metrics.emit(results.select(F.lit(run_id).cast("long").alias("run_id"), F.col("step_id"), sample).withColumn("unit", F.when(F.col("metric_name") == "latency_ms", "ms")), run_id)
    return store.steps(run_id).filter("status = 'completed'")


def _run_metrics(store: Store, run_id: int, told: DataFrame) -> None:
    """Run-level points from (metric_name, metric_value, unit) rows."""
    store.metrics.emit(told.select(F.lit(run_id).cast("long").alias("run_id"), F.lit(None).cast("long").alias("step_id"), "metric_name", "metric_value", "unit"), run_id)


def _latencies(store: Store, run_id: int) -> DataFrame:
    return stats.long_metrics(stats.summary(store.metrics.sample_values(run_id, "latency_ms"), "metric_value"), stats.LATENCY_METRICS, unit="ms")


def _guarded(store: Store, run_id: int, body: Callable[[], None]) -> Report:
    try:
        body()
    except Exception as e:
        store.fail_run(run_id, str(e).splitlines()[0][:1000] if str(e) else type(e).__name__)
        raise
    store.complete_run(run_id)
    points = store.metrics.query(run_id, aggregate_only=True).collect()  # run-level points only
    return Report(run_id, {r["metric_name"]: r["metric_value"] for r in points}, json.loads(store.get_run(run_id)["output"] or "{}"))


def run_nocode(store: Store, workflow: str, rows: DataFrame, style: Style, prompt: str, order: list[str], model: str | dict | None = None, limit: int | None = None, seed: str = "", run_id: int | None = None) -> Report:
    """A no-code evaluation. With run_id, that run is resumed: finished steps aren't executed again."""
    from gaugeworks.sources.datasets import effective_limit

    spec = sampling.model_spec(model)
    chosen = rows.orderBy(*order).limit(effective_limit(limit, None)) if limit is not None else rows
    if run_id is None:
        run_id = store.create_run(workflow, json.dumps({"model": spec.display, "limit": limit}))
    else:
        resume(store, run_id)

    def body():
        ready = prepared(indexed(chosen, order), style)
        ready = template.render(ready, prompt, "choices" if style.kind == "multiple_choice" else None)
        ready = ready.withColumns({"step_key": hashing.row_key(F.col("row_index")), "input_hash": hashing.choice_input_hash(F.col("prompt"), F.col("golden"), F.lit(spec.display), F.lit(workflow))})
        ready = ready.withColumn("input", F.col("prompt"))
        labels = "labels" if style.kind == "multiple_choice" else None
        done = _execute(store, run_id, ready, lambda r: scored(sampling.sampled(r, "prompt", spec, labels, seed), style), ["input", "response", "parsed_response", "golden", "is_correct"])
        told = done.select(F.from_json("output", "is_correct boolean").alias("o")).select("o.is_correct")
        accuracy = stats.accuracy(told, "is_correct")
        _run_metrics(store, run_id, stats.long_metrics(accuracy, {"accuracy": "accuracy"}))
        _run_metrics(store, run_id, _latencies(store, run_id))
        store.set_output(run_id, json.dumps({"samples_completed": done.count()}))

    return _guarded(store, run_id, body)


def run_similarity(store: Store, rows: DataFrame, question: str, answer: str, order: list[str], measure: str | None = None, model: str | dict | None = None, limit: int | None = None, run_id: int | None = None, workflow: str = "similarity") -> Report:
    """Responses scored by their similarity to the answer."""
    spec, compute = sampling.model_spec(model), similarity.measure(measure)
    chosen = rows.orderBy(*order).limit(limit) if limit is not None else rows
    if run_id is None:
        run_id = store.create_run(workflow, json.dumps({"model": spec.display, "num_samples": limit}))
    else:
        resume(store, run_id)

    def body():
        ready = indexed(chosen, order).withColumns({"input": F.col(question).cast("string"), "golden": F.col(answer).cast("string")})
        ready = ready.withColumns({"step_key": hashing.row_key(F.col("row_index")), "input_hash": hashing.similarity_input_hash(F.col("input"))})
        if measure in (None, "cosine"):  # fitted to what is given, so that a resumed run measures alike
            model = embedding.fit(ready.select(F.col("golden").alias("text")).unionByName(ready.select(F.col("input").alias("text"))), "text")
            compared_ = lambda r: embedding.similarities(r, "response", "golden", model)
        else:
            compared_ = lambda r: r.withColumn("similarity", compute(F.col("response"), F.col("golden")))
        score = lambda r: compared_(sampling.sampled(r, "input", spec)).withColumns({"is_correct": F.lit(None).cast("boolean"), "parsed_response": F.col("response")})
        done = _execute(store, run_id, ready, score, ["input", "response", "golden", "similarity"])
        told = done.select(F.from_json("output", "similarity double").alias("o")).select("o.similarity")
        _run_metrics(store, run_id, stats.long_metrics(stats.summary(told, "similarity"), stats.SIMILARITY_METRICS))
        store.set_output(run_id, json.dumps({"samples_completed": done.count()}))

    return _guarded(store, run_id, body)


def run_biomedical(store: Store, rows: DataFrame, json_column: str = "json", model: str | dict | None = None, run_id: int | None = None, workflow: str = "biomedical") -> Report:
    """yes/no/maybe questions with a context."""
    spec = sampling.model_spec(model)
    if run_id is None:
        run_id = store.create_run(workflow, json.dumps({"model": spec.display}))
    else:
        resume(store, run_id)

    def body():
        ready = prepare.question_rows(rows, json_column).withColumn("prompt", template.biomedical_prompt(F.col("question"), F.col("context")))
        ready = ready.withColumns({"input": F.col("prompt"), "golden": F.col("gold_answer"), "step_key": hashing.eval_key(F.col("sample_id")), "input_hash": hashing.biomedical_input_hash(F.col("prompt"), F.lit(spec.display), F.lit(spec.provider))})

        def answer(r):
            r = sampling.sampled(r, "prompt", spec, list(text.SHORT_LABELS))
            r = r.withColumn("parsed_response", text.short_label(F.col("response")))
            return r.withColumn("is_correct", text.label_match(F.col("parsed_response"), F.col("golden")))

        done = _execute(store, run_id, ready, answer, ["input", "response", "parsed_response", "golden", "is_correct"])
        told = done.select(F.from_json("output", "is_correct boolean").alias("o")).select("o.is_correct")
        _run_metrics(store, run_id, stats.long_metrics(stats.accuracy(told, "is_correct"), {n: n for n in ("accuracy", "correct_count", "total_count")}))
        store.set_output(run_id, json.dumps({"samples_completed": done.count()}))

    return _guarded(store, run_id, body)


#: Built-in evaluations by name.
BUILTINS: dict[str, Callable[..., Report]] = {"similarity": run_similarity, "biomedical": run_biomedical, "custom_nocode": run_nocode}


def resume(store: Store, run_id: int) -> None:
    row = store.get_run(run_id)
    if row is None:
        raise StoreError(f"there is no run {run_id}")
    if row["status"] == "completed":
        raise StoreError("a completed run can't be resumed")
    store.resume_run(run_id)


def runs_listed(store: Store) -> DataFrame:
    return list_runs(store.runs(), store.steps())


def shown(store: Store, run_id: int, labels: list[str] | None = None, metrics: list = (), as_json: bool = True) -> dict[str, DataFrame]:
    """run, metrics (aggregates, with derived ones appended) and samples of a run."""
    told = store.metrics.query(run_id, aggregate_only=not as_json)
    derived = confusion.output_metrics(store.steps(run_id), labels, metrics, as_json) if labels and metrics else None
    if derived is not None:
        extra = derived.select(F.lit(None).cast("long").alias("step_id"), "metric_name", "metric_value", F.lit(None).cast("string").alias("unit"), F.current_timestamp().alias("created_at"))
        told = told.unionByName(extra)
    return {"run": store.runs().filter(F.col("id") == run_id), "metrics": told, "samples": sample_objects(store.list_steps(run_id), store.metrics.points(run_id))}


def compared(store: Store, a: int, b: int) -> dict:
    """steps, outputs, metrics as DataFrames; `differs`, and `warning` if the workflows' names differ."""
    if a == b:
        raise StoreError("a run can't be compared with itself")
    left, right = store.get_run(a), store.get_run(b)
    if left is None or right is None:
        raise StoreError("there is no such run")
    steps = cmp.step_rows(store.steps(a), store.steps(b))
    points = [store.metrics.points(i).filter("step_id is null") for i in (a, b)]
    metrics = cmp.metric_vectors(cmp.metric_pairs(*points))
    warning = None if left["workflow_name"] == right["workflow_name"] else f"comparing {left['workflow_name']} with {right['workflow_name']}"
    return {"steps": steps, "outputs": cmp.output_differences(steps), "metrics": metrics, "warning": warning, "differs": cmp.differs(steps, metrics, left["input"] == right["input"], left["output"] == right["output"])}
