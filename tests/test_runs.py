import json

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import compare, latest, sampling
from gaugeworks.plans import evaluate
from gaugeworks.plans.store import Store, StoreError, event_states
from gaugeworks.plans.workflow import entrypoint, workflow
from gaugeworks.sources.config import Style
from gaugeworks.streaming import events as stream

STYLE = Style("multiple_choice", choice_columns=("a", "b"), labels=("A", "B"), index_column="k")
PROMPT = "{{ row.q }}\n{% for c in choices %}{{ c.label }}. {{ c.text }}\n{% endfor %}"


def rows(spark, n=12):
    return spark.range(n).select(F.col("id").alias("i"), F.concat(F.lit("q"), "id").alias("q"), F.lit("x").alias("a"), F.lit("y").alias("b"), (F.col("id") % 2).cast("string").alias("k"))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "w"))


def test_run_show_resume_compare(spark, store):
    first = evaluate.run_nocode(store, "w", rows(spark), STYLE, PROMPT, ["i"], limit=8)
    assert first.output == {"samples_completed": 8}
    assert set(first.metrics) == {"accuracy", "mean_latency_ms", "median_latency_ms", "p95_latency_ms", "p99_latency_ms", "min_latency_ms", "max_latency_ms"}
    listed = evaluate.runs_listed(store).first()
    assert (listed["samples"], listed["status"], listed["workflow_name"]) == (8, "completed", "w") and listed["duration_s"] > 0
    assert store.get_run(first.run_id)["model"] == "demo-builtin"
    with pytest.raises(StoreError, match="completed"):
        evaluate.resume(store, first.run_id)
    told = evaluate.shown(store, first.run_id, ["A", "B"], ["f1"])
    names = [r["metric_name"] for r in told["metrics"].collect()]
    assert "macro_f1" in names and "latency_ms" in names
    sample = json.loads(told["samples"].orderBy("step_key").first()["sample"])
    assert sample["step_key"] == "row-0" and sample["status"] == "completed" and set(sample["metrics"]) == {"latency_ms", "is_correct", "response_parsed"} and "golden" in sample and "error" not in sample
    assert [r["metric_name"] for r in evaluate.shown(store, first.run_id, as_json=False)["metrics"].collect()] == sorted(first.metrics)
    # The same again: equal steps. Another seed: different ones.
    again = evaluate.run_nocode(store, "w", rows(spark), STYLE, PROMPT, ["i"], limit=8)
    same = evaluate.compared(store, first.run_id, again.run_id)
    assert not same["differs"] and same["outputs"].count() == 0
    other = evaluate.run_nocode(store, "w", rows(spark), STYLE, PROMPT, ["i"], limit=8, seed="s")
    diff = evaluate.compared(store, first.run_id, other.run_id)
    assert diff["differs"] and "$.response" in {r["path"] for r in diff["outputs"].collect()}
    with pytest.raises(StoreError):
        evaluate.compared(store, 1, 1)
    kinds = {r["event_type"]: r["n"] for r in stream.counts(store.events(first.run_id), "event_type").collect()}
    assert kinds == {"run.started": 1, "run.completed": 1, "step.started": 8, "step.completed": 8}
    assert {r["status"] for r in event_states(store.records("events").drop("seq")).collect()} == {"completed"}


def test_failure_cascades_and_resume_reuses(spark, store):
    seen = spark.sparkContext.accumulator(0)

    def flaky(_model):
        def answer(prompts):
            seen.add(len(prompts))
            return ["A"] * len(prompts)

        return answer

    sampling.register("openai", flaky)
    good = rows(spark, 4)
    bad = good.unionByName(good.limit(1).withColumns({"i": F.lit(99).cast("long"), "k": F.lit("7")}))
    with pytest.raises(Exception, match="out of range"):
        evaluate.run_nocode(store, "w", bad, STYLE, PROMPT, ["i"], model="openai:m")
    run = store.runs().first()
    assert run["status"] == "failed" and store.get_run(run["id"])["model"] == "openai:m"
    # Two of the steps are done already; resuming executes the others only.
    report = evaluate.run_nocode(store, "w", good.limit(2), STYLE, PROMPT, ["i"], model="openai:m", run_id=run["id"])
    assert report.output["samples_completed"] == 2
    store.fail_run(run["id"], "stopped")
    before = seen.value
    report = evaluate.run_nocode(store, "w", good, STYLE, PROMPT, ["i"], model="openai:m", run_id=run["id"])
    assert report.output["samples_completed"] == 4 and seen.value == before + 2
    points = store.metrics.points(run["id"]).filter("metric_name = 'latency_ms' and step_id is not null")
    assert points.count() == 4  # earlier samples keep their points
    assert report.metrics["accuracy"] == 0.5


def test_memo_protocol(spark, store):
    run = store.create_run("w")
    want = lambda h: spark.createDataFrame([("k", h)], "step_key string, input_hash string")
    todo, done = store.begin_steps(run, want("h"))
    assert todo.count() == 1 and done.count() == 0
    todo, done = store.begin_steps(run, want("h"))  # still running: the same id again
    assert todo.first()["step_id"] == store.steps(run).first()["id"]
    store.finish_steps(run, spark.createDataFrame([("k", None, "boom")], "step_key string, output string, error string"))
    assert store.steps(run).first()["status"] == "failed"
    todo, _ = store.begin_steps(run, want("h"))
    assert todo.count() == 1
    store.finish_steps(run, spark.createDataFrame([("k", "1", None)], "step_key string, output string, error string"))
    todo, done = store.begin_steps(run, want("h"))
    assert todo.count() == 0 and done.first()["output"] == "1"
    with pytest.raises(StoreError, match="another input"):
        store.begin_steps(run, want("other"))
    with pytest.raises(StoreError, match="another input"):
        store.begin_steps(run, want("x").union(want("y")).withColumn("step_key", F.lit("new")))
    with pytest.raises(StoreError, match="no step"):
        store.finish_steps(run, spark.createDataFrame([("z", "1", None)], "step_key string, output string, error string"))
    store.begin_steps(run, spark.createDataFrame([("open", "h")], "step_key string, input_hash string"))
    store.fail_run(run, "why")
    assert {r["step_key"]: r["status"] for r in store.steps(run).collect()} == {"k": "completed", "open": "failed"}
    assert store.runs().first()["error"] == "why"
    with pytest.raises(StoreError):
        store.set_output(12345, "{}")


def test_similarity_and_biomedical(spark, store):
    r = evaluate.run_similarity(store, spark.createDataFrame([("q", "same"), ("p", "x")], "problem string, answer string"), "problem", "answer", ["problem"], "levenshtein")
    assert set(r.metrics) == {f"{n}_similarity" for n in ("mean", "stdev", "variance", "median", "min", "max", "p99", "p95")}
    told = spark.createDataFrame([(json.dumps({"question": f"Q{i}", "context": "c", "answer": "yes", "id": str(i)}),) for i in range(9)], "json string")
    r = evaluate.run_biomedical(store, told)
    assert r.metrics["total_count"] == 9 and r.metrics["accuracy"] == r.metrics["correct_count"] / 9


def test_workflow(spark, store, monkeypatch):
    def handler(run, given):
        total = sum(run.step(f"s{i}", {"i": i}, lambda i=i: {"val": 2 * i})["val"] for i in range(given["n"]))
        run.emit("total", total)
        return {"total": total}

    report = workflow("smoke", handler).run(store, {"n": 3})
    assert report.output == {"total": 6} and report.metrics["total"] == 6 and store.steps(report.run_id).count() == 3

    def broken(run):
        run.step("s", None, lambda: 1 / 0)

    with pytest.raises(ZeroDivisionError):
        workflow("broken", broken).run(store)
    failed = store.records("steps").filter("status = 'failed'").first()
    assert "ZeroDivisionError" in failed["error"]
    monkeypatch.setenv("GAUGEWORKS_INPUT", '{"n": 1}')
    assert entrypoint(workflow("smoke", handler), store).output == {"total": 0}


def test_metric_store(spark, store):
    m = store.metrics
    assert m.query(5).count() == 0
    m.flush(5)
    m.emit_one(5, "zebra", 1)
    m.emit_one(5, "alpha", 2)
    m.emit_one(5, "alpha", 3, "ms", step_id=1)
    m.emit_one(6, "other", 9)
    m.flush(5)
    assert [(r["metric_name"], r["metric_value"]) for r in m.query(5).collect()] == [("alpha", 2), ("alpha", 3), ("zebra", 1)]
    assert m.query(5, aggregate_only=True).count() == 2
    m.emit_one(5, "alpha", 4, step_id=2)
    assert sorted(r["metric_value"] for r in m.sample_values(5, "alpha").collect()) == [3, 4]
    m.flush(5)
    assert m.query(5).count() == 4
    m.mode = "replace"
    m.emit_one(5, "only", 1)
    m.flush(5)
    assert [r["metric_name"] for r in m.query(5).collect()] == ["only"]
    assert m.query(6).count() == 0 and m.pending is not None


def test_comparisons(spark):
    s = "step_key string, input_hash string, status string, output string, started_at timestamp, id long"
    a = spark.createDataFrame([("1", "h", "completed", None, None, 1), ("2", "h", "completed", '{"x":1}', None, 2), ("3", "h", "completed", "a", None, 3), ("2", "h", "completed", '{"x":2}', None, 9)], s)
    b = spark.createDataFrame([("1", "h", "completed", None, None, 1), ("2", "h", "completed", '{"x":1}', None, 2)], s)
    told = {r["step_key"]: r for r in compare.step_rows(a, b).collect()}
    assert not told["1"]["output_differs"] and told["2"]["output_differs"] and told["3"]["presence"] == "only_a" and told["3"]["output_differs"]
    assert [(r["path"], r["run_a"], r["run_b"]) for r in compare.output_differences(compare.step_rows(a, b)).collect()] == [("$.x", "2", "1")]
    p = "metric_name string, metric_value double, created_at timestamp, ord long"
    x = spark.createDataFrame([("m", 1.0, None, 1), ("m", 2.0, None, 2), ("gone", 1.0, None, 1), ("nan", float("nan"), None, 1)], p)
    y = spark.createDataFrame([("m", 1.5, None, 1), ("nan", float("nan"), None, 1)], p)
    told = {r["metric_name"]: r for r in compare.metric_vectors(compare.metric_pairs(x, y)).collect()}
    assert told["m"]["deltas"] == [0.5, None] and told["m"]["direction"] == "up" and not told["m"]["same"]
    assert told["gone"]["direction"] == "same" and not told["gone"]["same"] and not told["nan"]["same"]


def test_samplers(spark):
    df = spark.range(300).select(F.concat(F.lit("p"), "id").alias("p"))
    told = df.select("p", sampling.random_text(F.col("p"), "s").alias("t"), sampling.random_label(F.col("p"), F.array(F.lit("A"), F.lit("B"))).alias("l"), sampling.random_label(F.col("p"), F.array().cast("array<string>")).alias("m"))
    rows_ = told.collect()
    assert all(1 <= len(r["t"]) <= 80 and r["t"].isalnum() for r in rows_) and {r["l"] for r in rows_} == {"A", "B"} and {r["m"] for r in rows_} == {"maybe"}
    assert rows_ == told.collect()
    assert sampling.model_spec("openai:x").display == "openai:x" and sampling.model_spec({"type": "random"}).display == "demo-builtin"
    for bad in ("openai", "openai:", "nobody:x"):
        with pytest.raises(ValueError):
            sampling.model_spec(bad)
    with pytest.warns(UserWarning):
        assert sampling.worker_count(5000) == 2000
    told = sampling.map_rows(spark.range(6), lambda r: {"v": r["id"] * 2} if r["id"] != 3 else None, "v long").collect()
    assert sorted(r["v"] for r in told) == [0, 2, 4, 8, 10]


def test_index_and_page(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    told = latest.indexed(df, ["k"]).collect()
    assert all(r["k"] == r["row_index"] for r in told) and len(told) == 1000
    assert [r["k"] for r in latest.page(df, ["k"], 5, 3).collect()] == [5, 6, 7]
    with pytest.raises(ValueError):
        latest.page(df, ["k"], 0, 0)
