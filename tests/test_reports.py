import json
import sys

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import sampling
from gaugeworks.plans import command, evaluate, report
from gaugeworks.plans.store import Store, StoreError
from gaugeworks.sources import config
from gaugeworks.sources.datasets import Catalog

TOML = """
[benchmarks.facts]
type = "custom_nocode"
dataset = {{ name = "org/facts", config_name = "main" }}
prompt_template_file = "{0}"
limit = 4
[benchmarks.facts.style]
type = "exact_match"
answer = "answer"
[benchmarks.code]
type = "custom_code"
command = ["{1}", "-c", "import os, sys; assert os.environ['GAUGEWORKS_RUN_ID']; sys.exit(int('fail' in os.environ['GAUGEWORKS_INPUT']))"]
"""


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "w"))


def test_named_runs_and_reports(spark, store, tmp_path):
    (tmp_path / "p.txt").write_text("{{ row.question }}")
    spark.range(6).select(F.concat(F.lit("q"), "id").alias("question"), F.lit("a").alias("answer")).write.parquet(str(tmp_path / "m/org/facts/config=main/split=test"))
    found = config.parse(TOML.format(tmp_path / "p.txt", sys.executable))
    a = command.run(store, "facts", found, catalog=Catalog(spark, str(tmp_path / "m")))
    assert a.output == {"samples_completed": 4} and a.metrics["accuracy"] == 0
    b = command.run(store, "facts", found, {"limit": 3}, catalog=Catalog(spark, str(tmp_path / "m")))
    told = evaluate.compared(store, a.run_id, b.run_id)
    assert report.exit_code(told) == 1
    whole = report.compared_json(told)
    assert [s["step_key"] for s in whole["steps"]] == ["row-3"] and whole["warning"] is None
    assert {m["metric_name"] for m in whole["metrics"]} >= {"accuracy"} and report.comparison_table(told["metrics"]).count() == len(whole["metrics"])
    shown = report.shown_json(evaluate.shown(store, a.run_id), samples=2)
    assert shown["run"]["status"] == "completed" and shown["run"]["started_at"].endswith("Z") and len(shown["samples"]) == 2
    rows = report.listed(evaluate.runs_listed(store)).collect()
    assert [r["samples"] for r in rows] == [3, 4] and rows[0]["duration"].endswith("s")
    values = {r["metric_name"]: r["value"] for r in report.metric_table(store.metrics.query(a.run_id, True)).collect()}
    assert values["accuracy"] == "0" and values["mean_latency_ms"] == "0 ms"
    assert report.metric_map(store.metrics.query(a.run_id, True)).first()["metrics"]["accuracy"] == 0
    assert command.run(store, "code", found).run_id
    with pytest.raises(StoreError):
        command.run(store, "code", found, {"fail": 1})
    assert store.runs().filter("workflow_name = 'code'").groupBy("status").count().count() == 2
    with pytest.raises(StoreError, match="no evaluation"):
        command.run(store, "nothing", found)
    told = command.run(store, "similarity", {}, {"question": "question", "answer": "answer", "order": ["question"], "measure": "levenshtein"}, rows=spark.createDataFrame([("q", "a")], "question string, answer string"))
    assert "mean_similarity" in told.metrics


def test_create_tables(spark, store):
    store.create_tables()
    store.create_tables()
    assert store.runs().count() == 0 and evaluate.runs_listed(store).count() == 0


def test_chat(spark):
    df = spark.createDataFrame([([("user", "hi"), ("user", "there")],)], "m array<struct<role:string,content:string>>")
    r = sampling.chat(df, "m", sampling.ModelSpec("random")).first()["reply"]
    assert r["content"].isalnum() and r["tokens"] == 1
    r = sampling.chat(df, "m", sampling.ModelSpec("openai", "x"), lambda p, m, ms: {"content": f"{p}:{m}:{ms[-1]['content']}", "tokens": 7}).first()["reply"]
    assert (r["content"], r["tokens"]) == ("openai:x:there", 7)
    assert json.dumps(r.asDict())
