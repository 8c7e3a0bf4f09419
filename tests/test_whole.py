"""Registered queries whose SQL states a part of the rows: the whole result against brute force."""

import math
import statistics

import pandas as pd
import pytest

from gaugeworks.operators import stats
from gaugeworks.plans import registry


def test_confidence_interval_of_large_groups(spark, tmp_path):
    values = [math.sin(i) * 1000 for i in range(150)]
    rows = [(1, "A", v) for v in values] + [(2, "B", v) for v in values[:60]] + [(3, "C", 5.0)]
    pd.DataFrame(rows, columns=["c_nationkey", "c_mktsegment", "c_acctbal"]).to_parquet(tmp_path / "customer.parquet")
    told = {r["c_mktsegment"]: r for r in registry.confidence_interval(spark, str(tmp_path)).collect()}
    assert set(told) == {"A", "B", "C"} and told["A"]["n"] == 150 and told["C"]["low"] == told["C"]["high"] == 5.0
    for segment, own in (("A", values), ("B", values[:60])):
        mean, half = statistics.fmean(own), stats.t_inverse(0.975, len(own) - 1) * statistics.stdev(own) / math.sqrt(len(own))
        assert [told[segment][c] for c in ("mean", "low", "high")] == pytest.approx([mean, mean - half, mean + half], abs=1e-4)


def test_every_event_is_compared(spark):
    events = pd.read_parquet("/root/testdata/sf0.001/events.parquet")
    told = registry.compare_metrics(spark, "/root/testdata/sf0.001").toPandas()
    assert told["n_a"].sum() + told["n_b"].sum() == len(events)


def test_every_point_and_part_is_there(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert registry.metric_scan(spark, sf_dir).count() == len(pd.read_parquet(f"{sf_dir}/events.parquet", columns=["event_id"]))
    told = registry.index_answers(spark, sf_dir).toPandas()
    assert len(told) == len(pd.read_parquet(f"{sf_dir}/part.parquet", columns=["p_partkey"])) and told["golden"].isna().any()
