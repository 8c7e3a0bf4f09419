"""Radix selection against sorting, and places of points within metrics of any length."""

import math
import random
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import compare, latest, quantiles, stats

EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, math.nextafter(1, 0), math.nextafter(1, 2), -1.0, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 1e-310, 3.0, 8.0, math.nextafter(8, 0), 0.1, 1e22]


def bits(x):
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


def test_bits_are_what_the_double_stores(spark):
    r = random.Random(4)
    xs = EDGES + [r.choice((-1, 1)) * math.ldexp(r.random(), r.randint(-1074, 1024)) for _ in range(3000)] + [math.ldexp(1, e) for e in range(-1074, 1024)]
    told = spark.createDataFrame([(x,) for x in xs], "x double").select("x", quantiles.ordered_bits(F.col("x")).alias("b")).collect()
    assert all(r["b"] == bits(r["x"]) for r in told)
    assert spark.range(1).select(quantiles.ordered_bits(F.lit(float("nan"))).alias("b")).first()["b"] > bits(math.inf)


def brute(xs, p):
    xs = sorted(xs, key=lambda x: (math.isnan(x), x))
    at = p * (len(xs) - 1)
    low = int(at)
    return xs[low] if at == low else xs[low] * (1 - (at - low)) + xs[low + 1] * (at - low)


AT = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)


@pytest.mark.parametrize("held", [0, 7, 100_000])
def test_quantiles_equal_sorting(spark, held):
    """Groups of one value, ties beyond `held`, NaN, infinities, values that differ in their last bit only, and a group that is null."""
    r = random.Random(9)
    groups = {"one": [4.5], "two": [1.0, 3.0], "ties": [2.0] * 300 + [3.0] * 20, "last bit": [1.0 + i * 2**-52 for i in range(200)], "wide": [r.choice((-1, 1)) * math.exp(r.uniform(-600, 600)) for _ in range(900)],
              "nan": [1.0, float("nan"), 2.0, float("nan"), 0.5], "zeros": [0.0, -0.0, 0.0, -1e-320, 1e-320], None: [float(i % 50) for i in range(500)]}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("none", None), ("two", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    told = {r["k"]: r for r in quantiles.quantiles(df, "v", ["k"], AT, {"top": F.max("v")}, held).collect()}
    assert set(told) == set(groups)
    for k, xs in groups.items():
        assert told[k]["n"] == len(xs)
        for got, p in zip(told[k]["q"], AT):
            want = brute(xs, p)
            assert math.isnan(got) and math.isnan(want) or got == pytest.approx(want, rel=1e-15, abs=0), (k, p)


def test_quantiles_of_everything_and_of_nothing(spark):
    df = spark.range(2001).select(F.col("id").alias("v"))
    assert quantiles.quantiles(df, "v", [], (0.5, 0.25), held=10).first()["q"] == [1000.0, 500.0]
    assert quantiles.quantiles(df.filter("v < 0"), "v", [], (0.5,)).count() == 0
    assert df.groupBy().agg(stats.percentiles(F.col("v"), 0.5).alias("p")).first()["p"] == [1000.0]


def test_summary_holds_no_group(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    told = stats.summary(df, "v", "k")
    assert "percentile" not in told._jdf.queryExecution().toString()
    assert {(r["k"], r["n"], r["median"], r["min"], r["max"]) for r in told.collect()} == {(0, 334, 499.5, 0, 999), (1, 333, 499.0, 1, 997), (2, 333, 500.0, 2, 998)}


def test_places_within_groups(spark):
    rows = [(None if i % 4 == 0 else i % 4, i * 37 % 101, i) for i in range(800)]
    df = spark.createDataFrame(rows, "g int, a int, b int").repartition(7)
    want = {}
    for g in (None, 1, 2, 3):
        for n, (_, a, b) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            want[g, a, b] = n
    assert {(r["g"], r["a"], r["b"]): r["position"] for r in latest.ranked(df, ["g"], ["a", "b"]).collect()} == want
    assert latest.ranked(df.filter("false"), ["g"], ["a"]).count() == 0


def test_metric_vectors_of_many_tasks(spark):
    """One metric of 200,000 points and a short one, in shuffled input: ranges split the long one, and every place is compared."""
    n = 200_000
    point = lambda name, value, ord_: F.struct(name.alias("metric_name"), value.alias("metric_value"), ord_.alias("ord"))
    ids = spark.range(n, numPartitions=8)
    long_a = ids.select(point(F.lit("long"), F.col("id").cast("double"), F.col("id")).alias("p")).select("p.*")
    long_b = ids.filter(F.col("id") < n - 5).select(point(F.lit("long"), F.col("id") + F.when(F.col("id") == 77_777, 0.5).otherwise(0.0), F.col("id")).alias("p")).select("p.*")
    short = spark.createDataFrame([("short", 1.0, 1), ("short", None, 2), ("only b", 3.0, 1)], "metric_name string, metric_value double, ord long")
    a, b = (x.withColumn("created_at", F.lit(None).cast("timestamp")).orderBy(F.xxhash64("ord")) for x in (long_a.unionByName(short.filter("metric_name = 'short'")), long_b.unionByName(short)))
    pairs = compare.metric_pairs(a, b)
    told = {r["metric_name"]: r for r in compare.metric_rows(pairs).collect()}
    assert (told["long"]["n_a"], told["long"]["n_b"], told["long"]["unmatched"], told["long"]["delta_sum"], told["long"]["direction"], told["long"]["same"]) == (n, n - 5, 5, 0.5, "up", False)
    assert told["short"]["same"] and told["short"]["direction"] == "same" and told["short"]["unmatched"] == 1
    assert not told["only b"]["same"] and (told["only b"]["n_a"], told["only b"]["n_b"]) == (0, 1)
    assert Counter(pairs.filter("metric_name = 'long'").select(F.spark_partition_id().alias("t")).toPandas()["t"]).most_common(1)[0][1] < n
    plan = compare.metric_rows(pairs)._jdf.queryExecution().toString()
    assert "collect_list" not in plan
