import math

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import confusion, stats


def values(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "x double")


@pytest.mark.parametrize("xs, p, out", [([1], 0.3, 1), ([1, 3], 0.5, 2), ([1, 3], 0, 1), ([1, 3], 1, 3), ([0, 10, 20, 30, 40], 0.25, 10), ([0, 10, 20, 30, 40], 0.75, 30)])
def test_percentile(spark, xs, p, out):
    assert values(spark, xs).agg(stats.percentiles(F.col("x"), p).alias("p")).first()["p"] == [out]


def test_summary(spark):
    one = stats.summary(values(spark, [42]), "x").first()
    assert (one["mean"], one["median"], one["min"], one["max"], one["std"], one["variance"]) == (42, 42, 42, 42, 0, 0)
    five = stats.summary(values(spark, [1, 2, 3, 4, 5]), "x").first()
    assert (five["mean"], five["median"], five["min"], five["max"]) == (3, 3, 1, 5)
    assert stats.summary(values(spark, []), "x").count() == 0


def test_moments(spark):
    df = values(spark, [2, 4, 4, 4, 5, 5, 7, 9])
    r = df.agg(stats.variance(F.col("x")).alias("v"), stats.stddev(F.col("x")).alias("s"), stats.variance(F.col("x"), True).alias("vs"), stats.stddev(F.col("x"), True).alias("ss")).first()
    assert (r["v"], r["s"]) == (4.0, 2.0)
    assert r["vs"] == pytest.approx(4.5714, rel=1e-3) and r["ss"] == pytest.approx(2.138, rel=1e-3)
    assert math.isnan(values(spark, [3]).agg(stats.variance(F.col("x"), True).alias("v")).first()["v"])


def test_clipped_mean(spark):
    assert values(spark, [-1, 0.5, 1.5, 0]).agg(stats.clipped_mean(F.col("x")).alias("m")).first()["m"] == 0.375
    assert values(spark, [0, 5, 10, 15]).agg(stats.clipped_mean(F.col("x"), 2, 8).alias("m")).first()["m"] == 5.75
    assert math.isnan(values(spark, [float("nan"), 1]).agg(stats.clipped_mean(F.col("x")).alias("m")).first()["m"])
    with pytest.raises(ValueError):
        stats.clipped_mean(F.col("x"), 1, 1)


def test_strict_mean_raises_on_nothing(spark):
    with pytest.raises(Exception, match="mean of no values"):
        values(spark, []).agg(stats.mean(F.col("x"), strict=True)).collect()


@pytest.mark.parametrize("p, df, t", [(0.975, 4, 2.776445), (0.975, 1, 12.706205), (0.95, 10, 1.812461), (0.995, 30, 2.749996), (0.975, 1000, 1.962339)])
def test_t_inverse(p, df, t):
    assert stats.t_inverse(p, df) == pytest.approx(t, abs=2e-6)


def test_confidence_interval(spark):
    rows = values(spark, [1, 2, 3, 4, 5])
    widths = []
    for c in (0.9, 0.95, 0.99):
        r = stats.confidence_interval(rows, "x", confidence=c).first()
        assert r["low"] < 3 < r["high"]
        widths.append(r["high"] - r["low"])
    assert widths == sorted(widths)
    one = stats.confidence_interval(values(spark, [42]), "x").first()
    assert (one["low"], one["high"]) == (42, 42)
    assert stats.confidence_interval(values(spark, []), "x").count() == 0


@pytest.mark.parametrize("c, n, out", [(5, 5, 1), (0, 5, 0), (3, 6, 0.5), (0, 0, 0)])
def test_accuracy_of(c, n, out):
    assert stats.accuracy_of(c, n) == out


def test_accuracy(spark):
    rows = spark.createDataFrame([(True,), (False,), (True,), (False,), (None,)], "ok boolean")
    r = stats.accuracy(rows, "ok").first()
    assert (r["accuracy"], r["correct_count"], r["total_count"]) == (0.4, 2, 5)
    assert stats.accuracy(rows.limit(0), "ok").count() == 0


def test_binary(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False), (True, True)], "a boolean, p boolean")
    r = stats.binary_classification(rows, "a", "p").first()
    assert r["precision"] == pytest.approx(2 / 3) and r["recall"] == pytest.approx(2 / 3) and r["f1"] == pytest.approx(2 / 3) and r["specificity"] == 0.5
    none = stats.binary_classification(rows.filter("not a and not p"), "a", "p").first()
    assert (none["precision"], none["recall"], none["f1"], none["specificity"]) == (0, 0, 0, 1)


def test_confusion_and_f1(spark):
    rows = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", None)], "g string, p string")
    cells = confusion.matrix(rows, "g", "p", ["A", "B"])
    told = {r["metric_name"]: r["metric_value"] for r in confusion.f1_metrics(cells).unionByName(confusion.confusion_metrics(cells)).collect()}
    assert told["macro_f1"] == pytest.approx(1 / 3) and told["weighted_f1"] == pytest.approx(4 / 9) and told["f1_label_0"] == pytest.approx(2 / 3) and told["f1_label_1"] == 0
    assert told["confusion_matrix_1_unparsed"] == 1 and told["confusion_matrix_0_1"] == 1 and told["confusion_matrix_1_0"] == 0
    assert len(told) == 2 + 2 + 6
    with pytest.raises(Exception, match="unknown golden label"):
        confusion.matrix(spark.createDataFrame([("Z", "A")], "g string, p string"), "g", "p", ["A", "B"]).collect()


def test_metric_selection():
    assert confusion.selected(["f1", {"name": "confusion", "show": "all"}], as_json=False) == ["confusion"]
    assert confusion.selected(["f1", {"name": "confusion", "show": "json"}], as_json=True) == ["f1", "confusion"]
    with pytest.raises(ValueError):
        confusion.selected(["auc"], True)
