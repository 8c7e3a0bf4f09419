"""Aggregates over scores: summaries, intervals, accuracy, binary classification."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.quantiles import quantiles

EPSILON = 2.220446049250313e-16


def safe_ratio(n: Column, d: Column) -> Column:
    """0 where the denominator is (next to) nothing."""
    return F.when(F.abs(d) < EPSILON, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0)))


def required(value: Column, n: Column, what: str) -> Column:
    """The strict form of an aggregate: raises on no rows instead of giving null."""
    return F.when(n == 0, F.raise_error(F.lit(f"{what} of no values")).cast("double")).otherwise(value)


def mean(x: Column, strict: bool = False) -> Column:
    return required(F.avg(x), F.count(x), "mean") if strict else F.avg(x)


def variance(x: Column, sample: bool = False) -> Column:
    """Population variance, or the sample's; one value has a sample variance of NaN."""
    return F.when(F.count(x) == 1, F.lit(float("nan"))).otherwise(F.var_samp(x)) if sample else F.var_pop(x)


def stddev(x: Column, sample: bool = False) -> Column:
    return F.when(F.count(x) == 1, F.lit(float("nan"))).otherwise(F.stddev_samp(x)) if sample else F.stddev_pop(x)


def percentiles(x: Column, *at: float) -> Column:
    """Exact, linear between neighbours, as an aggregate that holds a group's values: quantiles.quantiles() is for groups of any size."""
    return F.percentile(x, F.array(*[F.lit(float(p)) for p in at]))


def approx_percentiles(x: Column, *at: float, accuracy: int = 10_000) -> Column:
    return F.percentile_approx(x, [float(p) for p in at], accuracy)


def clipped_mean(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Mean of values pulled into [lo, hi]; NaN stays NaN."""
    if lo >= hi:
        raise ValueError("the lower bound must be below the upper one")
    return F.avg(F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))))


def summary(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """mean, std, variance (population), median, min, max, p95, p99 by key; no row for a key without values."""
    x = F.col(value)
    also = {"mean": F.avg(x), "std": F.stddev_pop(x), "variance": F.var_pop(x), "min": F.min(x), "max": F.max(x)}
    told = quantiles(rows, value, keys, (0.5, 0.95, 0.99), also)
    return told.select(*keys, "n", "mean", "std", "variance", F.col("q")[0].alias("median"), "min", "max", F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"))


def long_metrics(told: DataFrame, names: dict[str, str], *keys: str, unit: str | None = None) -> DataFrame:
    """Columns to (metric_name, metric_value, unit) rows. names: metric name -> column."""
    pairs = ", ".join(f"'{name}', cast(`{column}` as double)" for name, column in names.items())
    return told.select(*keys, F.expr(f"stack({len(names)}, {pairs}) as (metric_name, metric_value)"), F.lit(unit).cast("string").alias("unit"))


#: Metric names of the similarity evaluation and of the latency summary: name -> column of summary().
SIMILARITY_METRICS = {f"{n}_similarity": c for n, c in (("mean", "mean"), ("stdev", "std"), ("variance", "variance"), ("median", "median"), ("min", "min"), ("max", "max"), ("p99", "p99"), ("p95", "p95"))}
LATENCY_METRICS = {f"{n}_latency_ms": n for n in ("mean", "median", "p95", "p99", "min", "max")}


def accuracy(rows: DataFrame, correct: str, *keys: str) -> DataFrame:
    """accuracy, correct_count, total_count as doubles; nothing for no rows."""
    hit = F.coalesce(F.col(correct), F.lit(False)).cast("double")
    told = rows.groupBy(*keys).agg(F.avg(hit).alias("accuracy"), F.sum(hit).alias("correct_count"), F.count(F.lit(1)).cast("double").alias("total_count"))
    return told.filter("total_count > 0")


def accuracy_of(correct: int, total: int) -> float:
    return correct / total if total > 0 else 0.0


def binary_classification(rows: DataFrame, actual: str, predicted: str, *keys: str) -> DataFrame:
    """precision, recall, specificity and f1; undefined ratios are 0."""
    a, p = F.col(actual), F.col(predicted)
    told = rows.groupBy(*keys).agg(
        F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn")
    )
    told = told.withColumns({"precision": safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")), "specificity": safe_ratio(F.col("tn"), F.col("tn") + F.col("fp"))})
    return told.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Lentz's evaluation of 1 / (1 + d1 / (1 + d2 / (1 + ...)))
    tiny, c, d = 1e-300, 1.0, 0.0
    value = 1.0
    for i in range(1, 500):
        m = i // 2
        term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        value *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front / value


def t_inverse(p: float, df: float) -> float:
    """Inverse of Student's distribution, by bisection."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_inverse(1 - p, df)
    lo, hi = 0.0, 1.0
    below = lambda t: 1 - 0.5 * _beta_share(df / 2, 0.5, df / (df + t * t))
    while below(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return (lo + hi) / 2


def confidence_interval(rows: DataFrame, value: str, *keys: str, confidence: float = 0.95) -> DataFrame:
    """mean, low and high by Student's t; one value is its own interval. A t value is computed once for each distinct size."""
    x = F.col(value)
    told = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("_s")).filter("n > 0")

    @F.pandas_udf("double")
    def t_value(n):
        return n.map(lambda k: t_inverse(0.5 + confidence / 2, k - 1) if k > 1 else 0.0)

    sizes = told.select("n").distinct().withColumn("_t", t_value("n"))
    half = F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.col("_t") * F.col("_s") / F.sqrt("n"))
    return told.join(sizes, "n").withColumn("_h", half).select(*keys, "n", "mean", (F.col("mean") - F.col("_h")).alias("low"), (F.col("mean") + F.col("_h")).alias("high"))
