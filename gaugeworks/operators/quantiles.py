"""Exact quantiles of groups of any size by radix selection.

A double becomes a 64-bit number in the same order (its sign, exponent and fraction; NaN last, both zeros alike). A
quantile needs the one or two values at the ranks around p * (n - 1). A group of at most `held` values is finished at
once: its distinct values are counted and added up in order. Of a larger one the values are counted by their first 16
bits, by all tasks, each group's counts are added up, and the rank falls into one prefix with a rank of its own there.
Prefixes with more than `held` values take the next 16 bits, four times at most; those with a single distinct value,
however often it occurs, are done. No task, and no aggregate, holds the values of a group.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.session import written

DIGIT, LEVELS = 16, 4
_FRACTION = 2**52


def _size() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.min("_x").alias("_low"), F.max("_x").alias("_high")]


def ordered_bits(x: Column) -> Column:
    """A long that orders as the double x does, equal for equal values: what IEEE 754 stores, negated below zero."""
    size = F.abs(x)
    power = lambda e: F.pow(F.lit(2.0), e)  # noqa: E731  exact for whole exponents
    near = F.floor(F.log2(size))  # may be off by one next to a power of two
    e = near - F.when(size < power(near), 1).otherwise(0) + F.when(size >= power(near + 1), 1).otherwise(0)
    normal = (e + 1023) * F.lit(_FRACTION) + ((size / power(e) - 1) * _FRACTION).cast("long")
    tiny = (size / F.lit(5e-324)).cast("long")  # below the normal range the fraction is all there is
    bits = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(2047 * _FRACTION)).when(size < 2.2250738585072014e-308, tiny).otherwise(normal)
    return F.when(F.isnan(x), F.lit(2047 * _FRACTION + 1)).otherwise(F.when(x < 0, -bits).otherwise(bits)).cast("long")


def _prefix(level: int) -> Column:
    """The first 16 * level bits; nothing, or all of them, at the ends."""
    return F.lit(0).cast("long") if level == 0 else F.shiftright("_bits", 64 - DIGIT * level).cast("long")


def _within(values: DataFrame, asked: DataFrame, level: int) -> DataFrame:
    """The values under the prefixes that are asked for. Both sides are read from files, so a prefix with many values can be split."""
    wanted = asked.select("_g", "_prefix").distinct()
    return values.withColumn("_prefix", _prefix(level)).join(wanted, ["_g", "_prefix"], "left_semi")


def _placed(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """Each rank that is asked for with the count it falls into. counts: _g, _prefix, _digit, n and more."""
    end = F.sum("n").over(Window.partitionBy("_g", "_prefix").orderBy("_digit"))
    ends = counts.withColumn("_before", end - F.col("n"))
    ranks = asked.select("_g", "_prefix", "rank", "rest")
    return ends.join(ranks, ["_g", "_prefix"]).filter((F.col("rest") >= F.col("_before")) & (F.col("rest") < F.col("_before") + F.col("n")))


def _between(low: Column, high: Column, at: Column) -> Column:
    share = at - F.floor(at)
    return F.when(share == 0, low).otherwise(low * (1 - share) + high * share)


def _of_few(values: DataFrame, at: Sequence[float]) -> DataFrame:
    """_g and q of groups of at most `held` values: counts of distinct values, added up in order."""
    own = Window.partitionBy("_g")
    counts = values.groupBy("_g", "_x").agg(F.count(F.lit(1)).alias("_m"))
    ends = counts.withColumns({"_end": F.sum("_m").over(own.orderBy("_x")), "n": F.sum("_m").over(own)})
    holds = lambda rank: F.max(F.when((F.col("_end") > rank) & (F.col("_end") - F.col("_m") <= rank), F.col("_x")))
    ranks = [F.lit(float(p)) * (F.col("n") - 1) for p in at]
    told = ends.groupBy("_g", "n").agg(*[f(r).alias(f"_{k}{i}") for i, r in enumerate(ranks) for k, f in (("low", lambda r: holds(F.floor(r))), ("high", lambda r: holds(F.ceil(r))))])
    return told.select("_g", F.array(*[_between(F.col(f"_low{i}"), F.col(f"_high{i}"), r) for i, r in enumerate(ranks)]).alias("q"))


def _of_many(values: DataFrame, groups: DataFrame, at: Sequence[float], held: int) -> DataFrame:
    """_g and q of larger groups, by radix selection."""
    places = [F.lit(float(p)) * (F.col("n") - 1) for p in at]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in places])))
    asked = groups.select("_g", F.lit(0).cast("long").alias("_prefix"), F.explode(ranks).alias("rank"), "n", "_low", "_high").withColumn("rest", F.col("rank"))
    told = []
    for level in range(LEVELS + 1):
        single = F.col("_low").eqNullSafe(F.col("_high"))
        told.append(asked.filter(single).select("_g", "rank", F.col("_low").alias("x")))
        if level == LEVELS:
            break
        if level:
            few = asked.filter(~single & (F.col("n") <= held))
            counts = _within(values, few, level).groupBy("_g", "_prefix", F.col("_x").alias("_digit")).agg(F.count(F.lit(1)).alias("n"))
            told.append(_placed(counts, few).select("_g", "rank", F.col("_digit").alias("x")))
        many = asked.filter(~single & (F.col("n") > held))
        if not many.limit(1).count():
            break
        counts = _within(values, many, level).groupBy("_g", "_prefix", _prefix(level + 1).alias("_digit")).agg(*_size())
        asked = written(_placed(counts, many).select("_g", F.col("_digit").alias("_prefix"), "rank", (F.col("rest") - F.col("_before")).alias("rest"), "n", "_low", "_high"), "prefixes")
    found = functools.reduce(DataFrame.unionByName, told).groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_x"))  # two ranks a quantile at most
    at_rank = lambda p: F.element_at("_x", p)
    return groups.join(found, "_g").select("_g", F.array(*[_between(at_rank(F.floor(p)), at_rank(F.ceil(p)), p) for p in places]).alias("q"))


def quantiles(rows: DataFrame, value: str, keys: Sequence[str], at: Sequence[float], also: dict[str, Column] | None = None, held: int = 100_000) -> DataFrame:
    """keys, n, the aggregates `also`, and q: the quantiles `at`, linear between neighbours. Null values don't count; a group without others has no row."""
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    rows = rows.filter(F.col(value).isNotNull()).select("*", group.alias("_g"), F.col(value).cast("double").alias("_x"))
    groups = written(rows.groupBy("_g").agg(*_size(), *[c.alias(k) for k, c in (also or {}).items()]), "groups")
    values, many = rows.select("_g", "_x"), groups.filter(F.col("n") > held)
    if many.limit(1).count():
        few = values.join(groups.filter(F.col("n") <= held).select("_g"), "_g", "left_semi")
        told = _of_few(few, at).unionByName(_of_many(values.withColumn("_bits", ordered_bits(F.col("_x"))), many, at, held))
    else:
        told = _of_few(values, at)
    return groups.join(told, "_g").select(*[F.col(f"_g.`{k}`") for k in keys], "n", *(also or {}), "q")
