"""Grouped metrics: counters per category with grand totals, shares, remainders, quantiles by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.session import materialise


def with_total(rows: DataFrame, category: str, keys: list[str], *aggregates: Column, total: str = "all") -> DataFrame:
    """Aggregates per (category, *keys) and per keys over all categories, in one pass of grouping sets.

    A null category is shown as ``(none)``, so that it can't be mistaken for the total.
    """
    named = rows.withColumn(category, F.coalesce(F.col(category).cast("string"), F.lit("(none)")))
    sets = [[F.col(category), *map(F.col, keys)], [F.col(k) for k in keys]]
    out = named.groupingSets(sets, category, *keys).agg(F.grouping(category).alias("_g"), *aggregates)
    return out.withColumn(category, F.when(F.col("_g") == 1, total).otherwise(F.col(category))).drop("_g")


def tall(rows: DataFrame, keep: list[str], counters: dict[str, Column]) -> DataFrame:
    """(*keep, metric, key) from arrays of keys: one row per entry, so many counters share one aggregate."""
    parts = F.array(*[F.struct(F.lit(name).alias("metric"), F.coalesce(keys, F.array().cast("array<string>")).alias("keys")) for name, keys in counters.items()])
    return rows.select(*keep, F.inline(parts)).select(*keep, "metric", F.explode("keys").alias("key"))


def shares(counted: DataFrame, n: str = "n") -> DataFrame:
    """``counted`` with ``share``, the percentage of the sum of ``n``; the total is one broadcast row."""
    total = counted.agg(F.sum(n).alias("_total"))
    return counted.join(F.broadcast(total)).withColumn("share", F.col(n) * 100.0 / F.col("_total")).drop("_total")


def top_and_rest(counted: DataFrame, key: str, n: str, most: int, rest: str = "(other)") -> DataFrame:
    """The ``most`` keys with the largest ``n``, ties by key, and one row with what remains."""
    counted = materialise(counted.select(key, n), "counted")
    top = counted.orderBy(F.desc(n), key).limit(most)
    whole = counted.agg(F.sum(n).alias("_whole"))
    kept = top.agg(F.coalesce(F.sum(n), F.lit(0)).alias("_kept"))
    remainder = whole.join(F.broadcast(kept)).select(F.lit(rest).alias(key), (F.col("_whole") - F.col("_kept")).alias(n))
    return top.unionByName(remainder.where(F.col(n) > 0))


def median_and_index(values: DataFrame, by: list[str], value: str, percent: int) -> DataFrame:
    """Exact median (mean of the middle two) and the element at ``n * percent / 100``, rounded down, per group.

    Works on the histogram of distinct values, which is combined on the map side; only its running
    sum is windowed, so the number of rows behind a value does not matter.
    """
    histogram = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    along = group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cells = histogram.withColumn("_upto", F.sum("_n").over(along)).withColumn("_all", F.sum("_n").over(group))
    at = lambda i: F.min(F.when(F.col("_upto") > i, F.col(value)))
    n = F.col("_all")
    return cells.groupBy(*by).agg(
        F.max(n).alias("n"),
        ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0).alias("median"),
        at(F.least(n - 1, F.floor(n * percent / 100))).alias("quantile"),
    )


def greatest_version(rows: DataFrame, by: list[str], version: str, numbers: Column) -> DataFrame:
    """(*by, version): the greatest version per group as number lists compare; of equal ones the smaller text."""
    best = rows.withColumn("_v", numbers).where("_v is not null").groupBy(*by, "_v").agg(F.min(version).alias(version))
    return best.groupBy(*by).agg(F.max_by(version, "_v").alias(version))


def presence(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(metric, n): rows for which each condition holds, all in one aggregate."""
    one = rows.agg(*[F.count_if(c).alias(name) for name, c in flags.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("n")) for x in flags])))
