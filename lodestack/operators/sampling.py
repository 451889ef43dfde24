"""Rankings and samples that come out the same in every run: all ties are broken by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smallest_per_group(rows: DataFrame, by: list[str], score: Column, ties: list[str], k: int) -> DataFrame:
    """The ``k`` rows of each group with the smallest score.

    The window is limited before its shuffle (each task keeps k rows per group), so a group that
    holds most rows costs no more than any other.
    """
    ordered = Window.partitionBy(*by).orderBy("_score", *ties)
    return rows.withColumn("_score", score).withColumn("_rank", F.row_number().over(ordered)).where(F.col("_rank") <= k).drop("_score", "_rank")


def top(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows, kept in a heap per task; ``order`` must be total."""
    return rows.orderBy(*order).limit(k)


def first_with_total(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows, each with the number of all rows (``total``)."""
    return top(rows, order, k).join(F.broadcast(rows.agg(F.count("*").alias("total"))))
