"""Findings of a linter by template, and outcomes of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.scalars import FINDING_CUTS, bucket, failure, md5_draw, template
from lodestack.operators.sampling import smallest_per_group


def findings(reports: DataFrame) -> DataFrame:
    """(report_id, relative, kind): one row per finding, by template; timed-out and failed runs say nothing."""
    told = reports.where(F.coalesce(~F.col("status").isin("timeout", "failed"), F.lit(True)))
    return told.select("report_id", F.col("source.relative").alias("relative"), F.explode("findings").alias("f")).select(
        "report_id", "relative", template(F.col("f")).alias("kind")
    ).where("kind is not null")


def template_counts(found: DataFrame) -> DataFrame:
    """(kind, n_findings, n_reports)."""
    per_report = found.groupBy("kind", "report_id").agg(F.count("*").alias("_n"))
    return per_report.groupBy("kind").agg(F.sum("_n").alias("n_findings"), F.count("*").alias("n_reports"))


def template_samples(found: DataFrame, k: int = 10) -> DataFrame:
    """(kind, relative): up to ``k`` files per template, by the hash of template and path."""
    distinct = found.where("relative is not null").select("kind", "relative").distinct()
    return smallest_per_group(distinct, ["kind"], md5_draw(F.col("kind"), F.col("relative")), ["relative"], k)


def outcomes(reports: DataFrame, by: list[str]) -> DataFrame:
    """Per group: runs, clean, dirty and failed ones, whether any is dirty, findings and their mean over told runs."""
    n = F.coalesce(F.size("findings"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    told = F.col("status").isin("clean", "dirty")
    out = reports.groupBy(*by).agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "clean").alias("clean"), F.count_if(F.col("status") == "dirty").alias("dirty"),
        F.count_if(F.col("status").isin("failed", "timeout")).alias("failed"), F.coalesce(F.bool_or(F.col("status") == "dirty"), F.lit(False)).alias("any_dirty"),
        F.coalesce(F.sum(F.when(told, n)), F.lit(0)).alias("findings"),
    )
    return out.withColumn("mean_findings", F.col("findings") / F.greatest(F.lit(1), F.col("clean") + F.col("dirty")))


def failures(reports: DataFrame) -> DataFrame:
    """(return_code, signature, n) of failed runs."""
    bad = reports.where(F.col("status").isin("failed", "timeout"))
    return bad.groupBy("return_code", failure(F.coalesce("stderr_first_line", F.lit("(none)"))).alias("signature")).agg(F.count("*").alias("n"))


def findings_histogram(reports: DataFrame) -> DataFrame:
    """(bucket, n): reports of told runs by number of findings."""
    told = reports.where(F.col("status").isin("clean", "dirty"))
    size = F.greatest(F.lit(0), F.coalesce(F.size("findings"), F.lit(0)))
    return told.groupBy(bucket(size, FINDING_CUTS, ">100").alias("bucket")).agg(F.count("*").alias("n"))
