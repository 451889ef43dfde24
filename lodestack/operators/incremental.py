"""Work that is already done is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(inputs: DataFrame, done: DataFrame, keys: list[str], schema_version: int, force: bool = False) -> DataFrame:
    """Rows of ``inputs`` without a result of the current schema version; null keys are always pending."""
    if force:
        return inputs
    current = done.where(F.col("schema_version") == schema_version).select(*keys).distinct()
    return inputs.join(current, keys, "left_anti")


def distinct_contents(rows: DataFrame, content: str) -> DataFrame:
    """(digest, n): contents by SHA-256; null contents are left out."""
    known = rows.where(F.col(content).isNotNull())
    return known.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("digest")).agg(F.count("*").alias("n"))
