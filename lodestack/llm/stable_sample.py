"""A sample that stays the same across runs and partitionings and only grows as data is added.

Consistent weighted Poisson sampling: an identifier is selected when its hash, as a number in
[0, 1), is below weight times a constant. The weight of an identifier is the largest that was ever
seen for it (its running maximum), so no inclusion probability falls when rows are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.records import clean_path

#: Selected share of a file of one unit of weight, and the bytes of a unit.
RATE, UNIT = 0.02, 1 << 16


def uniform(identifier: Column, seed: str) -> Column:
    """52 bits of the MD5 of seed and identifier, divided by 2**52."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + "/"), identifier).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def size_weight(size: Column) -> Column:
    """Bytes in units of ``UNIT``, at least 1: null, zero or negative sizes weigh 1."""
    return F.greatest(F.lit(1.0), F.coalesce(size.cast("double"), F.lit(0.0)) / UNIT)


def running_weights(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(identifier, weight): the largest weight of each identifier in ``rows`` and ``stored``.

    Null identifiers are left out, null weights count as 0. Store the result and pass it as
    ``stored`` with the next rows: the outcome equals that of all rows at once.
    """
    both = rows.select("identifier", "weight") if stored is None else rows.select("identifier", "weight").unionByName(stored)
    known = both.where("identifier is not null")
    return known.groupBy("identifier").agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("weight"))


def poisson_sample(weights: DataFrame, rate: float = RATE, seed: str = "sample") -> DataFrame:
    """(identifier, weight, draw, probability) of the selected identifiers. No shuffle: each row decides for itself."""
    chance = F.least(F.lit(1.0), F.col("weight") * rate)
    drawn = weights.select("identifier", "weight", uniform(F.col("identifier"), seed).alias("draw"), chance.alias("probability"))
    return drawn.where("draw < probability")


def known_files(*reports: DataFrame) -> DataFrame:
    """(identifier, weight) of every row's path; spellings of one path are one identifier."""
    rows = [x.select(clean_path(F.col("source.relative")).alias("identifier"), size_weight(F.col("source.size")).alias("weight")) for x in reports]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out
