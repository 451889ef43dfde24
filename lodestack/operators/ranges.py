"""Points in ranges, runs of neighbours, bitmaps and positional comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_lookup(points: DataFrame, ranges: DataFrame, by: list[str], point: str, lo: str, hi: str, width: int, wide: int = 64) -> DataFrame:
    """Each point with each range of its group that holds it, lo <= point < hi; an equi-join on cells of ``width``.

    A range is copied to the cells it touches. Ranges over more than ``wide`` cells are joined once
    more on cells ``wide`` times as large, and so on, so that no range is copied more than ``wide`` + 1
    times. Empty ranges and nulls match nothing. Columns of both sides besides ``by`` must differ.
    """
    kept = ranges.where(F.col(lo) < F.col(hi))
    span = F.floor((F.col(hi) - 1) / width) - F.floor(F.col(lo) / width)
    level = F.when(span <= wide, 0)
    for k in range(1, 8):
        level = level.when(span <= wide * wide**k, k)
    tagged = kept.withColumn("_level", level.otherwise(8))
    size = F.lit(width) * F.pow(F.lit(float(wide)), F.col("_level"))
    cells = tagged.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor((F.col(hi) - 1) / size))))
    present = tagged.agg(F.collect_set("_level").alias("_levels"))  # one row with at most nine numbers
    levels = F.transform("_levels", lambda k: F.struct(k.alias("_level"), F.floor(F.col(point) / (F.lit(width) * F.pow(F.lit(float(wide)), k))).alias("_cell")))
    asked = points.where(F.col(point).isNotNull()).join(F.broadcast(present)).select(*points.columns, F.inline(levels))
    hit = (F.col(lo) <= F.col(point)) & (F.col(point) < F.col(hi))
    return asked.join(cells, [*by, "_level", "_cell"]).where(hit).drop("_level", "_cell")


def islands(rows: DataFrame, by: list[str], order: list[str], starts: Column, *aggregates: Column) -> DataFrame:
    """One row per run of neighbours: a run begins where ``starts`` is true or null (it may look back with windows)."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    opened = rows.withColumn("_s", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("island", F.sum("_s").over(upto))
    return opened.groupBy(*by, "island").agg(*aggregates)


def set_bits(value: Column, bits: int = 64) -> Column:
    """Positions of the bits that are set, lowest first; the sign bit is position 63."""
    return F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit(value, i) == 1)


def bitmap_slots(words: DataFrame, by: list[str], order: str, word: str) -> DataFrame:
    """(*by, slot) of a compressed address list: an even word is a slot; an odd one marks, by its bits 1 to 63, which of the
    63 slots of 8 bytes after the last base or bitmap follow. Bitmaps before any slot are counted from 0."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    is_base = F.col(word).bitwiseAND(F.lit(1)) == 0
    rows = words.withColumn("_is", is_base).withColumn("_group", F.sum(F.col("_is").cast("int")).over(before))
    own = Window.partitionBy(*by, "_group").orderBy(order)
    rows = rows.withColumn("_base", F.coalesce(F.first(F.when(F.col("_is"), F.col(word)), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)) + 8, F.lit(0)))
    rows = rows.withColumn("_nth", F.sum((~F.col("_is")).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    marked = F.transform(F.filter(set_bits(F.col(word)), lambda i: i > 0), lambda i: F.col("_base") + (F.col("_nth") * 63 + i - 1) * 8)
    return rows.select(*by, F.explode(F.when(F.col("_is"), F.array(word)).otherwise(marked)).alias("slot"))


def positional_changes(old: Column, new: Column) -> Column:
    """[(pos, was, now)] where two arrays differ, compared position by position; the shorter one is filled up with null."""
    both = F.zip_with(old, new, lambda a, b: F.struct(a.alias("was"), b.alias("now")))
    numbered = F.transform(both, lambda x, i: F.struct(i.alias("pos"), x["was"].alias("was"), x["now"].alias("now")))
    return F.filter(numbered, lambda x: ~x["was"].eqNullSafe(x["now"]))


def load_base(mappings: DataFrame, by: list[str], path: str, start: str, run: str | None = None) -> DataFrame:
    """``mappings`` with ``base``, the lowest start of all mappings of the same file, or only of those of the same ``run`` of neighbours."""
    return mappings.withColumn("base", F.min(start).over(Window.partitionBy(*by, path, *([run] if run else []))))
