"""References to records that do not exist, per table and period.

A broadcast Bloom filter of the parent keys proves most orphans; only references that pass it
meet the parents in an exact join, in which hot keys are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.records import clean_path, keys_of, library_key
from lodestack.operators import bloom
from lodestack.operators.skew import salted_lookup
from lodestack.session import materialise

#: A row without arrival time counts as arriving after all others.
LAST = "timestamp_ntz'9999-12-31 00:00:00'"
NEVER = "timestamp_ntz'9999-12-31 23:59:59'"
def merged(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Union of half-open intervals [lo, hi) per group: overlapping and touching ones become one."""
    before = Window.partitionBy(*by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("lo") > F.max("hi").over(before), F.lit(True))
    return (
        intervals.withColumn("_opens", opens.cast("int"))
        .withColumn("_island", F.sum("_opens").over(upto))
        .groupBy(*by, "_island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("_island")
    )


def _month(time: str | Column) -> Column:
    return F.year(time) * 12 + F.month(time)


def lives(reports: DataFrame, removals: DataFrame) -> DataFrame:
    """(key, month, lo, hi): when providers of a soname key live, from arrival to the first removal of their path at or after it.

    ``month`` is that of the arrival. Providers that end together are combined before the shuffle to
    the earliest of each month: files that were never removed are one row per key and month, however many
    there are. Rows with hi = lo give no life but count as known.
    """
    gone = (
        removals.select(clean_path(F.col("relative")).alias("path"), F.col("removed_at").alias("at"))
        .where("path is not null and at is not null")
        .groupBy("path")
        .agg(F.sort_array(F.collect_set("at")).alias("gone"))
    )
    rows = reports.select(
        library_key(F.col("soname")).alias("key"),
        clean_path(F.col("source.relative")).alias("path"),
        F.coalesce("arrived_at", F.expr(LAST)).alias("lo"),
    ).where("key is not null")
    end = F.array_min(F.filter("gone", lambda r: r >= F.col("lo")))
    known = rows.join(gone, "path", "left").select("key", _month("lo").alias("month"), "lo", F.coalesce(end, F.expr(NEVER)).alias("hi"))
    return known.groupBy("key", "month", "hi").agg(F.min("lo").alias("lo"), F.max("lo").alias("last"))


def parents(lived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, last_arrival, months) and (key, month, periods) from ``lives``.

    ``months`` holds (month, until): of the lives that began in a month the latest end. So it is as
    long as there are months, and whether a life of an earlier month still lasts needs nothing else. ``periods``
    are the merged lives that began in one month.
    """
    by_month = lived.groupBy("key", "month").agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("hi"))).alias("until"), F.max("last").alias("last"))
    keys = by_month.groupBy("key").agg(F.max("last").alias("last_arrival"), F.collect_list(F.struct("month", "until")).alias("months"))
    periods = merged(lived.where("lo < hi").select("key", "month", "lo", "hi"), ["key", "month"])
    return keys, periods.groupBy("key", "month").agg(F.collect_list(F.struct("lo", "hi")).alias("periods"))


def orphan_references(reports: DataFrame, base: DataFrame, removals: DataFrame) -> DataFrame:
    """(report_id, needed, status, period): each distinct ``needed`` key of a row that nothing answers.

    ``base`` lists libraries that are present at all times. A key is answered at the row's arrival
    by a row of ``reports`` with this soname that has arrived and whose path was not removed since.
    Otherwise the status is ``missing`` (no row has the soname), ``late`` (one arrives afterwards) or
    ``deleted``. Nulls: rows without arrival time arrive last of all, without ``analyzed_at`` the
    period is null, removals without path or time do nothing, null or blank entries are no keys.
    """
    sonames = reports.select(library_key(F.col("soname")).alias("key")).where("key is not null")
    words = bloom.words_for(sonames.agg(F.approx_count_distinct("key")).first()[0])
    refs = reports.select(
        "report_id",
        F.coalesce("arrived_at", F.expr(LAST)).alias("at"),
        F.date_format("analyzed_at", "yyyy-MM").alias("period"),
        F.explode(F.array_distinct(keys_of(F.col("needed")))).alias("key"),
    )
    always = base.select(library_key(F.col("soname")).alias("key")).where("key is not null").distinct()
    refs = refs.join(always, "key", "left_anti")  # broadcast or not as its size on disk says
    asked = materialise(bloom.probe(refs, "key", bloom.build(sonames, "key", words), words), "references")
    proven = asked.where("not maybe").select("report_id", "key", F.lit("missing").alias("status"), "period")
    keys, periods = parents(materialise(lives(reports, removals), "lives"))
    found = salted_lookup(asked.where("maybe").drop("maybe"), keys, "key")
    own = F.col("month")
    found = found.withColumn("month", _month("at")).withColumn("lasts", F.coalesce(F.exists("months", lambda m: (m["month"] < own) & (m["until"] > F.col("at"))), F.lit(False)))
    found = found.where("not lasts").withColumn("same", F.coalesce(F.exists("months", lambda m: m["month"] == own), F.lit(False))).drop("months", "lasts")
    found = materialise(found, "unanswered")
    # only what began in the reference's own month is left to look at
    began = salted_lookup(found.where("same").withColumn("at_month", F.struct("key", "month")).drop("month"), periods.select(F.struct("key", "month").alias("at_month"), "periods"), "at_month")
    began = began.where(~F.coalesce(F.exists("periods", lambda p: (p["lo"] <= F.col("at")) & (F.col("at") < p["hi"])), F.lit(False)))
    columns = ["report_id", "key", "at", "period", "last_arrival"]
    status = F.when(F.col("last_arrival").isNull(), "missing").when(F.col("last_arrival") > F.col("at"), "late").otherwise("deleted")
    checked = found.where("not same").select(columns).unionByName(began.select(columns)).select("report_id", "key", status.alias("status"), "period")
    return proven.unionByName(checked).withColumnRenamed("key", "needed").select("report_id", "needed", "status", "period")


def orphans_by_period(orphans: DataFrame, table: str) -> DataFrame:
    """(table_name, period, status, n_references, n_keys): the report; counting distinct keys is two map-side combined steps."""
    keyed = orphans.groupBy("period", "status", "needed").agg(F.count("*").alias("n"))
    return keyed.groupBy("period", "status").agg(F.sum("n").alias("n_references"), F.count("*").alias("n_keys")).select(
        F.lit(table).alias("table_name"), "period", "status", "n_references", "n_keys"
    )
