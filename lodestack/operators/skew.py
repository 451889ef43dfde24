"""Per-key results where a few keys hold most rows.

Map-side combining: rows move once, as they are, to the task of their package, where copies of a
record are united and the keys are counted in bounded hash tables (which spill by themselves); only
these partial states, one row per key and task, are shuffled to be merged. A key with a third of all
rows is one row per task like any other, and a package with a third of all rows is spread by record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.records import keys_of, library_key, package_of, record_id

#: A key with more than this part of all rows is hot, so there are fewer hot keys than that, whatever the data.
HOT_PART = 200


def hot_keys(rows: DataFrame, key: str, hot_part: int = HOT_PART) -> DataFrame:
    """(key, _salts) of the keys with more than 1/``hot_part`` of the rows: fewer than ``hot_part`` rows, so it may be broadcast.

    ``_salts`` is the number of parts that leaves none with more than 1/``hot_part`` of all rows.
    """
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_all"))
    hot = counted.join(F.broadcast(total), F.col("_n") * hot_part > F.col("_all"))
    return hot.select(key, F.ceil(F.col("_n") * hot_part / F.col("_all")).cast("int").alias("_salts"))


def salted_lookup(rows: DataFrame, lookup: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """``rows`` left-joined to ``lookup``, each hot key spread over as many tasks as its share of the rows asks for.

    The ``lookup`` rows of a hot key are copied once per part. ``rows`` is read twice: pass a table
    that is cheap to read, or ``hot`` (of ``hot_keys``) where it is known. Rows with a null key keep nulls.
    """
    hot = F.broadcast(hot_keys(rows, key) if hot is None else hot)
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_salts")).cast("int"), F.lit(0))
    spread = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_salts")
    copies = lookup.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return spread.join(copies, [key, "_salt"], "left").drop("_salt")


def key_totals(reports: DataFrame) -> DataFrame:
    """(field, key, records, packages, share) for each key of ``needed`` and ``soname``.

    ``records`` counts distinct records and ``packages`` distinct non-null packages that hold the
    key (the second component of the path); ``share`` is the key's part of all distinct (record, key) pairs of the field. Copies of a
    record count once, null arrays, null, empty and blank entries count nothing, an empty table
    gives no row.
    """
    package = F.coalesce(package_of(F.col("source.relative")), F.lit("\0"))  # stands for none
    needed, soname = F.array_distinct(keys_of(F.col("needed"))), library_key(F.col("soname"))
    rows = reports.select(package.alias("package"), *record_id(), needed.alias("needed"), soname.alias("soname"))
    hot = hot_keys(rows.select("package"), "package")
    rows = rows.join(F.broadcast(hot), "package", "left").withColumn("_salt", F.coalesce(F.pmod("rec_a", F.col("_salts")), F.lit(-1)))
    # a record's copies share its path, hence its package and salt: what follows up to the states needs no shuffle
    placed = rows.drop("_salts").repartition("package", "_salt")
    tagged = F.array(*[F.struct(F.lit(f).alias("field"), keys.alias("keys")) for f, keys in (("needed", F.col("needed")), ("soname", F.array_compact(F.array("soname"))))])
    pairs = placed.select("package", "_salt", "rec_a", "rec_b", F.inline(tagged)).select("package", "_salt", "rec_a", "rec_b", "field", F.explode("keys").alias("key")).distinct()
    states = pairs.groupBy("package", "_salt", "field", "key").agg(F.count("*").alias("n"))
    # a package that lies in one task counts there; one that is spread is named, to count once
    spread, known = F.col("_salt") >= 0, F.col("package") != "\0"
    states = states.select("field", "key", "n", (known & ~spread).cast("int").alias("whole"), F.when(known & spread, F.col("package")).alias("spread"))
    merged = states.groupBy("field", "key", "spread").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole"))
    totals = merged.groupBy("field", "key").agg(F.sum("n").alias("records"), (F.sum("whole") + F.count("spread")).alias("packages"))
    fields_total = totals.groupBy("field").agg(F.sum("records").alias("pairs"))  # one row per field
    return totals.join(F.broadcast(fields_total), "field").select(
        "field", "key", "records", "packages", (F.col("records") / F.col("pairs")).alias("share"), "pairs"
    )


def heavy_keys(totals: DataFrame, percent: int = 2) -> DataFrame:
    """(field, key) of keys with more than ``percent`` % of their field's distinct (record, key) pairs."""
    return totals.where(F.col("records") * 100 > F.col("pairs") * percent).select("field", "key")
