"""Millions of tiny files into few well-sized ones, without losing or repeating a record.

Records get a Hilbert code of (package, size, time), finer the more files there will be; an exact
histogram of the codes, weighted by bytes, cuts the curve into files of equal size; rows move once,
straight to the task that writes their file. Source and destination are compared by digests that
don't depend on the order of rows.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions.records import clean_path, package_of
from lodestack.session import bytes_below, materialise, write

#: Bits per dimension, depending on the number of files.
LEAST_BITS, MOST_BITS = 5, 8
#: Files of one run: their bounds, 24 bytes each, go to every task.
MOST_FILES = 2_000_000


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Positions of points on the Hilbert curve; ``axes`` is (dimensions, points) of integers below 2**bits.

    From the highest bit down, each axis is reflected or exchanged with the first one according to
    its own bit; the Gray code of what remains, bits interleaved, is the position.
    """
    x = axes.astype(np.int64).copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
    x ^= flip
    code = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            code = (code << 1) | ((x[i] >> b) & 1)
    return code


def digest(records: DataFrame, *columns: str) -> Row:
    """(records, checksum, parity) of the rows' ``columns``, whatever their order."""
    h = F.xxhash64(*columns)
    return records.agg(F.count("*").alias("records"), F.sum(h.cast("decimal(38,0)")).alias("checksum"), F.bit_xor(h).alias("parity")).first()


@dataclass
class Compacted:
    """``records`` as read back from ``path``; ``files`` (file_no, records, text_bytes, file_bytes)."""

    records: DataFrame
    files: DataFrame
    n_files: int
    path: str


def identities(found: DataFrame) -> DataFrame:
    """(report_type, path, lower-case sha256) of each row."""
    return found.select("report_type", clean_path(F.col("relative")).alias("relative"), F.lower("sha256").alias("sha256"))


def distinct_reports(found: DataFrame) -> DataFrame:
    """One row per (report_type, path, lower-case sha256): of several versions the one last modified,
    then of the highest file_id, then the largest text. Null times are older than all others."""
    rows = found.select(
        "report_type", clean_path(F.col("relative")).alias("relative"), F.lower("sha256").alias("sha256"), "modified_at", "file_id", "size", "report"
    )
    best = F.max(F.struct("modified_at", "file_id", "report", "size")).alias("best")
    return rows.groupBy("report_type", "relative", "sha256").agg(best).select(
        "report_type", "relative", "sha256", "best.modified_at", "best.file_id", "best.size", "best.report"
    )


def bits_for(n_files: int) -> int:
    """Bits per dimension: at least eight cells a file up to 2**21 files, 32,768 cells at least."""
    return min(MOST_BITS, max(LEAST_BITS, -(-(8 * max(1, n_files) - 1).bit_length() // 3)))


def package_bounds(records: DataFrame, bits: int) -> list[str]:
    """At most 2**bits - 1 packages in byte order that cut the distinct packages into parts of equal number.

    Packages are ranked where a sort by ranges puts them; only the sizes of its partitions are added up in one task.
    """
    own = records.select(_package().alias("package")).distinct().orderBy("package")
    at = materialise(own.select("package", F.monotonically_increasing_id().alias("at")), "packages")
    parts = at.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the sort
    before = parts.select("part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    ranked = at.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(before), "part")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    slots, n = 1 << bits, at.count()
    slot = lambda r: F.floor(r * slots / max(1, n))
    cut = ranked.where((rank > 0) & (slot(rank) > slot(rank - 1))).select("package").orderBy("package").collect()
    return [r.package for r in cut]


def coded(records: DataFrame, n_files: int) -> tuple[DataFrame, int]:
    """``records`` with ``code``, the Hilbert position of (package, size, month), and the bits per dimension.

    Packages keep their order, sizes go by their logarithm, months by their distance from the first; nulls come first.
    """
    bits = bits_for(n_files)
    bounds = package_bounds(records, bits)
    first, last = records.agg(F.min(_month()), F.max(_month())).first()
    most, months = (1 << bits) - 1, (last or 0) - (first or 0) + 2

    @F.pandas_udf(T.IntegerType())
    def slot(packages: pd.Series) -> pd.Series:
        keys = [b.encode() for b in bounds]
        return pd.Series([bisect_right(keys, p.encode()) for p in packages], dtype="int32")

    @F.pandas_udf(T.LongType())
    def hilbert_code(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.stack([a, b, c]), bits))

    size = F.floor(F.log2(F.greatest(F.coalesce("size", F.lit(1)), F.lit(1)).cast("double")) * (1 << (bits - LEAST_BITS)))
    month = F.floor((F.coalesce(_month() - (first or 0) + 1, F.lit(0))) * (most + 1) / months)
    axes = [slot(_package()), *(F.least(F.lit(most), F.greatest(F.lit(0), x)).cast("int") for x in (size, month))]
    return records.withColumn("code", hilbert_code(*axes)), bits


def _package() -> Column:
    return F.coalesce(package_of(F.col("relative")), F.lit(""))


def _month() -> Column:
    return F.year("modified_at") * 12 + F.month("modified_at")


def _weight() -> Column:
    return F.octet_length("report").cast("bigint") + 1


def place(records: DataFrame, text_bytes: float, bits: int) -> tuple[DataFrame, int]:
    """``records`` (with ``code`` and ``report``) and their ``file_no``; the number of files.

    The exact histogram of codes is summed up along the curve in two levels: over at most 32,768 coarse
    cells in one task, and within each of them over at most 2**(3 * bits - 15) cells. What reaches the tasks is
    one row for each file and split cell, at most 2 * MOST_FILES. A cell with more bytes than a file is split by hash.
    """
    shift = max(0, 3 * bits - 15)
    cells = materialise(records.groupBy("code").agg(F.sum(_weight()).alias("bytes")).withColumn("coarse", F.shiftright("code", shift)), "cells")
    along = Window.orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    coarse = cells.groupBy("coarse").agg(F.sum("bytes").alias("n")).select("coarse", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("base"))
    within = Window.partitionBy("coarse").orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.join(F.broadcast(coarse), "coarse").select(
        "code",
        F.floor((F.col("base") + F.coalesce(F.sum("bytes").over(within), F.lit(0))) / text_bytes).alias("first"),
        F.greatest(F.lit(1), F.ceil(F.col("bytes") / text_bytes)).alias("parts"),
    )
    # the first cell of each file, each split cell, and each cell that comes after a split one
    starts = cells.where("parts = 1").groupBy("first").agg(F.min("code").alias("code"), F.lit(1).cast("bigint").alias("parts"))
    starts = starts.select("code", "first", "parts").unionByName(cells.where("parts > 1").select("code", "first", "parts"))
    table = starts.limit(2 * MOST_FILES + 1).toPandas().sort_values(["code", "parts"]).reset_index(drop=True)
    if len(table) > 2 * MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files: choose larger ones")
    code, first, parts = (table[c].to_numpy(np.int64) for c in ("code", "first", "parts"))

    @F.pandas_udf(T.LongType())
    def file_no(codes: pd.Series, hashes: pd.Series) -> pd.Series:
        at = np.searchsorted(code, codes.to_numpy(np.int64), side="right") - 1
        own = (code[at] == codes) & (parts[at] > 1)
        return pd.Series(first[at] + np.where(own, hashes.to_numpy(np.int64) % parts[at], 0))

    placed = records.withColumn("file_no", file_no("code", F.xxhash64("relative", "sha256", "report_type")))
    return placed, int((first + parts).max()) if len(table) else 1


def compact(found: DataFrame, file_bytes: int = 128 << 20, to: str | None = None, source: DataFrame | None = None) -> Compacted:
    """Write each distinct report of ``found`` exactly once into files of about ``file_bytes``, as written and compressed.

    ``found`` is what ``report_objects`` gives. The files stay in the folder ``to``; without it they go to the shared
    folder and are removed at the end of the session. ``source`` (report_type, relative, sha256) is a scan of the
    source of its own, by default that of ``found``: raises ValueError where its distinct
    reports and those in the destination differ, or their texts. No reports give an empty table.
    """
    spark = found.sparkSession
    at = write(distinct_reports(found), "staged")
    staged = spark.read.parquet(at)
    text = staged.agg(F.sum(_weight())).first()[0] or 0
    written_part = min(1.0, bytes_below(spark, at) / text) if text else 1.0
    text_bytes = max(1.0, file_bytes / written_part)
    records, bits = coded(staged, int(text / text_bytes) + 1)
    placed, n_files = place(records, text_bytes, bits)
    out = placed.repartitionById(n_files, F.col("file_no").cast("int")).sortWithinPartitions("code", "relative", "sha256", "report_type")
    if to is None:
        to = write(out, "compacted")
    else:
        out.write.option("compression", "zstd").mode("errorifexists").parquet(to)
    written = spark.read.schema(out.schema).parquet(to)
    names = ["report_type", "relative", "sha256"]
    for before, after, what in (
        (identities(found if source is None else source).distinct(), written, names), (staged, written, [*names, "report"])
    ):
        if (a := digest(before, *what)) != (b := digest(after, *what)):
            raise ValueError(f"source {a} and destination {b} differ in {what}")
    sizes = written.select("file_no", "report", F.col("_metadata.file_size").alias("size"))
    files = sizes.groupBy("file_no").agg(F.count("*").alias("records"), F.sum(F.octet_length("report").cast("bigint")).alias("text_bytes"), F.max("size").alias("file_bytes"))
    return Compacted(written, files, n_files, to)
