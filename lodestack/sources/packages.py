"""Package archives, their metadata and index, and logs of audited runs."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions.scalars import conflict_names, dependency_names, package_name


def metadata(files: DataFrame) -> DataFrame:
    """(package, key, values) of ``key = value`` lines in (package, text); repeated keys keep their order, comments and blanks are skipped."""
    lines = files.select("package", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).where(~F.trim("line").startswith("#"))
    at = F.instr("line", "=")
    pairs = lines.where(at > 0).select("package", "pos", F.trim(F.substring("line", F.lit(1), at - 1)).alias("key"), F.trim(F.substring(F.col("line"), at + 1, F.length("line"))).alias("value"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])
    return pairs.where("key <> ''").groupBy("package", "key").agg(ordered.alias("values"))


def index_records(texts: DataFrame) -> DataFrame:
    """(repo, record, tags) of (repo, text): blocks of ``T:value`` lines between blank lines; of a repeated tag the last holds."""
    blocks = texts.select("repo", F.posexplode(F.split("text", r"\r?\n[ \t]*\r?\n")).alias("record", "block"))
    pairs = F.filter(F.split("block", r"\r?\n"), lambda line: F.substring(line, 2, 1) == ":")
    tagged = F.transform(pairs, lambda line: F.struct(F.substring(line, 1, 1).alias("k"), F.trim(F.substring(line, 3, 1 << 20)).alias("v")))
    last = F.filter(tagged, lambda x, i: ~F.exists(F.slice(tagged, i + 2, F.size(tagged)), lambda y: y["k"] == x["k"]))
    return blocks.where(F.size(tagged) > 0).select("repo", "record", F.map_from_entries(last).alias("tags"))


def index_packages(records: DataFrame, repos: list[str]) -> DataFrame:
    """(name, version, priority, provides, depends, conflicts); of a name in several repositories the one in the last of ``repos`` holds."""
    rank = F.array_position(F.array(*map(F.lit, repos)), F.col("repo"))
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    names = lambda f, k: F.coalesce(f(tag(k)), F.array().cast("array<string>"))
    rows = records.where(tag("P").isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(tag("P")).orderBy(rank.desc(), F.desc("record"))))
    return rows.where("_r = 1").select(
        tag("P").alias("name"), tag("V").alias("version"), F.coalesce(tag("k").try_cast("int"), F.lit(0)).alias("priority"),
        names(dependency_names, "p").alias("provides"), names(dependency_names, "D").alias("depends"), names(conflict_names, "D").alias("conflicts"),
    )


def tag_providers(packages: DataFrame) -> DataFrame:
    """(tag, provider, priority): what each package provides, itself included."""
    tags = F.array_distinct(F.concat("provides", F.array("name")))
    return packages.select(F.explode(tags).alias("tag"), F.col("name").alias("provider"), "priority")


_MEMBERS = pa.schema([("package", pa.string()), ("path", pa.string()), ("link", pa.string()), ("content", pa.binary()), ("issue", pa.string())])


def archive_members(archives: DataFrame, magic: bytes = b"\x7fELF") -> DataFrame:
    """(package, path, link, content, issue) of the members of (package, content) archives that begin with ``magic``, and of all symbolic links.

    Compressed or not; the archive streams through the task, and other members are read no further
    than their first bytes. A damaged archive gives what precedes the damage and a row with the ``issue``.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not content.is_valid:
                    continue
                try:
                    with tarfile.open(fileobj=io.BytesIO(content.as_py()), mode="r|*", ignore_zeros=True) as archive:
                        for member in archive:
                            if member.issym():
                                yield _member(package, member.name, member.linkname, None, None)
                            elif member.isfile():
                                body = archive.extractfile(member)
                                if (head := body.read(len(magic))) == magic:
                                    yield _member(package, member.name, None, head + body.read(), None)
                except (tarfile.TarError, EOFError, OSError) as damage:
                    yield _member(package, None, None, None, str(damage) or type(damage).__name__)

    return archives.select("package", "content").mapInArrow(scan, "package string, path string, link string, content binary, issue string")


def _member(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _MEMBERS)], schema=_MEMBERS)


# Events of an audited run.
AUDIT_SCHEMA = (
    "file string, seq bigint, event string, requested int, got int, name string, lmid bigint, base string, n_objects bigint, n_mappings bigint,"
    " dso string, src string, off string, type string, sym string, value string, owner struct<dso: string, off: string>"
)


def audit_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of audited runs; a line that is cut off gives a row of nulls, which is left out."""
    return spark.read.schema(AUDIT_SCHEMA).json(path).where("event is not null")


def audit_outcomes(events: DataFrame) -> DataFrame:
    """(file, relocations, ok): a run is good with the fence ``consistent`` and any relocation."""
    fence = F.min(F.when(F.col("event") == "consistent", F.col("seq")))
    runs = events.groupBy("file").agg(F.count_if(F.col("event") == "reloc").alias("relocations"), fence.alias("fence"))
    return runs.select("file", "relocations", (F.col("fence").isNotNull() & (F.col("relocations") > 0)).alias("ok"))


def package_directories(files: DataFrame, repos: list[str]) -> DataFrame:
    """(repo, package, files) of the packages of each of ``repos`` that the paths name, ordered; a repo without any is a row with a null package.

    ``files`` (path) are paths that begin with repo and package.
    """
    parts = F.split("path", "/")
    found = files.where(F.size(parts) > 2).groupBy(F.get(parts, 0).alias("repo"), F.get(parts, 1).alias("package")).agg(F.count("*").alias("files"))
    wanted = files.sparkSession.createDataFrame([(r,) for r in repos], "repo string")
    return F.broadcast(wanted).join(found, "repo", "left").select("repo", "package", F.coalesce("files", F.lit(0)).alias("files")).orderBy("repo", "package")


def of_packages(files: DataFrame, repo: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Rows of ``files`` (path, ...) of a repository and of packages by their name without version and release."""
    parts = F.split("path", "/")
    kept = files if repo is None else files.where(F.get(parts, 0) == repo)
    return kept if names is None else kept.where(package_name(F.get(parts, 1)).isin(names))
