"""Sessions, table reading and materialisation in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_written: list[str] = []


def build(app: str = "lodestack", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench use; its workers find this package wherever they start."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


@cache
def _archive() -> str:
    package, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="lodestack-")
    atexit.register(shutil.rmtree, folder, True)
    return shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)


def ship(spark: SparkSession) -> None:
    """Send this package to the session's workers, which need not have it installed."""
    spark.sparkContext.addPyFile(_archive())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share.

    Where that is unset a local session gets a temporary folder of its own; any other raises
    ValueError, as a folder of the driver's machine isn't the executors'.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestack-")
        atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def _file_system(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def write(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet into the shared folder; ``release`` or the end of the process removes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestack-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, folder = _file_system(spark, path)
    files.deleteOnExit(folder)
    _written.append(path)
    return path


def bytes_below(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    files, folder = _file_system(spark, path)
    return files.getContentSummary(folder).getLength()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df``, written into the shared folder and read back.

    This cuts the lineage: what follows survives the loss of an executor without running
    the plan again, and a plan that is read several times runs once.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))


def measured(df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, dict]:
    """As ``materialise``, with aggregates over the rows that are taken as they are written: no job of their own."""
    seen = Observation()
    written = write(df.observe(seen, *[a.alias(k) for k, a in aggregates.items()]), name)
    return df.sparkSession.read.schema(df.schema).parquet(written), seen.get


def release(spark: SparkSession) -> None:
    """Remove everything that ``materialise`` wrote; results that still read it become invalid."""
    while _written:
        files, folder = _file_system(spark, _written.pop())
        files.delete(folder, True)
