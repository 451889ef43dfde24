"""Reports as a stream: windowed counts with late data, and the state of audited runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def counts_by_window(reports: DataFrame, time: str, by: list[str], width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window start, *by, n) of a stream: a window is final once events ``late`` past its end have come; null times are dropped."""
    timed = reports.where(F.col(time).isNotNull()).withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    counted = timed.groupBy(F.window("_t", width), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n")


def first_seen(reports: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Each key once, as it first arrives within the watermark; copies that follow are dropped by state."""
    return reports.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")


def run_states(events: DataFrame) -> DataFrame:
    """(file, fenced, relocations, ok) of a stream of audit events, one row per file and trigger that changes it.

    A file's state is dropped with its event ``end``; a file that never ends keeps two numbers.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fenced, relocations = state.get if state.exists else (False, 0)
        ended = False
        for part in parts:
            fenced = bool(fenced or (part["event"] == "consistent").any())
            relocations += int((part["event"] == "reloc").sum())
            ended = bool(ended or (part["event"] == "end").any())
        if not ended:
            state.update((fenced, relocations))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"file": [key[0]], "fenced": [fenced], "relocations": [relocations], "ok": [fenced and relocations > 0]})

    return events.groupBy("file").applyInPandasWithState(
        step, "file string, fenced boolean, relocations bigint, ok boolean", "fenced boolean, relocations bigint", "update", GroupStateTimeout.NoTimeout
    )
