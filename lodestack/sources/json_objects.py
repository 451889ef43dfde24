"""Complete JSON objects in texts that hold anything: several objects, arrays, cut-off ends, leftovers, other content."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_decoder = json.JSONDecoder()


def objects(text: str) -> Iterator[dict]:
    """Each outermost object that is complete, from left to right.

    An opening brace that starts no complete object is passed over, so what follows a damaged
    object is still found, as are complete objects inside one.
    """
    at = text.find("{")
    while at >= 0:
        try:
            found, end = _decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            end = at + 1
        else:
            yield found
        at = text.find("{", end)


def _reports(text: str, whole: bool = True) -> Iterator[tuple]:
    waiting = list(objects(text))
    while waiting:
        x = waiting.pop()
        source = x.get("source")
        if not isinstance(source, dict):
            waiting += [y for v in x.values() for y in (v if isinstance(v, list) else [v]) if isinstance(y, dict)]
            continue
        relative, sha = source.get("relative"), source.get("sha256")
        kind = "elflint" if "elf_kind" in x else "elf" if "kind" in x else None
        if isinstance(relative, str) and isinstance(sha, str) and kind:
            size = source.get("size")
            size = size if isinstance(size, int) and -(2**63) <= size < 2**63 else None
            yield kind, relative, sha, size, json.dumps(x, sort_keys=True, separators=(",", ":")) if whole else None


_FOUND = pa.schema([("report_type", pa.string()), ("relative", pa.string()), ("sha256", pa.string()), ("size", pa.int64()), ("report", pa.string())])


def report_objects(files: DataFrame, whole: bool = True) -> DataFrame:
    """(file_id, modified_at, report_type, relative, sha256, size, report) for each complete report in ``content``.

    ``report`` is the object as JSON with sorted keys, null unless ``whole``. Null and empty contents give no row. One
    long text is read whole by one task; texts are independent of each other.
    """

    def scan(batches):
        for batch in batches:
            rows, owners = [], []
            for at, content in enumerate(batch.column(2)):
                if content.is_valid:
                    found = list(_reports(content.as_py(), whole))
                    rows += found
                    owners += [at] * len(found)
            columns = list(zip(*rows)) if rows else [[] for _ in _FOUND]
            own = batch.select([0, 1]).take(pa.array(owners, pa.int64()))
            arrays = [*own.columns, *(pa.array(_utf8(c), t.type) for c, t in zip(columns, _FOUND))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*own.schema.names, *_FOUND.names])

    kept = files.select("file_id", "modified_at", "content")
    time = kept.schema["modified_at"].dataType.simpleString()
    return kept.mapInArrow(scan, f"file_id bigint, modified_at {time}, report_type string, relative string, sha256 string, size bigint, report string")


def _utf8(values) -> list:
    """Lone surrogates, which JSON escapes can name, become question marks; Arrow holds valid UTF-8 only."""
    return [v.encode("utf-8", "replace").decode() if isinstance(v, str) and not v.isascii() else v for v in values]
