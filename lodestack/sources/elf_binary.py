"""64-bit little-endian ELF images, read by Spark's binaryFile source, as nested rows.

Only the byte layout is decoded in Python; kind, role evidence and anomalies are column
expressions on the result (``operators.rules``).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.scalars import CLASSES, ENCODINGS, FILE_TYPES, MACHINES, SEGMENT_TYPES, flag_names, named
from lodestack.operators.rules import entry_in_executable, kind, malformed

MAGIC = b"\x7fELF"
_HEADER = struct.Struct("<HHIQQQIHHHHHH")
_SEGMENT = struct.Struct("<IIQQQQQQ")
_PAIR = struct.Struct("<qQ")
#: Header fields after the identification bytes, in file order.
_HEADER_NAMES = "elf_type machine version entry phoff shoff flags ehsize phentsize phnum shentsize shnum shstrndx".split()
# Tags of dynamic entries that are decoded.
_NEEDED, _STRTAB, _STRSZ, _SONAME, _RPATH, _RUNPATH, _FLAGS, _FLAGS_1 = 1, 5, 10, 14, 15, 29, 30, 0x6FFFFFFB
_PIE = 0x08000000

_U64 = pa.decimal128(20, 0)
_SEGMENT_TYPE = pa.struct([("index", pa.int32()), ("p_type", pa.int64()), ("flags", pa.int64()), *[(n, _U64) for n in "offset vaddr paddr filesz memsz align".split()]])
_SCHEMA = pa.schema([
    ("path", pa.string()), ("class", pa.int32()), ("data", pa.int32()), ("ident_version", pa.int32()), ("abi_version", pa.int32()), ("padding", pa.list_(pa.int32())), ("bad_table", pa.bool_()),
    ("header", pa.struct([(n, _U64) for n in _HEADER_NAMES])), ("program_headers", pa.list_(_SEGMENT_TYPE)), ("interpreter", pa.string()),
    ("dynamic", pa.struct([("needed", pa.list_(pa.string())), ("soname", pa.string()), ("rpath", pa.list_(pa.string())), ("runpath", pa.list_(pa.string())), ("flags", _U64), ("flags_1", _U64), ("terminated", pa.bool_())])),
    ("issues", pa.list_(pa.string())),
])
_SEGMENT_DDL = "array<struct<index int, p_type bigint, flags bigint, " + ", ".join(f"{n} decimal(20,0)" for n in "offset vaddr paddr filesz memsz align".split()) + ">>"
_DDL = (
    "path string, class int, data int, ident_version int, abi_version int, padding array<int>, bad_table boolean, header struct<" + ", ".join(f"{n} decimal(20,0)" for n in _HEADER_NAMES) + f">, program_headers {_SEGMENT_DDL}, interpreter string, "
    "dynamic struct<needed array<string>, soname string, rpath array<string>, runpath array<string>, flags decimal(20,0), flags_1 decimal(20,0), terminated boolean>, issues array<string>"
)


def _text(image: bytes, at: int, end: int) -> str:
    return image[at:end].split(b"\0", 1)[0].decode("utf-8", "replace")


def _segments(image: bytes, header: dict, issues: list[str]) -> tuple[list[dict], bool]:
    """The segments up to the end of the file, and whether the table is bad."""
    size, start, out = header["phentsize"], header["phoff"], []
    if header["phnum"] and size < _SEGMENT.size:
        issues.append("segment entries are too small")
        return out, True
    for index in range(header["phnum"]):
        at = start + index * size
        if at + _SEGMENT.size > len(image):
            issues.append("segment table leads past the end of the file")
            return out, True
        values = _SEGMENT.unpack_from(image, at)
        out.append({"index": index} | dict(zip(("p_type", "flags", "offset", "vaddr", "paddr", "filesz", "memsz", "align"), values)))
    return out, False


def _dynamic(image: bytes, segments: list[dict], issues: list[str]) -> dict | None:
    place = next((s for s in segments if s["p_type"] == 2), None)
    if place is None:
        return None
    end = place["offset"] + place["filesz"]
    if end > len(image):
        issues.append("dynamic segment leads past the end of the file")
        return None
    pairs, ended = [], False
    for at in range(place["offset"], end - _PAIR.size + 1, _PAIR.size):
        tag, value = _PAIR.unpack_from(image, at)
        if tag == 0:
            ended = True
            break
        pairs.append((tag, value))
    last = dict(pairs)  # of repeated tags the last holds
    table, size = last.get(_STRTAB), last.get(_STRSZ, 0)
    base = None
    if table is not None:
        for s in segments:
            if s["p_type"] == 1 and s["vaddr"] <= table and table + size <= s["vaddr"] + min(s["filesz"], s["memsz"]):
                base = s["offset"] + table - s["vaddr"]
                break
        else:
            issues.append("string table is not in a loadable segment")
    text = lambda offset: _text(image, base + offset, base + size) if base is not None and offset < size else None
    named_ = lambda tag: [t for t in (text(v) for k, v in pairs if k == tag) if t is not None]
    either = lambda tag: reduce(or_, (v for k, v in pairs if k == tag), 0)
    return {"needed": named_(_NEEDED), "soname": text(last[_SONAME]) if _SONAME in last else None, "rpath": named_(_RPATH), "runpath": named_(_RUNPATH), "flags": either(_FLAGS), "flags_1": either(_FLAGS_1), "terminated": ended}


def decode(path: str, image: bytes) -> dict:
    """One image as a row; what can't be read is null or left out and listed in ``issues``."""
    issues: list[str] = []
    row = {"path": path, "class": image[4] if len(image) > 4 else None, "data": image[5] if len(image) > 5 else None, "ident_version": image[6] if len(image) > 6 else None, "abi_version": image[8] if len(image) > 8 else None, "padding": list(image[9:16]), "bad_table": False, "header": None, "program_headers": [], "interpreter": None, "dynamic": None, "issues": issues}
    if len(image) < 64 or (row["class"], row["data"], row["ident_version"]) != (2, 1, 1):
        return row
    header = row["header"] = dict(zip(_HEADER_NAMES, _HEADER.unpack_from(image, 16)))
    if header["elf_type"] in (1, 4):
        return row
    segments, row["bad_table"] = _segments(image, header, issues)
    row["program_headers"] = segments
    if header["machine"] != 62:
        return row
    interp = next((s for s in segments if s["p_type"] == 3), None)
    if interp is not None:
        end = interp["offset"] + interp["filesz"]
        if end > len(image):
            issues.append("interpreter leads past the end of the file")
        else:
            row["interpreter"] = _text(image, interp["offset"], end)
    row["dynamic"] = _dynamic(image, segments, issues)
    return row


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from decimal import Decimal

    def fit(value, kind_):
        if value is None:
            return None
        if pa.types.is_decimal(kind_):
            return Decimal(value)
        if pa.types.is_struct(kind_):
            return {f.name: fit(value[f.name], f.type) for f in kind_}
        if pa.types.is_list(kind_):
            return [fit(x, kind_.value_type) for x in value]
        return value

    for batch in batches:
        rows, size = [], 0
        for path, content in zip(batch.column(0), batch.column(1)):  # one image at a time: images may be large
            row = decode(path.as_py(), content.as_py())
            rows.append({f.name: fit(row[f.name], f.type) for f in _SCHEMA})
            size += 1 + len(row["program_headers"])
            if size > 5_000:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the files below ``folder`` that begin with the ELF magic."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.substring("content", 1, 4) == F.lit(bytearray(MAGIC))).select("path", "content")


def structure(images: DataFrame) -> DataFrame:
    """Rows with format, header, program headers, dynamic section, role evidence and kind of each image (path, content).

    Addresses are decimal(20,0), as they fill all of 64 bits. Null contents are left out.
    """
    rows = images.where("content is not null").select("path", "content").mapInArrow(_scan, _DDL)
    h = F.col("header")
    c = lambda name: F.coalesce(F.exists("program_headers", lambda p: p["p_type"] == name), F.lit(False))
    code = lambda name: h[name].cast("int")
    evidence = F.struct(
        c(1).alias("has_pt_load"), c(2).alias("has_pt_dynamic"), F.col("interpreter").isNotNull().alias("has_pt_interp"),
        F.coalesce(entry_in_executable(h["entry"]), F.lit(False)).alias("entry_in_executable_load"), F.col("dynamic.soname").isNotNull().alias("has_soname"),
        F.coalesce((F.col("dynamic.flags_1") % (2 * _PIE)) >= _PIE, F.lit(False)).alias("df_1_pie"),
    )
    rows = rows.withColumn("role_evidence", evidence)
    segments = F.transform("program_headers", lambda p: p.withField("p_type_name", named(p["p_type"], SEGMENT_TYPES)).withField("flags_names", flag_names(p["flags"])))
    return rows.select(
        "path", "class", named(F.col("class"), CLASSES).alias("class_name"), named(F.col("data"), ENCODINGS).alias("data_name"), "header",
        named(code("elf_type"), FILE_TYPES).alias("elf_type_name"), named(code("machine"), MACHINES).alias("machine_name"), segments.alias("program_headers"),
        "interpreter", "dynamic", "role_evidence", "issues", kind(malformed=malformed(bad_table=F.col("bad_table"))).alias("kind"), "abi_version", "padding",
    )


def programs(structures: DataFrame) -> DataFrame:
    """The program report of each program: two kinds, with empty arrays for what a static one lacks."""
    own = lambda name: F.coalesce(F.col(f"dynamic.{name}"), F.array().cast("array<string>")).alias(name)
    status = F.struct(F.lit("not_computed").alias("status"))
    return structures.where(F.col("kind").isin("dynamic_program", "static_program")).select(
        "path", F.col("kind").alias("elf_kind"), F.col("header.entry").alias("entry"), "interpreter", F.col("dynamic.soname").alias("soname"),
        own("needed"), own("rpath"), own("runpath"), "role_evidence", status.alias("closure"), status.alias("relocation_plan"),
    )
