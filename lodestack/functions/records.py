"""Keys of the report tables: paths, record identities, library keys and terms.

Null or empty values never raise: each function states what they become.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space, tab and line ends.
WHITE = " \t\r\n"


def clean_path(relative: Column) -> Column:
    """``relative`` without empty and ``.`` components; null stays null."""
    parts = F.filter(F.split(relative, "/"), lambda x: (x != "") & (x != "."))
    return F.array_join(parts, "/")


def package_of(relative: Column) -> Column:
    """The second component of the cleaned path (the first is the repository); null where there is none."""
    return F.get(F.split(clean_path(relative), "/"), 1)


def library_key(entry: Column) -> Column:
    """The part after the last ``/`` of the trimmed entry; null where that is empty."""
    return F.nullif(F.substring_index(F.btrim(entry, F.lit(WHITE)), "/", -1), F.lit(""))


def term(entry: Column) -> Column:
    """The trimmed entry with inner runs of white space made one space; null where that is empty."""
    return F.nullif(F.regexp_replace(F.btrim(entry, F.lit(WHITE)), r"[ \t\r\n]+", " "), F.lit(""))


def keys_of(entries: Column, normalise=library_key) -> Column:
    """All values of an array of entries, repeated ones kept, nulls dropped; a null array becomes an empty one."""
    return F.coalesce(F.filter(F.transform(entries, normalise), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def record_id(source: str = "source") -> list[Column]:
    """128 bits that identify (path, sha256) as columns ``rec_a`` and ``rec_b``.

    Rows with the same path and the same digest (case of its hex digits ignored) are copies
    of one record. Nulls equal nulls: all rows that lack both belong to one record.
    """
    path = F.coalesce(clean_path(F.col(f"{source}.relative")), F.lit("\0"))
    sha = F.coalesce(F.lower(F.col(f"{source}.sha256")), F.lit("\0"))
    return [F.xxhash64(path, sha).alias("rec_a"), F.xxhash64(sha, path).alias("rec_b")]
