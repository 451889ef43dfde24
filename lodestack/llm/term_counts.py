"""Frequency of every distinct term: occurrences, records that hold it, and whether it is too rare or too common.

Burst-trie counting. Each task counts its rows in a trie whose containers burst, behind what their
terms share, into one container per next character once they are full, and hands over its
containers as compact subtrees. Prefixes that are heavy over all tasks are burst further, which
routes each part of the trie to one task; there matching subtrees are merged, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.records import keys_of, library_key, record_id, term
from lodestack.session import materialise, table

#: Terms of a container before it bursts.
FULL = 256
#: Characters by which prefixes are told apart when subtrees are routed; what shares more is parted by hash.
DEEPEST = 64
#: Terms that a task holds before it hands over what it has and starts afresh.
MOST_TERMS = 400_000
#: A prefix with more than this part of all subtree entries is burst further.
HEAVY_PART = 512

_SUBTREES = pa.schema([
    ("field", pa.string()), ("prefix", pa.string()), ("rest", pa.list_(pa.string())),
    ("occurrences", pa.list_(pa.int64())), ("records", pa.list_(pa.int64())),
])
_ROUTED = _SUBTREES.append(pa.field("part", pa.int32()))
_SUBTREE_DDL = "field string, prefix string, rest array<string>, occurrences array<bigint>, records array<bigint>"


class BurstTrie:
    """Terms with two counters. A node is a container (a dict of suffixes to counters) or, once burst, a ``_Inner``."""

    def __init__(self) -> None:
        self.top: dict | _Inner = {}
        self.terms = 0

    def add(self, text: str, occurrences: int, records: int) -> None:
        at, above, edge, node = 0, None, "", self.top
        while isinstance(node, _Inner):
            if not text.startswith(node.skip, at):
                node = self._put(above, edge, node.parted(text, at))
            at += len(node.skip)
            if at == len(text):
                node.ends[0] += occurrences
                node.ends[1] += records
                return
            above, edge = node, text[at]
            node, at = above.below.setdefault(edge, {}), at + 1
        counters = node.get(text[at:])
        if counters:
            counters[0] += occurrences
            counters[1] += records
            return
        node[text[at:]] = [occurrences, records]
        self.terms += 1
        if len(node) > FULL:
            self._put(above, edge, _Inner.burst(node))

    def _put(self, above: _Inner | None, edge: str, node: _Inner) -> _Inner:
        if above:
            above.below[edge] = node
        else:
            self.top = node
        return node

    def subtrees(self) -> Iterator[tuple[str, dict]]:
        """(prefix, container) of each container that holds anything."""
        waiting: list[tuple[str, dict | _Inner]] = [("", self.top)]
        while waiting:
            prefix, node = waiting.pop()
            if isinstance(node, _Inner):
                prefix += node.skip
                if node.ends[1]:
                    yield prefix, {"": node.ends}
                waiting += [(prefix + c, x) for c, x in node.below.items()]
            elif node:
                yield prefix, node


class _Inner:
    """Characters that all terms below share (``skip``), then one child per next character; a term that ends here is in ``ends``."""

    def __init__(self, skip: str) -> None:
        self.skip, self.ends = skip, [0, 0]
        self.below: dict[str, dict | _Inner] = {}

    @classmethod
    def burst(cls, container: dict[str, list[int]]) -> _Inner:
        shared = commonprefix([min(container), max(container)])
        node = cls(shared)
        for text, counters in container.items():
            rest = text[len(shared) :]
            if rest:
                node.below.setdefault(rest[0], {})[rest[1:]] = counters
            else:
                node.ends = counters
        return node

    def parted(self, text: str, at: int) -> _Inner:
        """A new node above this one, where ``text`` leaves its ``skip``."""
        shared = commonprefix([self.skip, text[at : at + len(self.skip)]])
        node = _Inner(shared)
        node.below[self.skip[len(shared)]] = self
        self.skip = self.skip[len(shared) + 1 :]
        return node


def _batch(rows: list[tuple], schema: pa.Schema = _SUBTREES) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def _rows(field: str, prefix: str, container: dict[str, list[int]]) -> tuple:
    rest = sorted(container)
    return field, prefix, rest, [container[x][0] for x in rest], [container[x][1] for x in rest]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (field, term, n), one per distinct record and term, into the subtrees of this task's tries."""
    tries: dict[str, BurstTrie] = {}

    def hand_over() -> Iterator[pa.RecordBatch]:
        for field, trie in tries.items():
            rows = []
            for prefix, container in trie.subtrees():
                rows.append(_rows(field, prefix, container))
                if len(rows) == 256:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)
        tries.clear()

    for batch in batches:
        combined = pa.Table.from_batches([batch]).group_by(["field", "term"]).aggregate([("n", "sum"), ("n", "count")]).to_pydict()
        for field, text, n, records in zip(combined["field"], combined["term"], combined["n_sum"], combined["n_count"]):
            tries.setdefault(field, BurstTrie()).add(text, n, records)
        if sum(t.terms for t in tries.values()) > MOST_TERMS:
            yield from hand_over()
    yield from hand_over()


def _heavy(subtrees: DataFrame) -> dict[str, set[str]]:
    """Prefixes of up to DEEPEST characters that hold more than 1/HEAVY_PART of all entries: fewer than HEAVY_PART of each length."""
    loads = subtrees.select("field", F.substring("prefix", 1, DEEPEST).alias("prefix"), F.size("rest").alias("n")).groupBy("field", "prefix").agg(F.sum("n").alias("n"))
    along = loads.select(
        "field", "n", F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda i: F.substring("prefix", F.lit(1), i))).alias("p")
    )
    total = loads.agg(F.sum("n").alias("total"))
    found = along.groupBy("field", "p").agg(F.sum("n").alias("n")).join(F.broadcast(total), F.col("n") * HEAVY_PART > F.col("total"))
    heavy: dict[str, set[str]] = {}
    for row in found.select("field", "p").collect():
        heavy.setdefault(row.field, set()).add(row.p)
    return heavy


def _route(heavy: dict[str, set[str]]):
    """Cut subtrees at the shortest prefixes that are not heavy; where even DEEPEST characters are, their hash parts the rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                own, parts = heavy.get(x["field"], set()), {}
                known = next((k for k in range(min(len(x["prefix"]), DEEPEST) + 1) if x["prefix"][:k] not in own), None)
                for rest, n, records in zip(x["rest"], x["occurrences"], x["records"]):
                    text, k, part = x["prefix"] + rest, known, 0
                    if k is None:
                        k = next((k for k in range(len(x["prefix"]) + 1, min(len(text), DEEPEST) + 1) if text[:k] not in own), None)
                    if k is None:
                        k = min(len(text), DEEPEST)
                        part = crc32(text.encode("utf-8", "surrogatepass")) % HEAVY_PART
                    parts.setdefault((text[:k], part), {})[text[k:]] = [n, records]
                rows += [(*_rows(x["field"], prefix, container), part) for (prefix, part), container in parts.items()]
            yield _batch(rows, _ROUTED)

    return cut


_TERMS = pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by field, prefix and part: subtrees of one prefix are merged, then written out as terms."""
    at, container = None, {}

    def done() -> pa.RecordBatch:
        rows = [(at[0], at[1] + rest, *counters) for rest, counters in container.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _TERMS)], schema=_TERMS)

    for batch in batches:
        for x in batch.to_pylist():
            if (x["field"], x["prefix"], x["part"]) != at:
                if container:
                    yield done()
                at, container = (x["field"], x["prefix"], x["part"]), {}
            for rest, n, records in zip(x["rest"], x["occurrences"], x["records"]):
                counters = container.setdefault(rest, [0, 0])
                counters[0] += n
                counters[1] += records
    if container:
        yield done()


def term_frequencies(rows: DataFrame, few: int = 3) -> DataFrame:
    """(field, term, occurrences, records, holders, mark) for each distinct term.

    ``rows`` holds (field, terms, rec_a, rec_b), one row per row of a table and field, ``terms``
    being an array of non-null strings. ``occurrences`` counts the entries of all rows, ``records``
    the distinct records, ``holders`` the records with at least one term of the field. ``mark`` is
    ``rare`` below ``few`` records, else ``common`` above half of the holders, else null. Empty
    arrays count nothing; very long terms are kept whole; no rows give an empty table.
    """
    filled = rows.where(F.size("terms") > 0)
    pairs = (
        filled.select("field", "rec_a", "rec_b", F.explode("terms").alias("term"))
        .groupBy("field", "rec_a", "rec_b", "term").agg(F.count("*").alias("n"))
        .select("field", "term", "n")
    )
    subtrees = materialise(pairs.mapInArrow(_count, _SUBTREE_DDL), "subtrees")
    routed = subtrees.mapInArrow(_route(_heavy(subtrees)), _SUBTREE_DDL + ", part int")
    merged = routed.repartition("field", "prefix", "part").sortWithinPartitions("field", "prefix", "part")
    terms = merged.mapInArrow(_merge, "field string, term string, occurrences bigint, records bigint")
    holders = filled.groupBy("field", "rec_a", "rec_b").agg(F.lit(1)).groupBy("field").agg(F.count("*").alias("holders"))
    mark = F.when(F.col("records") < few, "rare").when(F.col("records") * 2 > F.col("holders"), "common")
    # one row per field: the broadcast is as small as the list of fields
    return terms.join(F.broadcast(holders), "field").withColumn("mark", mark)


def field_rows(df: DataFrame, field: str, entries: Column, normalise) -> DataFrame:
    return df.select(F.lit(field).alias("field"), keys_of(entries, normalise).alias("terms"), *record_id())


def report_terms(spark, sf_dir: str) -> DataFrame:
    """The term frequencies of ``needed``, ``p_type_name`` and ``normalized_findings`` in one job."""
    programs, elfs, lints = (table(spark, sf_dir, f"{x}_reports") for x in ("program", "elf", "elflint"))
    return term_frequencies(
        field_rows(programs, "needed", F.col("needed"), library_key)
        .unionByName(field_rows(elfs, "p_type_name", F.col("program_headers.p_type_name"), term))
        .unionByName(field_rows(lints, "normalized_findings", F.col("normalized_findings"), term))
    )
