"""Queries of the general problems, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import compaction, hierarchy, orphans, skew
from lodestack.session import table
from lodestack.sources.json_objects import report_objects


def _compacted(spark: SparkSession, d: str, file_bytes: int = 128 << 20) -> compaction.Compacted:
    files = table(spark, d, "report_files")
    return compaction.compact(report_objects(files), file_bytes, source=report_objects(files, whole=False))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _compacted(spark, d).records.select("report_type", "relative", "sha256")


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """What was written: records and bytes by file."""
    return _compacted(spark, d).files


def p2_layout(spark: SparkSession, d: str) -> DataFrame:
    """As ``p2_files`` for files of 12 KB, so that small tables, too, show how records are spread over many files."""
    return _compacted(spark, d, 12 << 10).files


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(*(table(spark, d, x) for x in ("program_reports", "graph_record", "removals")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p3_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans_by_period(_orphans(spark, d), "program_reports")


def _libraries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return hierarchy.library_edges(table(spark, d, "program_reports"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(*_libraries(spark, d)).select(F.col("node").alias("soname"), "root", "depth", "state")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path, and how many libraries hang below each; keys hold no slash, so the joined path is unambiguous."""
    tree = hierarchy.hierarchy(*_libraries(spark, d), paths=True)
    return tree.select(F.col("node").alias("soname"), F.array_join("path", "/").alias("path"), "descendants", "state")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(*_libraries(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(skew.key_totals(table(spark, d, "program_reports")))


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_totals(table(spark, d, "program_reports")).select("field", "key", "records", "packages")


QUERIES = {f.__name__: f for f in (p2_found, p2_files, p2_layout, p3_found, p3_by_period, p4_found, p4_paths, p4_descendants, p6_found, p6_totals)}

_PATH = "array_to_string(list_filter(string_split({0}, '/'), lambda x: x <> '' and x <> '.'), '/')"
_KEY = r"nullif(regexp_extract(trim({0}, E' \t\r\n'), '[^/]*$'), '')"
_KEYS = "list_filter(list_transform(coalesce({0}, []), lambda x: " + _KEY.format("x") + "), lambda y: y is not null)"
_ORPHANS = f"""
    with refs as (select report_id, arrived_at as t, strftime(analyzed_at, '%Y-%m') as period, unnest(list_distinct({_KEYS.format("needed")})) as k from program_reports),
    base as (select distinct {_KEY.format("soname")} as k from graph_record where {_KEY.format("soname")} is not null),
    gone as (select distinct {_PATH.format("relative")} as p, removed_at as r from removals),
    prov as (select {_KEY.format("soname")} as k, {_PATH.format("source.relative")} as p, arrived_at as s from program_reports),
    life as (select k, s, min(r) as e from prov left join gone on gone.p = prov.p and r >= s where k is not null group by k, prov.p, s),
    known as (select k, max(s) as last_s from life group by k),
    dead as (select * from refs where k not in (select k from base) and not exists (select 1 from life where life.k = refs.k and s <= t and (e is null or t < e))),
    orphans as (select report_id, dead.k as needed, case when last_s is null then 'missing' when last_s > t then 'late' else 'deleted' end as status, period from dead left join known on known.k = dead.k)
"""
_TREE = f"""
    with recursive rows_ as (select {_KEY.format("soname")} as node, {_KEYS.format("needed")} as keys from program_reports),
    nodes as (select distinct node from rows_ where node is not null),
    named as (select node, unnest(keys) as parent from rows_ where node is not null),
    edges as (select node, min(parent) as parent from named where parent in (select node from nodes) group by node),
    up as (select node, node as here, 0 as steps, [node] as path from nodes
           union all select up.node, e.parent, steps + 1, list_prepend(e.parent, path) from up join edges e on e.node = up.here where not list_contains(path, e.parent)),
    ends as (select up.*, e.parent as next from up left join edges e on e.node = up.here where e.parent is null or list_contains(path, e.parent)),
    -- a walk that ends before a node of its own path has met a loop: from that node to the end
    met as (select *, list_position(path, next) as back from ends),
    ring as (select *, case when next is null then null else path[1:back] end as loop_ from met),
    tree as (select node, next is null as rooted, case when next is null then here else list_min(loop_) end as root,
             case when next is null then steps else len(path) - back end as depth,
             case when next is null then 'tree' when back = len(path) then 'cycle' else 'below_cycle' end as state,
             case when next is null then path when back = len(path) then [node] else path[back:] end as path from ring)
"""
_TOTALS = f"""
    with rows_ as (select {_PATH.format("source.relative")} as p, lower(source.sha256) as sha, {_KEYS.format("needed")} as nk, {_KEYS.format("[soname]")} as sk from program_reports),
    both_ as (select 'needed' as field, p, sha, unnest(nk) as key from rows_ union all select 'soname', p, sha, unnest(sk) from rows_),
    pairs as (select distinct field, p, sha, key from both_),
    totals as (select field, key, count(*) as records, count(distinct string_split(p, '/')[2]) as packages from pairs group by all)
"""
SQL = {
    "p3_found": _ORPHANS + "select * from orphans",
    "p3_by_period": _ORPHANS + "select 'program_reports' as table_name, period, status, count(*) as n_references, count(distinct needed) as n_keys from orphans group by all",
    "p4_found": _TREE + "select node as soname, root, depth, state from tree",
    "p4_descendants": _TREE + "select path[i] as ancestor, node as descendant, len(path) - i as distance from (select node, path, unnest(range(1, len(path))) as i from tree)",
    "p4_paths": _TREE + """, below as (select a as node, count(*) as n from (select unnest(path[1:len(path) - 1]) as a from tree) group by 1)
        select tree.node as soname, array_to_string(path, '/') as path, coalesce(n, 0) as descendants, state from tree left join below on below.node = tree.node""",
    "p6_found": _TOTALS + "select field, key from totals where records * 100 > 2 * (select sum(records) from totals t where t.field = totals.field)",
    "p6_totals": _TOTALS + "select * from totals",
}
