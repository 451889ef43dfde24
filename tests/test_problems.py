"""The general problems: nulls, blanks, repeated rows, hot keys, empty tables and clashing column names."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions import records
from lodestack.operators import bloom, compaction, hierarchy, orphans, skew
from lodestack.sources.json_objects import objects, report_objects


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_keys(spark):
    rows = spark.createDataFrame([(" a/b/ libx.so\n", "./r//p/./f"), ("\t", "/r/p"), (None, None), ("dir/", "")], "e string, p string")
    got = rows.select(records.library_key(F.col("e")), records.clean_path(F.col("p")), records.package_of(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(" libx.so", "r/p/f", "p"), (None, "r/p", "p"), (None, None, None), (None, "", None)]
    assert rows.select(records.term(F.lit(" a \t\n b ")).alias("t")).first().t == "a b"


def test_records_ignore_spelling_and_case(programs):
    df = programs([(1, "r/p/f", "AB", None, None, day(0)), (2, "./r//p/f", "ab", None, None, day(0)), (3, "r/p/f", "cd", None, None, day(0)), (4, None, None, None, None, day(0))])
    assert df.select(*records.record_id()).distinct().count() == 3


def test_key_totals(programs):
    df = programs([
        (1, "r/p/f", "a", "x.so", ["l.so", " l.so", "d/m.so", None, ""], day(0)),
        (2, "r//p/f", "A", "x.so", ["m.so", "l.so"], day(1)),  # a copy
        (3, "r/q/g", "b", " ", ["l.so"], day(0)),
        (4, "r/q/h", "c", None, None, day(0)),
    ])
    got = {(r.field, r.key): (r.records, r.packages) for r in skew.key_totals(df).collect()}
    assert got == {("needed", "l.so"): (2, 2), ("needed", "m.so"): (1, 1), ("soname", "x.so"): (1, 1)}
    assert skew.key_totals(df.limit(0)).count() == 0
    heavy = {tuple(r) for r in skew.heavy_keys(skew.key_totals(df), 50).collect()}
    assert heavy == {("needed", "l.so"), ("soname", "x.so")}


def test_salted_lookup_equals_plain_join(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, -1)], "key string, id bigint"))
    lookup = rows.where("key is not null and key <> 'k7'").groupBy("key").agg(F.max("id").alias("top"))
    got = skew.salted_lookup(rows, lookup, "key").select("key", "id", "top")
    want = rows.join(lookup, "key", "left").select("key", "id", "top")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_bloom_never_denies_a_key(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    words = bloom.words_for(3000)
    asked = spark.range(20000).select(F.col("id").cast("string").alias("k")).unionByName(spark.createDataFrame([(None,)], "k string"))
    got = bloom.probe(asked, "k", bloom.build(keys, "k", words), words)
    inside = got.where("k < 'a' and cast(k as int) < 3000")
    assert inside.where("not maybe").count() == 0
    assert got.where("maybe").count() < 3000 + 17000 * 0.1 and got.where("k is null and maybe").count() == 0
    assert bloom.words_for(10**12) == bloom.MOST_WORDS


def test_orphans(spark, programs):
    df = programs([
        (1, "r/p/a", "1", "liba.so", ["base.so", "liba.so", "gone.so", "later.so", "never.so", " never.so ", None], day(10), dt.datetime(2024, 3, 5)),
        (2, "r/p/gone", "2", "gone.so", [], day(1)),
        (3, "r/p/late", "3", "later.so", None, day(20)),
        (4, "r/p/b", "4", None, ["gone.so"], day(3)),  # before the removal
        (5, "r/p/c", "5", None, ["gone.so"], day(4), None),  # at the removal, which counts
        (6, "r/p/d", "6", None, ["two.so"], day(9)),
        (7, "r/p/two1", "7", "two.so", [], day(1)), (8, "r/p/two2", "8", "two.so", [], day(5)),
    ])
    base = spark.createDataFrame([("x", "base.so"), ("y", None)], "path string, soname string")
    removals = spark.createDataFrame([("./r/p/gone", day(4)), ("r/p/gone", day(4)), ("r/p/gone", day(0)), ("r/p/two1", day(3)), (None, day(1)), ("r/p/zz", None)], "relative string, removed_at timestamp_ntz")
    got = sorted(tuple(r) for r in orphans.orphan_references(df, base, removals).collect())
    assert got == [(1, "gone.so", "deleted", "2024-03"), (1, "later.so", "late", "2024-03"), (1, "never.so", "missing", "2024-03"), (5, "gone.so", "deleted", None)]
    report = orphans.orphans_by_period(orphans.orphan_references(df, base, removals), "t").collect()
    assert sum(r.n_references for r in report) == 4 and {r.table_name for r in report} == {"t"}
    assert orphans.orphan_references(df.limit(0), base.limit(0), removals.limit(0)).count() == 0


def test_merged_intervals(spark):
    rows = spark.createDataFrame([("k", 1, 3), ("k", 2, 5), ("k", 5, 6), ("k", 8, 9), ("j", 1, 2)], "key string, lo int, hi int")
    assert sorted(tuple(r) for r in orphans.merged(rows, ["key"]).select("key", "lo", "hi").collect()) == [("j", 1, 2), ("k", 1, 6), ("k", 8, 9)]


def brute_tree(edges, nodes):
    out = {}
    for n in nodes:
        path, at = [n], n
        while at in edges and edges[at] not in path:
            at = edges[at]
            path.append(at)
        if at not in edges:
            out[n] = (at, len(path) - 1, "tree")
        else:
            start = path.index(edges[at])
            out[n] = (min(path[start:]), start, "cycle" if start == 0 else "below_cycle")
    return out


def test_hierarchy(spark):
    rng = np.random.default_rng(5)
    names = [f"n{i:03d}" for i in range(150)]
    edges = {n: names[rng.integers(0, i)] for i, n in enumerate(names[:120]) if i and rng.random() < 0.9}
    edges |= {f"n{i}": f"n{i + 1}" for i in range(120, 125)} | {"n125": "n122", "n130": "n130", "n131": "n130", "n126": "n120"}
    edges |= {f"c{i:02d}": f"c{i + 1:02d}" for i in range(40)}
    names += [f"c{i:02d}" for i in range(41)]
    nodes = spark.createDataFrame([(n,) for n in names] + [(None,)], "node string")
    rows_ = list(edges.items()) + [(None, "x"), ("n000", None), ("n001", "zz"), ("n000", "not a node")]
    given = spark.createDataFrame(rows_, "node string, parent string")
    rows = hierarchy.hierarchy(nodes, given, paths=True).collect()
    assert {(r.node, r.root, r.depth) for r in hierarchy.hierarchy(nodes, given).collect()} == {(r.node, r.root, r.depth) for r in rows}
    assert {r.node: (r.root, r.depth, r.state) for r in rows} == brute_tree(edges, names) and len(rows) == len(names)
    below = {}
    for r in rows:
        assert r.path[-1] == r.node and len(r.path) == r.depth + 1
        for a in r.path[:-1]:
            below[a] = below.get(a, 0) + 1
    assert all(r.descendants == below.get(r.node, 0) for r in rows)
    pairs = [tuple(r) for r in hierarchy.descendants(nodes, given).collect()]
    assert sorted(pairs) == sorted((a, r.node, len(r.path) - 1 - i) for r in rows for i, a in enumerate(r.path[:-1]))
    assert hierarchy.hierarchy(nodes.limit(0), nodes.limit(0).selectExpr("node", "node as parent")).count() == 0


def test_library_edges_need_known_sonames(programs):
    df = programs([(1, "a", "1", "x.so", ["y.so", "base.so"], day(0)), (2, "b", "2", "d/y.so", ["y.so", None], day(0)), (3, "c", "3", None, ["x.so"], day(0))])
    nodes, edges = hierarchy.library_edges(df)
    assert {r.node for r in nodes.collect()} == {"x.so", "y.so"}
    assert {tuple(r) for r in edges.select("node", "parent").collect()} >= {("x.so", "y.so"), ("y.so", "y.so")}
    assert {(r.node, r.root, r.state) for r in hierarchy.hierarchy(nodes, edges).collect()} == {("x.so", "y.so", "below_cycle"), ("y.so", "y.so", "cycle")}


def elf(relative, sha, **more):
    return {"source": {"relative": relative, "sha256": sha, "size": 5}, "kind": "dso"} | more


def test_objects_in_any_layout():
    a, b = json.dumps({"x": "}{", "y": [1, {"z": 2}]}), json.dumps({"q": 'a"b'})
    for text in (a + b, f"[{a},\n{b}]", f"﻿{a}\r\n{b}\r\n", f"junk {a} {{ {b}", f'{{"cut": {a}, "s": "open {b[1:]}'):
        found = list(objects(text))
        assert json.loads(a) in found
    assert list(objects("")) == list(objects("{{{{")) == list(objects("<p>no</p>")) == []
    assert [x for x in objects(a + '": 3}\n}' + b)] == [json.loads(a), json.loads(b)]
    assert list(objects('{"a":' * 5000)) == []


def test_compaction(spark):
    texts = [
        (1, json.dumps(elf("r/p/./a", "AA", old=1)), day(1)), (2, json.dumps(elf("r/p/a", "aa", new=1), indent=1), day(2)),
        (3, json.dumps(elf("r/p/b", "bb")) + "\n" + json.dumps(elf("r/p/c", "cc"))[:-3], None), (4, None, None), (5, "", day(1)),
        (6, json.dumps([elf("r/p/d", "dd"), {"source": {"relative": "r/p/a", "sha256": "aa"}, "elf_kind": "dso"}]), day(1)),
        (7, json.dumps(elf(None, "ee")) + json.dumps(elf("r/p/e", None)) + '{"source": 3, "kind": "dso"}', day(1)),
        (8, json.dumps(elf("r/q/long", "ff", note="x" * 300_000)), day(3)), (9, json.dumps(elf("r/q/\ud800", "99")), day(3)),
    ]
    files = spark.createDataFrame(texts, "file_id bigint, content string, modified_at timestamp_ntz")
    out = compaction.compact(report_objects(files), file_bytes=100_000)
    got = {(r.report_type, r.relative, r.sha256): json.loads(r.report) for r in out.records.collect()}
    assert set(got) == {("elf", "r/p/a", "aa"), ("elf", "r/p/b", "bb"), ("elf", "r/p/d", "dd"), ("elflint", "r/p/a", "aa"), ("elf", "r/q/long", "ff"), ("elf", "r/q/?", "99")}
    assert got["elf", "r/p/a", "aa"]["new"] == 1 and len(got["elf", "r/q/long", "ff"]["note"]) == 300_000
    assert out.records.count() == 6 == sum(r.records for r in out.files.collect())
    assert compaction.compact(report_objects(files.limit(0)), 1000).records.count() == 0


def test_a_hot_package_counts_once(programs):
    rows = [(i, f"r/hot/f{i}", f"{i}", "x.so", ["l.so", "l.so", f"k{i % 7}"], day(0)) for i in range(300)] + [(1000 + i, f"r/p{i}/f", f"{i}", None, ["l.so"], day(0)) for i in range(50)]
    rows += [(2000 + i, f"r//hot/f{i}", f"{i}", "x.so", [" l.so"], day(1)) for i in range(100)] + [(3000, None, None, "x.so", ["l.so"], day(0)), (3001, "short", "z", None, ["l.so"], day(0))]
    got = {(r.field, r.key): (r.records, r.packages) for r in skew.key_totals(programs(rows).repartition(6)).collect()}
    assert got["needed", "l.so"] == (352, 51) and got["soname", "x.so"] == (301, 1) and got["needed", "k0"] == (43, 1)
    assert sum(n for (f, k), (n, _) in got.items() if k.startswith("k")) == 300


def report_rows(spark, n):
    """Reports of one length, a third of them of one package, months and sizes mixed."""
    return spark.range(n).select(
        F.lit("elf").alias("report_type"), F.when(F.col("id") % 3 == 0, "r/hot/f").otherwise(F.concat(F.lit("r/p"), F.col("id") % 90, F.lit("/f"))).alias("relative"),
        F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.col("id").alias("file_id"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0, int(id % 7))").alias("modified_at"),
        (F.expr("shiftleft(64L, int(id % 9))")).alias("size"), F.sha2(F.col("id").cast("string"), 512).alias("report"),
    )


def test_files_are_balanced(spark):
    coded, bits = compaction.coded(report_rows(spark, 4000), 13)
    placed, n = compaction.place(coded, 129 * 310, bits)
    sizes = [r["count"] for r in placed.groupBy("file_no").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 2 * 310 and 12 <= n <= 14 and len(sizes) == n
    by_file = placed.groupBy("file_no").agg(F.min("code").alias("lo"), F.max("code").alias("hi")).orderBy("lo", "hi").collect()
    assert all(a.hi <= b.lo for a, b in zip(by_file, by_file[1:]))
    one, n = compaction.place(coded.withColumn("code", F.lit(7).cast("bigint")), 129 * 310, bits)  # one cell is split by hash
    assert n == 13 and max(r["count"] for r in one.groupBy("file_no").count().collect()) < 2 * 310


def test_finer_cells_for_more_files(spark):
    assert [compaction.bits_for(n) for n in (0, 1, 4096, 5000, 1 << 21, 1 << 30)] == [5, 5, 5, 6, 8, 8]
    rows = report_rows(spark, 900)
    bounds = compaction.package_bounds(rows, 3)
    assert bounds == sorted(bounds) and len(bounds) == 7 and compaction.package_bounds(rows.limit(0), 3) == []


def test_compacted_files_stay_where_they_are_wanted(spark, tmp_path):
    rows = report_rows(spark, 3000)
    out = compaction.compact(rows, 20_000, to=f"{tmp_path}/out")
    files = out.files.collect()
    assert sum(r.records for r in files) == 3000 == spark.read.parquet(f"{tmp_path}/out").count() and len(files) == out.n_files >= 10
    assert all(10_000 <= r.file_bytes <= 40_000 for r in files[:-1])
    with pytest.raises(ValueError, match="differ"):
        compaction.compact(rows, 20_000, source=rows.limit(2999))


def test_hilbert_curve_is_continuous():
    side = 1 << 3
    grid = np.array(np.meshgrid(*[np.arange(side)] * 3)).reshape(3, -1)
    code = compaction.hilbert(grid, 3)
    assert sorted(code) == list(range(side**3))
    walk = grid[:, np.argsort(code)]
    assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p6_found"])
def test_queries_on_the_smallest_tables(spark, name):
    import __spark_entry__ as e

    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
