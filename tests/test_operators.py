"""The corpus operators on small fixtures with answers worked out by hand."""

import datetime as dt
import gzip
import io
import json
import random
import struct
import tarfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.functions import scalars as S
from lodestack.operators import graph, incremental, lint, metrics, ranges, rules, sampling
from lodestack.plans import corpus, report
from lodestack.sources import dumps, elf_binary, packages
from lodestack.streaming import arrivals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, want", [
    ("table [ 31] of 'abc' (very odd) ends at 77", "table [N] of 'STR' (STR) ends at N"),
    (" at 0x1F  of (x, y)\t12 ", "at 0xN of (STR) N"), ("", ""), (None, None),
])
def test_template(spark, text, want):
    assert one(spark, S.template(F.lit(text).cast("string"))) == want


def test_scalars(spark):
    L = F.lit
    cases = [
        (S.named(L(62), S.MACHINES), "EM_X86_64"), (S.named(L(1), S.MACHINES), "unknown"), (S.flag_names(L(5)), ["PF_R", "PF_X"]), (S.flag_names(L(0)), []),
        (S.joined_flags(L(0), S.SEGMENT_FLAGS, "NONE", "OTHER"), "NONE"), (S.joined_flags(L(12), S.SEGMENT_FLAGS, "NONE", "OTHER"), "PF_R|OTHER"),
        (S.permission(L(7)), "RWX"), (S.permission(L(0)), "(none)"), (S.run_path_style(L("$ORIGIN/../lib")), "$ORIGIN"), (S.run_path_style(L("/lib")), "absolute"),
        (S.run_path_style(L("a/b")), "relative-multi"), (S.run_path_style(L("a")), "relative-bare"), (S.search_path(L("/a:$ORIGIN/x::b"), "/root"), ["/root/a", "b"]),
        (S.bucket(L(0.5), S.BSS_CUTS, ">0.9"), "0.1-0.5"), (S.bucket(L(0.91), S.BSS_CUTS, ">0.9"), ">0.9"), (S.version_numbers(L("1.10")), [1, 10]), (S.version_numbers(L("1.x")), None),
        (S.isa_rank(L("x86-64-v3")), 3), (S.isa_rank(L("?")), 0), (S.is_power_of_two(L(4096)), True), (S.is_power_of_two(L(0)), False), (S.is_congruent(L(0x2010), L(0x10), L(0x1000)), True),
        (S.relocation_family(L("R_X86_64_IRELATIVE")), "ifunc"), (S.relocation_family(L("R_X86_64_RELATIVE")), "relative"), (S.relocation_family(L("R_X86_64_COPY")), "copy"),
        (S.relocation_family(L("R_X86_64_JUMP_SLOT")), "plt"), (S.relocation_family(L("R_X86_64_tpoff64")), "tls"), (S.parse_integer(L("0x11")), 17), (S.parse_integer(L("7")), 7), (S.parse_integer(L("q")), -1),
        (S.failure(L("x: undefined symbol: y")), "undefined symbol"), (S.joined_flags(L(0x8000001), S.DYNAMIC_FLAGS, "", ""), "DF_1_NOW|DF_1_PIE"), (S.joined_flags(L(65), S.SEARCH_FLAGS, "LA_SER_NONE", "LA_SER_OTHER"), "LA_SER_ORIG|LA_SER_DEFAULT"), (S.failure(L("y" * 200)), "y" * 160), (S.dependency_names(L("so:x=1.2 !bad pkg>=1 ")), ["so:x", "pkg"]), (S.conflict_names(L("a !bad<2")), ["bad"]),
        (S.package_name(L("zlib-dev-1.2-r3")), "zlib-dev"), (S.enum_name(L("SharedObject (0x3)")), "SharedObject"), (S.enum_name(L('{"Name": "X", "Value": 3}')), "X"), (S.archive_path(L("a/.//b")), "a/b"),
        (S.archive_path(L("a/../c")), None), (S.archive_path(L("/c")), None), (S.archive_path(L("./")), None), (S.link_target(L("usr/lib/x"), L("../../bin/./y")), "bin/y"), (S.link_target(L("usr/x"), L("/lib/y")), "lib/y"),
        (S.link_target(L("x"), L("../y")), None), (S.link_target(L("x"), L("")), None), (S.relative_path(L("usr/lib"), L("bin/y")), "../../bin/y"), (S.relative_path(L("usr/lib"), L("usr/lib/a/b")), "a/b"),
        (S.relative_path(L("usr/lib"), L("usr/lib")), "."), (S.relative_path(L(""), L("a")), "a"), (S.named(L(36), S.RELOCATIONS, "UNKNOWN"), "TLSDESC"), (S.named(L(9), S.LOADER_STATES, "RT_UNKNOWN"), "RT_UNKNOWN"),
        (S.count_of(L("7")), 7), (S.count_of(L('{"n": 3}')), 3), (S.count_of(L(None).cast("string")), 0), (S.relocation_family(L("R_X86_64_TLSGD")), "tls"), (S.feature_list(L("x86 feature: IBT, SHSTK"))[1], ["IBT", "SHSTK"]),
        (S.feature_list(L("no colon"))[1], []),
    ]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(got) == [want for _, want in cases]
    assert int(one(spark, S.unsigned(F.lit("0xffffffffffffffff")))) == 2**64 - 1
    assert tuple(spark.range(1).select(*S.split_version(F.lit("GLIBC_2_34"))).first()) == ("GLIBC", "2_34")
    assert tuple(spark.range(1).select(*S.feature_list(F.lit("x86 feature: IBT, SHSTK"))).first()) == ("x86 feature", ["IBT", "SHSTK"])
    draw = one(spark, S.blake_draw(F.lit("k")))
    assert 0 <= draw < 1


def test_totals_tall_and_shares(spark):
    rows = spark.createDataFrame([("a", ["x", "y"]), ("a", ["x"]), (None, None)], "c string, k array<string>")
    tall = metrics.tall(rows, ["c"], {"m": F.col("k")})
    got = {(r.c, r.key): r.n for r in metrics.with_total(tall, "c", ["metric", "key"], F.count("*").alias("n")).collect()}
    assert got == {("a", "x"): 2, ("a", "y"): 1, ("all", "x"): 2, ("all", "y"): 1}
    counted = tall.groupBy("key").agg(F.count("*").alias("n"))
    assert {r.key: round(r.share, 2) for r in metrics.shares(counted).collect()} == {"x": 66.67, "y": 33.33}
    assert {tuple(r) for r in metrics.top_and_rest(counted, "key", "n", 1).collect()} == {("x", 2), ("(other)", 1)}


def test_quantile_by_index(spark):
    rows = spark.createDataFrame([("a", v) for v in (1, 2, 3, 100)] + [("b", 7), ("c", None)], "g string, v int")
    got = {r.g: (r.n, r.median, r.quantile) for r in metrics.median_and_index(rows, ["g"], "v", 99).collect()}
    assert got == {"a": (4, 2.5, 100), "b": (1, 7.0, 7)}


def test_greatest_version_and_presence(spark):
    rows = spark.createDataFrame([("l", "2.4"), ("l", "2.34"), ("l", "2.34.0"), ("m", "x")], "lib string, v string")
    assert [tuple(r) for r in metrics.greatest_version(rows, ["lib"], "v", S.version_numbers(F.col("v"))).collect()] == [("l", "2.34.0")]
    assert {tuple(r) for r in metrics.presence(rows, {"l": F.col("lib") == "l", "none": F.lit(None).cast("boolean")}).collect()} == {("l", 3), ("none", 0)}


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(900).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").cast("string").alias("p"))
    draw = S.md5_draw(F.col("k"), F.col("p"))
    a = sampling.smallest_per_group(rows.repartition(7), ["k"], draw, ["p"], 5)
    b = sampling.smallest_per_group(rows.coalesce(1), ["k"], draw, ["p"], 5)
    assert a.exceptAll(b).count() == 0 and a.count() == 15
    first = sampling.first_with_total(rows, [F.col("p")], 3).collect()
    assert [r.p for r in first] == ["0", "1", "10"] and first[0].total == 900


def test_graph(spark):
    libs = spark.createDataFrame([("/a", "a"), ("/a2", "a"), ("/b", "b"), ("/n", None)], "path string, soname string")
    uses = spark.createDataFrame([("/x", "a"), ("/x", "a"), ("/x", "z"), ("/y", "a")], "path string, soname string")
    assert {tuple(r) for r in graph.first_provider(libs).collect()} == {("a", "/a"), ("b", "/b")}
    assert [(r.soname, r.n_paths, r.paths) for r in graph.conflicts(libs).collect()] == [("a", 2, ["/a", "/a2"])]
    assert [tuple(r) for r in graph.external(uses, libs).collect()] == [("z", 1)]
    assert {tuple(r) for r in graph.in_degree(uses).collect()} == {("a", 3, 2), ("z", 1, 1)}
    assert [tuple(r) for r in graph.repeated_entries(uses).collect()] == [("/x", "a", 2)]
    required = spark.createDataFrame([("/x", "a", "V2"), ("/y", "a", "V1"), ("/x", "b", "V9")], "path string, soname string, verset string")
    declared = spark.createDataFrame([("a", "V1"), ("c", "V1")], "soname string, verset string")
    assert [tuple(r) for r in graph.version_mismatches(required, declared).collect()] == [("a", "V2", 1)]


def test_closure_cycles_diamonds_shadowing(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("p", "q"), ("q", "p"), ("s", "s"), (None, "x")], "src string, dst string")
    reach = graph.closure(edges)
    got = {(r.root, r.node): r.depth for r in reach.collect()}
    assert got["a", "e"] == 3 and got["p", "p"] == 2 and got["s", "s"] == 1 and ("a", "a") not in got and len([x for x in got if x[0] == "a"]) == 4
    assert {tuple(r) for r in graph.cycles(reach).collect()} == {("p", "p"), ("q", "p"), ("s", "s")}
    shape = {r.root: (r.nodes, r.edges, r.extra) for r in graph.diamonds(reach, edges.where("src is not null")).collect()}
    assert shape["a"] == (4, 5, 1) and shape["b"] == (2, 2, 0) and shape["s"] == (0, 1, 1)
    exports = spark.createDataFrame([("b", "f"), ("e", "f"), ("c", "g"), ("d", "h")], "node string, symbol string")
    direct = edges.selectExpr("src as root", "dst as node").where("root is not null")
    assert [tuple(r) for r in graph.shadowing(direct, reach, exports).collect()] == [("a", "f", 1, 1)]
    assert graph.closure(edges.limit(0)).count() == 0


def test_programs_have_closures_diamonds_and_shadowing(spark):
    """Every file that needs anything, against a walk per file; programs have no soname."""
    random.seed(3)
    rows = [(f"lib/{i:02}", f"s{i % 25:02}", [f"s{random.randrange(25):02}" for _ in range(random.randrange(3))] + ["gone"] * (i % 9 == 0)) for i in range(30)]
    rows += [(f"lib/chain{i:02}", f"c{i:02}", [f"c{i + 1:02}"]) for i in range(11)]
    rows += [(f"bin/{i}", None, [f"s{random.randrange(25):02}" for _ in range(3)] + [f"x{i % 2}"] * (i % 4 == 0)) for i in range(40)]
    rows += [("bin/deep", None, ["c00", "c00"]), ("bin/built-twice", None, ["s01"]), ("bin/built-twice", None, ["s02", "x0"]), ("bin/alone", None, ["x0"]), ("bin/none", None, []), (None, None, ["s03"])]
    libraries = spark.createDataFrame(rows, "path string, soname string, needed array<string>")
    first, needs = {}, {}
    for path, soname, needed in rows:
        if soname:
            first[soname] = min(path, first.get(soname, path))
        for k in needed:
            own = needs.setdefault(path, {})
            own[k] = max(own.get(k, 0), needed.count(k))
    picks = {p: {first[k] for k in own if k in first} for p, own in needs.items()}
    shapes, reached = {}, {}
    for start in needs:
        level, seen, depth = {start}, {start}, 0
        while level := {b for a in level for b in picks.get(a, ())} - seen:
            seen, depth = seen | level, depth + 1
        reached[start] = seen - {start}
        edges = sum(n for a in seen for k, n in needs.get(a, {}).items() if k in first)
        shapes[start] = (len(seen) - 1, len({k for a in seen for k in needs.get(a, ()) if k not in first}), depth, edges, edges - len(seen) + 1)
    of_files = graph.file_graph(libraries)
    measures = graph.file_closures(of_files)
    assert {r.path: (r.nodes, r.external, r.depth, r.edges, r.extra) for r in measures.collect()} == shapes
    assert shapes["bin/deep"][:4] == (11, 1, 11, 12) and shapes["bin/alone"] == (0, 1, 0, 0, 0) and len(shapes) > 70
    defines = {p: {f"f{i % 5}", f"own{i}"} for i, (p, s, _) in enumerate(rows) if s}
    want = {}
    for p, nodes in reached.items():
        direct = picks[p] - {p}
        for symbol in {x for n in nodes for x in defines.get(n, ())}:
            near, far = (sum(symbol in defines.get(n, ()) for n in part) for part in (direct, nodes - direct))
            if near and far:
                want[p, symbol] = (near, far)
    exports = spark.createDataFrame([(p, x) for p, symbols in defines.items() for x in symbols] * 2, "path string, symbol string")
    got = {(r.path, r.symbol): (r.n_direct, r.n_indirect) for r in graph.file_shadowing(of_files, exports).collect()}
    assert got == want and any(p and p.startswith("bin/") for p, _ in want)
    assert graph.file_closures(graph.file_graph(libraries.limit(0))).count() == 0


def test_verset_mismatches_compare_requested_with_declared(spark, tmp_path):
    rows = [("a", "liba.so.1", None, ["A_1", "A_2"]), ("b", "libb.so.1", {"liba.so.1": ["A_2", "A_3"], "libz.so.1": ["Z_1"], "libc.so.1": ["C_1"]}, None), ("c", "libc.so.1", {"x/liba.so.1": ["A_3", None], "liba.so.1": None}, [])]
    spark.createDataFrame(rows, "path string, soname string, verneed map<string,array<string>>, verdef array<string>").write.parquet(f"{tmp_path}/graph_record.parquet")
    assert [tuple(r) for r in corpus.verset_mismatches(spark, str(tmp_path)).collect()] == [("liba.so.1", "A_3", 2)]


def test_package_picks_and_owners(spark):
    providers = spark.createDataFrame([("t", "b", 1), ("t", "a", 1), ("t", "c", 0)], "tag string, provider string, priority int")
    picks = graph.package_picks(spark.createDataFrame([("r", "t"), ("r", "none")], "name string, dep string"), providers)
    assert {(r.dep, r.pick) for r in picks.collect()} == {("t", "a"), ("none", None)}
    files = spark.createDataFrame([("lib/x", "p1"), ("lib/x", "p2"), ("lib/y", "p2"), (None, "p3")], "path string, package string")
    assert {tuple(r) for r in graph.file_owners(files).collect()} == {("lib/x", "p1", 2), ("lib/y", "p2", 1)}
    assert {r.owner for r in graph.file_owners(files, last=True).collect()} == {"p2"}


def test_range_lookup_equals_theta_join(spark):
    points = spark.range(400).select((F.col("id") % 4).alias("g"), ((F.col("id") * 7919) % 100_000).alias("at"))
    ranges_ = spark.range(60).select((F.col("id") % 4).alias("g"), ((F.col("id") * 1543) % 90_000).alias("lo"), ((F.col("id") * 1543) % 90_000 + F.col("id") * F.col("id") * 30).alias("hi"))
    got = ranges.range_lookup(points, ranges_, ["g"], "at", "lo", "hi", 16, wide=8).select("g", "at", "lo", "hi")
    want = points.join(ranges_, "g").where("lo <= at and at < hi").select("g", "at", "lo", "hi")
    assert want.count() > 100 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_islands_bits_and_changes(spark):
    rows = spark.createDataFrame([(1, 0, 5), (2, 5, 9), (3, 12, 13)], "i int, lo int, hi int").withColumn("g", F.lit(1))
    before = F.lag("hi").over(Window.partitionBy("g").orderBy("i"))
    got = ranges.islands(rows, ["g"], ["i"], F.col("lo") != before, F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"))
    assert {(r.lo, r.hi, r.n) for r in got.collect()} == {(0, 9, 2), (12, 13, 1)}
    assert one(spark, ranges.set_bits(F.lit(-(2**63) + 5))) == [0, 2, 63]
    words = spark.createDataFrame([("d", 0, 0x1000), ("d", 1, 0b101), ("d", 2, 0b11), ("d", 3, 0x8000)], "dso string, i int, word bigint")
    slots = sorted(r.slot for r in ranges.bitmap_slots(words, ["dso"], "i", "word").collect())
    assert slots == [0x1000, 0x1008 + 8, 0x1008 + 63 * 8, 0x8000]
    changed = one(spark, ranges.positional_changes(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c"), F.lit("d"))))
    assert [tuple(x) for x in changed] == [(1, "b", "c"), (2, None, "d")]
    maps = spark.createDataFrame([("x", 5), ("x", 2), ("y", 9)], "path string, start int").withColumn("pid", F.lit(1))
    assert {(r.path, r.base) for r in ranges.load_base(maps, ["pid"], "path", "start").collect()} == {("x", 2), ("y", 9)}


def test_lint(spark):
    rows = [(1, ("r/a",), "dirty", 1, ["bad [ 1]", "bad [22]"], None), (2, ("r/b",), "dirty", 1, ["bad [3]", None], None), (3, ("r/c",), "timeout", None, ["bad [4]"], "timeout after 60s"), (4, None, "clean", 0, None, None)]
    df = spark.createDataFrame(rows, "report_id bigint, source struct<relative:string>, status string, return_code int, findings array<string>, stderr_first_line string")
    found = lint.findings(df)
    assert [tuple(r) for r in lint.template_counts(found).collect()] == [("bad [N]", 3, 2)]
    assert {r.relative for r in lint.template_samples(found).collect()} == {"r/a", "r/b"}
    assert {(r.bucket, r.n) for r in lint.findings_histogram(df).collect()} == {("2-5", 2), ("0", 1)}
    outcome = lint.outcomes(df.withColumn("g", F.lit(1)), ["g"]).first()
    assert (outcome.runs, outcome.dirty, outcome.failed, outcome.any_dirty, outcome.findings) == (4, 2, 1, True, 4)
    assert [(r.signature, r.n) for r in lint.failures(df).collect()] == [("timeout after", 1)]


def test_incremental(spark):
    inputs = spark.createDataFrame([("a",), ("b",), (None,)], "path string")
    done = spark.createDataFrame([("a", 1), ("b", 0)], "path string, schema_version int")
    assert {r.path for r in incremental.pending(inputs, done, ["path"], 1).collect()} == {"b", None}
    assert incremental.pending(inputs, done, ["path"], 1, force=True).count() == 3
    assert [r.n for r in incremental.distinct_contents(inputs.union(inputs), "path").collect()] == [2, 2]


def image(etype=3, machine=62, interp=b"/lib/ld.so\0", soname=True, filesz=0x400, phentsize=56, high=False):
    """A small image: one loadable segment over the whole file, an interpreter and a dynamic section."""
    strings = b"\0libc.so\0libme.so\0/usr/lib\0"
    strings_at, interp_at, dynamic_at = 0x300, 0x280, 0x200
    pairs = [(1, 1), (5, strings_at), (10, len(strings)), *([(14, 9)] if soname else []), (29, 18), (0, 0)]
    entry = 0xFFFFFFFFFFFFFFF0 if high else 0x100
    segments = [(1, 5, 0, 0, 0, filesz, 0x400, 4096), (3, 4, interp_at, interp_at, 0, len(interp), len(interp), 1), (2, 6, dynamic_at, dynamic_at, 0, 16 * len(pairs), 16 * len(pairs), 8)]
    out = bytearray(0x400)
    out[:7] = b"\x7fELF\x02\x01\x01"
    out[16:64] = struct.pack("<HHIQQQIHHHHHH", etype, machine, 1, entry, 64, 0, 0, 64, phentsize, len(segments), 64, 0, 0)
    for i, s in enumerate(segments):
        out[64 + i * 56 : 120 + i * 56] = struct.pack("<IIQQQQQQ", *s)
    for i, p in enumerate(pairs):
        out[dynamic_at + i * 16 : dynamic_at + i * 16 + 16] = struct.pack("<qQ", *p)
    out[interp_at : interp_at + len(interp)] = interp
    out[strings_at : strings_at + len(strings)] = strings
    return bytes(out)


def test_elf_structure(spark, tmp_path):
    cases = {
        "program": image(), "arm": image(machine=183), "object": image(etype=1), "exec": image(etype=2), "large": image(filesz=0x500), "small_entries": image(phentsize=32),
        "far_interp": image()[:64] + image()[64:120] + struct.pack("<IIQQQQQQ", 3, 0xF0000004, 1 << 40, 0, 0, 9, 9, 1) + image()[176:], "none_type": image(etype=0, filesz=0x400)[:56] + struct.pack("<H", 0) + image()[58:],
        "high": image(high=True), "short": b"\x7fELF\x02\x01\x01", "class32": b"\x7fELF\x01" + bytes(80), "text": b"hello",
    }
    (tmp_path / "sub").mkdir()
    for name, content in cases.items():
        (tmp_path / "sub" / name).write_bytes(content)
    rows = {r.path.rsplit("/", 1)[1]: r for r in elf_binary.structure(elf_binary.read_images(spark, str(tmp_path))).collect()}
    assert "text" not in rows and len(rows) == 11
    kinds = {k: r.kind for k, r in rows.items()}
    assert kinds == {"program": "dynamic_program", "arm": "wrong_machine", "object": "relocatable", "exec": "dynamic_program", "large": "malformed_image", "small_entries": "malformed_image", "high": "dynamic_program", "short": "wrong_format", "class32": "wrong_format", "far_interp": "dso", "none_type": "other"}
    assert rows["far_interp"].program_headers[1].flags == 0xF0000004 and rows["far_interp"].issues and rows["program"].padding == [0] * 7 and rows["program"].abi_version == 0
    p = rows["program"]
    assert p.interpreter == "/lib/ld.so" and p.dynamic.needed == ["libc.so"] and p.dynamic.soname == "libme.so" and p.dynamic.runpath == ["/usr/lib"]
    assert p.role_evidence.entry_in_executable_load and p.program_headers[0].p_type_name == "PT_LOAD" and p.program_headers[0].flags_names == ["PF_R", "PF_X"]
    assert int(rows["high"].header.entry) == 0xFFFFFFFFFFFFFFF0
    listed = elf_binary.programs(elf_binary.structure(elf_binary.read_images(spark, str(tmp_path))))
    assert {r.closure.status for r in listed.collect()} == {"not_computed"} and listed.count() == 3


def test_rules(spark):
    seg = "array<struct<index:int,p_type:bigint,p_type_name:string,flags:int,offset:bigint,vaddr:bigint,filesz:bigint,memsz:bigint,align:bigint>>"
    head = "struct<elf_type:int,machine:int,machine_name:string,version:int,phoff:bigint,shoff:bigint,ehsize:int,phentsize:int,phnum:int,shentsize:int,shnum:int>"
    rows = [
        (1, (3, 62, "EM_X86_64", 1, 64, 0, 64, 56, 3, 64, 0), (1, 2), [(0, 1, "PT_LOAD", 7, 0, 4096, 10, 5, 4096), (1, 3, "PT_INTERP", 4, 0, 0, 1, 1, 3), (2, 1, " pt_load", 4, 1, 0, 1, 1, 4096)]),
        (2, (3, 62, "EM_X86_64", 1, 64, 0, 64, 56, 1, 64, 0), (1, 2), [(0, 1, "PT_LOAD", 5, 0, 0, 1, 1, 4096)]), (3, None, (1, 1), []), (4, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"id int, header {head}, format struct<ident_version:int,class:int>, program_headers {seg}")
    found = {(r.id, r.anomaly): r.hits for r in rules.anomalies(df, rules.header_rules() + rules.segment_rules(), ["id"]).collect()}
    assert found == {(1, "ph_load_wx"): 1, (1, "ph_load_filesz_gt_memsz"): 1, (1, "ph_align_not_pow2"): 1, (1, "ph_offset_vaddr_misaligned"): 1, (1, "ph_load_not_sorted"): 1, (1, "ph_interp_after_load"): 1}
    order = {r.id: (r.load_not_sorted, r.interp_after_load) for r in rules.segment_order(df, "id").collect()}
    assert order == {1: (True, True), 2: (False, False)}
    tags = spark.createDataFrame([(1, ["RELA", "RELASZ"]), (2, [])], "id int, tags array<string>")
    needs = spark.createDataFrame([("RELA", "RELASZ"), ("RELA", "RELAENT")], "tag string, needs string")
    assert [tuple(r) for r in rules.missing_tags(tags, "id", "tags", needs).collect()] == [(1, "RELA", "RELAENT")]


def test_each_header_rule_fires_and_spares(spark):
    seg = "array<struct<index:int,p_type:bigint,p_type_name:string,flags:int,offset:bigint,vaddr:bigint,filesz:bigint,memsz:bigint,align:bigint>>"
    head = "struct<elf_type:int,machine_name:string,version:int,phoff:bigint,shoff:bigint,ehsize:int,phentsize:int,phnum:int,shentsize:int,shnum:int>"
    good = (3, "EM_X86_64", 1, 64, 9, 64, 56, 1, 64, 1)
    changed = lambda at, value: (*good[:at], value, *good[at + 1 :])
    cases = {
        "ehdr_ehsize_nonstandard": changed(5, 52), "ehdr_phentsize_nonstandard": changed(6, 32), "ehdr_shentsize_nonstandard": changed(8, 40), "ehdr_object_version": changed(2, 0), "ehdr_unknown_etype": changed(0, 77),
        "ehdr_phoff_zero_phnum_nonzero": (1, *changed(3, 0)[1:]), "ehdr_phoff_nonzero_phnum_zero": changed(7, 0), "ehdr_shoff_zero_shnum_nonzero": changed(4, 0), "ehdr_unknown_machine": changed(1, "Unknown (0x9026)"), "arch_mismatch": changed(1, "EM_RISCV"),
    }
    rows = [(name, h, (1, 2)) for name, h in cases.items()] + [("good", good, (1, 2)), ("os", changed(0, 0xFE01), (1, 2)), ("32", (*good[:5], 52, 32, 1, 40, 1), (1, 1)), ("ehdr_ident_version", good, (2, 2)), ("null", None, (1, 2))]
    df = spark.createDataFrame(rows, f"id string, header {head}, format struct<ident_version:int,class:int>").withColumn("program_headers", F.lit(None).cast(seg))
    found = {}
    for r in rules.anomalies(df, rules.header_rules(), ["id"]).collect():
        found.setdefault(r.id, set()).add(r.anomaly)
    assert found == {name: {name} for name in [*cases, "ehdr_ident_version"]}
    names = ["PT_LOAD", "PT_LOOS+1", "PT_ARM_EXIDX", "PT_LOX", "Unknown (0x5)", "0x60000001", None, " PT_NOTE ", "PT_VEND"]
    segments = spark.createDataFrame([(1, [(i, 4, n, 4, 0, 0, 0, 0, 0) for i, n in enumerate(names)])], f"id int, program_headers {seg}").withColumn("header", F.lit(None).cast(head))
    assert [tuple(r) for r in rules.anomalies(segments, rules.segment_rules(), ["id"]).collect()] == [(1, "ph_unknown_type", 3)]
    ident = spark.createDataFrame([(1, 0, [0, 0]), (2, 1, [0, 3]), (3, None, None)], "id int, abi_version int, padding array<int>").withColumn("program_headers", F.lit(None).cast(seg))
    assert {tuple(r) for r in rules.anomalies(ident, rules.ident_rules(), ["id"]).collect()} == {(2, "ehdr_nonzero_abiversion", 1), (2, "ehdr_padding_nonzero", 1)}
    assert {r.outlier for r in rules.outliers(rules.anomalies(df, rules.header_rules(), ["id"])).collect()} == {"arch_mismatch", "unknown_machine"}


def test_dynamic_rules(spark):
    full = [("NEEDED", "1"), ("NEEDED", "2"), ("STRTAB", "0"), ("SYMTAB", "0"), ("STRSZ", "0"), ("SYMENT", "0"), ("GNU_HASH", "0"), ("NULL", "0"), ("NULL", "0")]
    rows = [
        (1, 3, True, full), (2, 3, True, full + [("TEXTREL", "0"), ("Unknown", "0")]), (3, 2, False, [("STRTAB", "0"), ("STRTAB", "0"), ("PLTREL", "0x11"), ("RPATH", "a"), ("RUNPATH", "b")]),
        (4, 3, True, []), (5, 1, False, []), (6, 3, True, None), (7, 3, True, full[:-2] + [("PLTREL", "9")]),
    ]
    df = spark.createDataFrame(rows, "id int, elf_type int, interpreted boolean, dynamic array<struct<tag:string,value:string>>").withColumn("has_dynamic", F.size("dynamic") > 0)
    found = {}
    for r in rules.anomalies(df, rules.dynamic_rules(), ["id"]).collect():
        found.setdefault(r.id, set()).add(r.anomaly.removeprefix("dyn_"))
    assert found == {
        2: {"textrel", "unknown_tag", "entries_after_null"}, 3: {"duplicate_tag", "missing_mandatory", "missing_dependency", "rpath_and_runpath", "no_hash", "static_exec_with_dynamic"},
        4: {"empty"}, 6: {"empty"}, 7: {"pltrel_bad_value", "missing_dependency"},
    }
    hits = {(r.id, r.anomaly): r.hits for r in rules.anomalies(df, rules.dynamic_rules(), ["id"]).collect()}
    assert hits[3, "dyn_missing_mandatory"] == 3 and hits[3, "dyn_missing_dependency"] == 2 and hits[2, "dyn_textrel"] == 1
    tags = df.select("id", F.transform("dynamic", lambda e: e["tag"]).alias("tags"))
    missing = rules.missing_tags(tags, "id", "tags", spark.createDataFrame(S.TAG_NEEDS, "tag string, needs string"))
    assert {tuple(r) for r in missing.where("id = 3").collect()} == {(3, "STRTAB", "STRSZ"), (3, "PLTREL", "JMPREL")}


def test_package_sources(spark, tmp_path):
    info = spark.createDataFrame([("p", "# c\npkgname = zlib\n\ndepend = a = b\ndepend=c\nnothing\n")], "package string, text string")
    assert {r.key: r["values"] for r in packages.metadata(info).collect()} == {"pkgname": ["zlib"], "depend": ["a = b", "c"]}
    texts = [("main", "P:a\nV:1\nV:2\nD:so:x=1 !bad b>2\np:so:a=1\n\nP:b\nk:7\n\n"), ("extra", "P:b\nk:x\np:so:x\n")]
    index = packages.index_packages(packages.index_records(spark.createDataFrame(texts, "repo string, text string")), ["main", "extra"])
    got = {r.name: (r.version, r.priority, r.provides, r.depends, r.conflicts) for r in index.collect()}
    assert got == {"a": ("2", 0, ["so:a"], ["so:x", "b"], ["bad"]), "b": (None, 0, ["so:x"], [], [])}
    assert {tuple(r) for r in packages.tag_providers(index).collect()} == {("a", "a", 0), ("so:a", "a", 0), ("b", "b", 0), ("so:x", "b", 0)}
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name, body in (("bin/x", image()), ("doc", b"text")):
            member = tarfile.TarInfo(name)
            member.size = len(body)
            tar.addfile(member, io.BytesIO(body))
        link = tarfile.TarInfo("bin/y")
        link.type, link.linkname = tarfile.SYMTYPE, "x"
        tar.addfile(link)
    archives = spark.createDataFrame([("p", gzip.compress(raw.getvalue())), ("bad", b"junk"), ("none", None)], "package string, content binary")
    members = packages.archive_members(archives).collect()
    assert {(r.path, r.link) for r in members if not r.issue} == {("bin/x", None), ("bin/y", "x")} and [r.package for r in members if r.issue] == ["bad"]
    lines = [{"file": "f", "seq": i, "event": e} for i, e in enumerate(["objopen", "consistent", "reloc"])] + [{"file": "g", "seq": 0, "event": "reloc"}]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{"file": "h", "ev')
    events = packages.audit_events(spark, str(tmp_path / "log.jsonl"))
    assert {tuple(r) for r in packages.audit_outcomes(events).collect()} == {("f", 1, True), ("g", 1, False)}
    files = spark.createDataFrame([("main/zlib-1.2-r3/a",), ("main/zlib-1.2-r3/b",), ("extra/x-1-r0/a",), ("main/short",), (None,)], "path string")
    assert [tuple(r) for r in packages.package_directories(files, ["main", "none"]).collect()] == [("main", "zlib-1.2-r3", 2), ("none", None, 0)]
    assert packages.of_packages(files, "main", ["zlib"]).count() == 2 == packages.of_packages(files, names=["zlib"]).count()


def test_dumps(spark):
    sound = '{"ElfHeader": {"Type": {"Name": "SharedObject (0x3)"}}, "DynamicSection": [{"Type": "SONAME", "Name": "a"}]}'
    defects = '[{"ElfHeader": {"Type": {"Name": "Executable"}Machine: 0x9026\n}, "VersionDefinitions": [{"Definition": {"Name": "A_2"Predecessors: [A_1, A_0]\n}}, {"Definition": {"Name": "A_0"Predecessors: []\n}}]}]'
    texts = [("ok", f"[{sound}]"), ("broken", defects), ("text", "Machine: none\n } {"), ("inside", '[{"DynamicSection": [{"Type": "RUNPATH", "Path": ["} {", ",]"]}]}]'), ("empty", ""), ("null", None)]
    docs = {r.path: r.doc for r in dumps.documents(spark.createDataFrame(texts, "path string, text string")).collect()}
    assert set(docs) == {"ok", "broken", "text", "inside", "empty"} and docs["empty"] is None
    assert docs["broken"].ElfHeader.Machine.Value == 0x9026 and [v.Definition.Predecessors for v in docs["broken"].VersionDefinitions] == [["A_1", "A_0"], []]
    assert docs["inside"].DynamicSection[0].Path == ["} {", ",]"]
    styles = dumps.documents(spark.createDataFrame(texts, "path string, text string")).select("path", dumps.hash_style().alias("style")).collect()
    assert {r.path: r.style for r in styles}["ok"] == "neither"


def test_package_graph(spark):
    rows = [("a", ["so:x", "so:none"], ["so:y"], 0), ("b", ["so:y"], [], 1), ("c", [], ["b"], 0), ("d", ["c", "a"], [], 0)]
    own = spark.createDataFrame(rows, "name string, depends array<string>, conflicts array<string>, priority int")
    providers = spark.createDataFrame([("so:x", "b", 1), ("so:x", "c", 0), ("so:y", "c", 0), ("a", "a", 0), ("b", "b", 0), ("c", "c", 0)], "tag string, provider string, priority int")
    found = graph.package_graph(own.select("name", "depends"), providers)
    assert {r.path: (r.nodes, r.external) for r in graph.file_closures(found).collect()} == {"a": (2, 1), "b": (1, 0), "d": (3, 1)}
    declared = spark.createDataFrame([("a", "c"), ("c", "b"), ("b", "d")], "name string, target string")
    assert {tuple(r) for r in graph.closure_conflicts(found, declared).collect()} == {("a", "a", "c"), ("a", "c", "b"), ("b", "c", "b"), ("d", "a", "c"), ("d", "c", "b"), ("d", "b", "d")}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("<b>", 3), ("c", 1)], "k string, n bigint")
    report.write_site({"one": {"t": df}}, tmp_path)
    assert "&lt;b&gt;" in (tmp_path / "one.html").read_text() and json.loads((tmp_path / "data.json").read_text())["one/t"][1]["n"] == 1
    assert "## t" in report.text_section("t", df, "k", "n")
    assert {r.value for r in report.text_lines(df, "k", "n").collect()} == {"           3  <b>  " + "#" * 30, "           1  c  " + "#" * 10}
    assert {r.value for r in report.html_lines(df.selectExpr("k", "n * 1000 as n")).collect()} == {"<tr><td>&lt;b&gt;</td><td>3,000</td></tr>", "<tr><td>c</td><td>1,000</td></tr>"}
    report.write_parts({"a": df}, f"{tmp_path}/parts")
    assert spark.read.json(f"{tmp_path}/parts/a").count() == 2 and report.text_lines(df.limit(0), "k", "n").count() == 0
    with pytest.raises(ValueError):
        report.rows_of(df, 1)


def test_streams(spark, tmp_path):
    rows = [("f", 0, "consistent", dt.datetime(2024, 1, 1)), ("f", 1, "reloc", dt.datetime(2024, 1, 1, 3)), ("g", 0, "reloc", dt.datetime(2024, 1, 2)), ("g", 1, "reloc", None), ("z", 0, "end", dt.datetime(2024, 3, 1))]
    ddl = "file string, seq int, event string, at timestamp_ntz"
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    counts = run(arrivals.counts_by_window(stream, "at", ["event"]), "counts", "append")
    assert {(r.event, r.n) for r in counts.collect()} >= {("consistent", 1), ("reloc", 1)} and counts.agg(F.sum("n")).first()[0] in (3, 4)
    states = run(arrivals.run_states(stream), "states", "update")
    assert {(r.file, r.relocations, r.ok) for r in states.collect()} == {("f", 1, True), ("g", 2, False), ("z", 0, False)}
    assert run(arrivals.first_seen(stream, ["file"], "at"), "seen", "append").count() <= 4
