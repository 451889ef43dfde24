"""Queries of the sources: images, dumps, indexes, metadata and logs that Spark writes from the given tables and reads back.

Each document says nothing but what its row says, so that SQL over the table gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import scalars as S
from lodestack.functions.records import clean_path, keys_of, library_key
from lodestack.operators import graph, metrics, ranges, rules, sampling
from lodestack.plans import report
from lodestack.plans.corpus import _KEY, _KEYS, _PATH
from lodestack.session import materialise, table, write
from lodestack.sources import dumps, elf_binary, packages
from lodestack.streaming import arrivals

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- images -------------------------------------------------------------------------------


def _le(value: Column, size: int) -> Column:
    """``value`` as ``size`` bytes, the lowest first, in hexadecimal; null is 0."""
    digits = F.lpad(F.hex(F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))), 16, "0")
    return F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)])


def _lit(value: int, size: int) -> Column:
    return F.lit(value.to_bytes(size, "little").hex())


def _header(type_: Column, machine: Column, entry: Column, n_segments: Column, version: Column | None = None) -> Column:
    table_at = F.when(n_segments > 0, 64).otherwise(0)
    fields = [(type_, 2), (machine, 2), (F.lit(1) if version is None else version, 4), (entry, 8), (table_at, 8), (F.lit(0), 8), (F.lit(0), 4), (F.lit(64), 2), (F.lit(56), 2), (n_segments, 2), (F.lit(64), 2), (F.lit(0), 2), (F.lit(0), 2)]
    return F.concat(F.lit("7f454c4602010100" + "00" * 8), *[_le(v, n) for v, n in fields])


def _segment(type_, flags, offset, vaddr, filesz, memsz, align, paddr=None) -> Column:
    return F.concat(_le(type_, 4), _le(flags, 4), _le(offset, 8), _le(vaddr, 8), _le(vaddr if paddr is None else paddr, 8), _le(filesz, 8), _le(memsz, 8), _le(align, 8))


def _segment_images(spark: SparkSession, d: str) -> DataFrame:
    """One image per report with a header: its segment table and nothing else."""
    rows = table(spark, d, "elf_reports").where("header is not null and program_headers is not null")
    parts = F.transform("program_headers", lambda p: _segment(p["p_type"], p["flags"], p["offset"], p["vaddr"], p["filesz"], p["memsz"], p["align"], p["paddr"]))
    image = F.concat(_header(F.col("header.elf_type"), F.col("header.machine"), F.col("header.entry"), F.size("program_headers")), F.array_join(parts, ""))
    return rows.select(F.col("report_id").cast("string").alias("path"), F.unhex(image).alias("content"))


_IMAGE_SEGMENTS = """with seg as (select report_id, header.machine as machine, unnest(program_headers, recursive := true) from (select report_id, header, program_headers from elf_reports where header is not null and header.elf_type not in (1, 4))),
    named as (select *, case p_type when 0 then 'PT_NULL' when 1 then 'PT_LOAD' when 2 then 'PT_DYNAMIC' when 3 then 'PT_INTERP' when 4 then 'PT_NOTE' when 5 then 'PT_SHLIB' when 6 then 'PT_PHDR' when 7 then 'PT_TLS'
        when 1685382480 then 'PT_GNU_EH_FRAME' when 1685382481 then 'PT_GNU_STACK' when 1685382482 then 'PT_GNU_RELRO' when 1685382483 then 'PT_GNU_PROPERTY' else 'unknown' end as name,
        (case when flags & 4 <> 0 then 'PF_R' else '' end) || (case when flags & 2 <> 0 then 'PF_W' else '' end) || (case when flags & 1 <> 0 then 'PF_X' else '' end) as names from seg)"""


@query(_IMAGE_SEGMENTS + " select name, names, count(*) as n, sum(\"offset\" % 1000003)::bigint as offsets, sum(vaddr % 1000003)::bigint as addresses, sum(filesz % 1000003)::bigint as filesz, sum(memsz % 1000003)::bigint as memsz, max(align)::bigint as align from named group by all")
def image_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments as read from images, by type and flags."""
    rows = elf_binary.structure(_segment_images(spark, d)).select(F.explode("program_headers").alias("p"))
    total = lambda c: F.sum(F.col(f"p.{c}").cast("bigint") % 1000003)
    return rows.groupBy(F.col("p.p_type_name").alias("name"), F.array_join("p.flags_names", "").alias("names")).agg(
        F.count("*").alias("n"), total("offset").alias("offsets"), total("vaddr").alias("addresses"), total("filesz").alias("filesz"), total("memsz").alias("memsz"), F.max("p.align").cast("bigint").alias("align")
    )


@query("""with e as (select report_id, header as h, coalesce(program_headers, []) as ph from elf_reports where header is not null and program_headers is not null),
    f as (select *, len(list_filter(ph, lambda p: p.p_type = 1)) > 0 as has_load, len(list_filter(ph, lambda p: p.p_type = 2)) > 0 as has_dynamic, len(list_filter(ph, lambda p: p.p_type = 1 and p.filesz > p.memsz)) > 0 as large,
        len(list_filter(ph, lambda p: p.p_type = 1 and p.flags & 1 <> 0 and p.vaddr <= h.entry and h.entry < p.vaddr + p.memsz)) > 0 as starts from e)
    select case when h.machine <> 62 then 'wrong_machine' when h.elf_type = 1 then 'relocatable' when h.elf_type = 4 then 'core' when large or (h.elf_type in (2, 3) and not has_load) then 'malformed_image'
        when h.elf_type not in (2, 3) then 'other' when starts then 'static_program' when h.elf_type = 3 and has_dynamic then 'dso' else 'load_image' end as kind,
        case h.elf_type when 0 then 'ET_NONE' when 1 then 'ET_REL' when 2 then 'ET_EXEC' when 3 then 'ET_DYN' when 4 then 'ET_CORE' else 'unknown' end as elf_type,
        case h.machine when 3 then 'EM_386' when 40 then 'EM_ARM' when 62 then 'EM_X86_64' when 183 then 'EM_AARCH64' when 243 then 'EM_RISCV' else 'unknown' end as machine, count(*) as n from f group by all""")
def image_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of the same images; the strings of their interpreters are not in them."""
    rows = elf_binary.structure(_segment_images(spark, d))
    return rows.groupBy("kind", F.col("elf_type_name").alias("elf_type"), F.col("machine_name").alias("machine")).agg(F.count("*").alias("n"))


def _program_images(spark: SparkSession, d: str) -> DataFrame:
    """One image per program report: interpreter, dynamic section and string table as the report has them, one loadable segment."""
    strings = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull())
    rows = table(spark, d, "program_reports").select(
        F.col("report_id").cast("string").alias("path"), "interpreter", "soname", strings("needed").alias("needed"), strings("rpath").alias("rpath"), strings("runpath").alias("runpath"),
        F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("role_evidence.entry_in_executable_load", F.lit(False)).alias("starts"), F.coalesce("role_evidence.df_1_pie", F.lit(False)).alias("pie"),
    )
    n, text = F.lit(3), lambda c: F.concat(F.hex(F.col(c).cast("binary")), F.lit("00"))
    tagged = lambda values, tag: F.transform(values, lambda x: F.struct(F.lit(tag).alias("tag"), x.alias("text")))
    listed = F.concat(tagged("needed", 1), tagged("rpath", 15), tagged("runpath", 29), tagged(F.array_compact(F.array("soname")), 14))
    rows = rows.withColumn("interp", F.coalesce(text("interpreter"), F.lit(""))).withColumn("listed", listed)
    # places of the strings: the table begins with an empty one
    place = F.aggregate("listed", F.struct(F.lit(1).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all")), lambda a, x: F.struct((a["at"] + F.octet_length(x["text"]) + 1).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))
    rows = rows.withColumn("place", place).withColumn("strings", F.concat(F.lit("00"), F.array_join(F.transform("listed", lambda x: F.concat(F.hex(x["text"].cast("binary")), F.lit("00"))), "")))
    base = F.when(F.col("starts"), F.col("entry") - F.col("entry").bitwiseAND(F.lit(0xFFF))).otherwise(F.lit(0))
    first = F.lit(64) + n * 56
    dynamic_at = first + F.length("interp") / 2
    entries = F.size("listed") + 4
    strings_at = dynamic_at + entries * 16
    size = strings_at + F.length("strings") / 2
    own = F.array_join(F.transform(F.arrays_zip("listed", F.col("place.all").alias("at")), lambda x: F.concat(_le(x["listed"]["tag"], 8), _le(x["at"], 8))), "")
    dynamic = F.concat(own, _lit(5, 8), _le(base + strings_at, 8), _lit(10, 8), _le(F.length("strings") / 2, 8), _lit(0x6FFFFFFB, 8), _le(F.when(F.col("pie"), 0x08000000).otherwise(0), 8), _lit(0, 16))
    room = F.greatest(size, F.lit(4096))
    image = F.concat(
        _header(F.lit(3), F.lit(62), F.col("entry"), n),
        _segment(F.lit(1), F.when(F.col("starts"), 5).otherwise(4), F.lit(0), base, room, room, F.lit(4096)),
        _segment(F.when(F.col("interpreter").isNotNull(), 3).otherwise(0), F.lit(4), first, base + first, F.length("interp") / 2, F.length("interp") / 2, F.lit(1)),
        _segment(F.lit(2), F.lit(6), dynamic_at, base + dynamic_at, entries * 16, entries * 16, F.lit(8)),
        F.col("interp"), dynamic, F.col("strings"),
    )
    return rows.select("path", F.unhex(image).alias("content"))


_NOT_NULL = "list_filter(coalesce({0}, []), lambda x: x is not null)"
_PROGRAMS = f"""with p as (select report_id, interpreter, soname, {_NOT_NULL.format('needed')} as needed, {_NOT_NULL.format('rpath')} as rpath, {_NOT_NULL.format('runpath')} as runpath,
        coalesce(role_evidence.entry_in_executable_load, false) as starts, coalesce(role_evidence.df_1_pie, false) as pie, coalesce(entry, 0) as entry from program_reports),
    k as (select *, case when interpreter is not null then 'dynamic_program' when starts and (pie or soname is null) then 'static_program' else 'dso' end as kind from p)"""


@query(_PROGRAMS + " select report_id::varchar as path, kind as elf_kind, entry::varchar as entry, string_split(interpreter, chr(0))[1] as interpreter, soname, needed, rpath, runpath, starts, pie from k where kind <> 'dso'")
def image_programs(spark: SparkSession, d: str) -> DataFrame:
    """Program reports of images, which give back what the images were written from."""
    rows = elf_binary.programs(elf_binary.structure(_program_images(spark, d)))
    return rows.select(
        "path", "elf_kind", F.col("entry").cast("string").alias("entry"), "interpreter", "soname", "needed", "rpath", "runpath",
        F.col("role_evidence.entry_in_executable_load").alias("starts"), F.col("role_evidence.df_1_pie").alias("pie"),
    )


@query(_PROGRAMS + " select kind, count(*) as n, count(soname) as sonames, sum(len(needed))::bigint as entries, 0 as issues from k group by 1")
def image_dynamics(spark: SparkSession, d: str) -> DataFrame:
    """Dynamic sections of all images of programs and libraries."""
    rows = elf_binary.structure(_program_images(spark, d))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count("dynamic.soname").alias("sonames"), F.sum(F.size("dynamic.needed").cast("bigint")).alias("entries"), F.sum(F.size("issues")).cast("int").alias("issues"))


# ---- dumps --------------------------------------------------------------------------------


def _dumps(spark: SparkSession, d: str) -> DataFrame:
    """One dump per program report, with the defects that dumps have: of each file the sections that its columns tell of."""
    named = lambda name: F.struct(F.lit(name).alias("Name") if isinstance(name, str) else name.alias("Name"))
    entry = lambda tag, **more: F.struct(F.lit(tag).alias("Type"), *[more.get(f, F.lit(None).cast(t)).alias(f) for f, t in (("Value", "string"), ("Library", "string"), ("Name", "string"), ("Path", "array<string>"))])
    when = lambda test, value: F.when(test, value)
    relocation = lambda name: F.struct(F.struct(named(name).alias("Type")).alias("Relocation"))
    c = F.col
    needed = F.transform(F.coalesce("needed", F.array().cast("array<string>")), lambda x: entry("NEEDED", Library=x))
    single = F.array_compact(F.array(
        when(c("soname").isNotNull(), entry("SONAME", Name=c("soname"))), when(F.size("rpath") > 0, entry("RPATH", Path=c("rpath"))), when(F.size("runpath") > 0, entry("RUNPATH", Path=c("runpath"))),
        when(c("soname").isNotNull(), entry("HASH")), when(c("interpreter").isNotNull(), entry("GNU_HASH")), when(c("elf_kind") == "dso", entry("STRTAB")), when(F.size("needed") > 0, entry("JMPREL")),
        when(c("role_evidence.df_1_pie"), entry("TEXTREL")), when(c("interpreter").isNotNull(), entry("PLTREL", Value=F.when(c("role_evidence.has_soname"), "0x11").otherwise("REL"))),
    ))
    relocations = F.concat(F.transform(F.coalesce("needed", F.array().cast("array<string>")), lambda x: relocation("R_X86_64_JUMP_SLOT")), F.array_compact(F.array(
        when(c("soname").isNotNull(), relocation("R_X86_64_RELATIVE")), when(F.size("rpath") > 0, relocation("R_X86_64_COPY")), when(c("role_evidence.df_1_pie"), relocation("R_X86_64_IRELATIVE")),
        when(c("interpreter").isNotNull(), relocation("R_X86_64_TPOFF64")),
    )))
    segments = F.array_compact(F.array(when(c("interpreter").isNotNull(), F.struct(F.struct(named("PT_INTERP").alias("Type")).alias("ProgramHeader"))), when(c("role_evidence.has_pt_dynamic"), F.struct(F.struct(named("PT_DYNAMIC").alias("Type")).alias("ProgramHeader")))))
    level = F.concat(F.lit("x86 ISA needed: x86-64-baseline, x86-64-v"), F.pmod(c("source.size"), F.lit(3)) + 2)
    notes = F.array(F.struct(F.struct(F.array(F.struct(F.substring("source.sha256", 1, 40).alias("Build ID"), F.array(level, F.concat(F.lit("x86 feature: IBT"), F.when(c("soname").isNotNull(), ", SHSTK").otherwise(""))).alias("Property"))).alias("Notes")).alias("NoteSection")))
    doc = F.to_json(F.struct(
        F.struct(F.struct(F.when(c("elf_kind") == "static_program", "Executable").otherwise("SharedObject").alias("Name")).alias("Type"), F.lit("@machine").alias("_m")).alias("ElfHeader"), segments.alias("ProgramHeaders"),
        F.concat(needed, single).alias("DynamicSection"), F.array(F.struct(relocations.alias("Relocs"))).alias("Relocations"), notes.alias("NoteSections"),
        F.array(F.struct(F.struct(F.lit("V_1").alias("Name"), F.lit("@before").alias("_p")).alias("Definition"))).alias("VersionDefinitions"),
    ))
    # the two defects: a bare number for the machine, names without quotes
    broken = F.regexp_replace(F.regexp_replace(doc, ',"_m":"@machine"', "Machine: 0x3E\n"), ',"_p":"@before"', "Predecessors: [V_0, V_00]\n")
    return table(spark, d, "program_reports").select(c("report_id").cast("string").alias("path"), F.concat(F.lit("["), broken, F.lit("]")).alias("text"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return dumps.documents(_dumps(spark, d))


_DUMPED = """with p as (select report_id::varchar as path, *, elf_kind = 'static_program' as fixed, coalesce(len(needed), 0) as n_needed, coalesce(len(rpath), 0) > 0 as has_rpath, coalesce(len(runpath), 0) > 0 as has_runpath,
        interpreter is not null as has_interp, soname is not null as has_soname, coalesce(role_evidence.df_1_pie, false) as pie, elf_kind = 'dso' as is_dso, coalesce(role_evidence.has_pt_dynamic, false) as dyn from program_reports),
    q as (select *, n_needed > 0 or has_rpath or has_runpath or has_interp or has_soname or pie or is_dso as filled from p)"""


@query(_DUMPED + " select count(*) as documents, count(*) as machines, 62::bigint as machine, 2 * count(*) as predecessors from p")
def dump_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Documents that can be read once their defects are mended."""
    docs = _documents(spark, d).where("doc is not null")
    before = F.aggregate(F.transform("doc.VersionDefinitions", lambda v: F.size(v["Definition"]["Predecessors"])), F.lit(0), lambda a, x: a + x)
    return docs.agg(F.count("*").alias("documents"), F.count("doc.ElfHeader.Machine.Value").alias("machines"), F.max("doc.ElfHeader.Machine.Value").alias("machine"), F.sum(before).alias("predecessors"))


@query(_DUMPED + """ select tag, count(*) as files, sum(n)::bigint as occurrences from (select path, 'NEEDED' as tag, n_needed as n from q union all select path, 'SONAME', has_soname::int from q union all select path, 'RPATH', has_rpath::int from q
    union all select path, 'RUNPATH', has_runpath::int from q union all select path, 'HASH', has_soname::int from q union all select path, 'GNU_HASH', has_interp::int from q union all select path, 'STRTAB', is_dso::int from q
    union all select path, 'JMPREL', (n_needed > 0)::int from q union all select path, 'TEXTREL', pie::int from q union all select path, 'PLTREL', has_interp::int from q) where n > 0 group by 1""")
def dump_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).select("path", F.explode("doc.DynamicSection.Type").alias("tag"))
    return rows.groupBy("tag", "path").agg(F.count("*").alias("n")).groupBy("tag").agg(F.count("*").alias("files"), F.sum("n").alias("occurrences"))


@query(_DUMPED + " select case when has_soname and has_interp then 'both' when has_soname then 'HASH' when has_interp then 'GNU_HASH' when filled then 'neither' else 'none asked' end as style, count(*) as n from q group by 1")
def dump_hash_styles(spark: SparkSession, d: str) -> DataFrame:
    """Exclusive classes."""
    return _documents(spark, d).groupBy(dumps.hash_style().alias("style")).agg(F.count("*").alias("n"))


@query(_DUMPED + """ select metric, n from (select count(*) filter (has_runpath) as runpath, count(*) filter (has_rpath) as rpath, 0::bigint as bind_now, count(*) filter (pie) as textrel, 0::bigint as relr, count(*) filter (n_needed > 0) as jmprel, count(*) filter (has_soname) as soname,
    count(*) filter (n_needed = 0 and not has_soname and not has_rpath and not pie and not has_interp) as no_relocations, count(*) filter (pie) as ifunc, count(*) filter (has_rpath) as copy, count(*) filter (has_interp) as tls_relocations,
    count(*) as verdef, count(*) filter (length(source.sha256) > 0) as build_id from q) unpivot (n for metric in (runpath, rpath, bind_now, textrel, relr, jmprel, soname, no_relocations, ifunc, copy, tls_relocations, verdef, build_id))""")
def dump_presence(spark: SparkSession, d: str) -> DataFrame:
    return metrics.presence(_documents(spark, d), dumps.presence_flags())


@query(_DUMPED + """ select 'Unknown' as machine, type, count(*) as files, sum(n)::bigint as occurrences from (select path, 'R_X86_64_JUMP_SLOT' as type, n_needed as n from q union all select path, 'R_X86_64_RELATIVE', has_soname::int from q
    union all select path, 'R_X86_64_COPY', has_rpath::int from q union all select path, 'R_X86_64_IRELATIVE', pie::int from q union all select path, 'R_X86_64_TPOFF64', has_interp::int from q) where n > 0 group by 2""")
def dump_relocations(spark: SparkSession, d: str) -> DataFrame:
    return dumps.relocation_counts(_documents(spark, d))


@query(_DUMPED + """ select metric, key, count(*) as files from (select path, 'build_id_bytes' as metric, (length(source.sha256[1:40]) // 2)::varchar as key from q where length(source.sha256) > 0
    union all select path, 'cet', 'IBT' from q where source is not null union all select path, 'cet', 'SHSTK' from q where has_soname union all select path, 'isa', 'x86-64-v' || (source.size % 3 + 2) from q where source.size is not null) group by all""")
def dump_notes(spark: SparkSession, d: str) -> DataFrame:
    return dumps.note_features(_documents(spark, d))


@query(_DUMPED + """, hits as (select path, unnest([
        {'anomaly': 'dyn_textrel', 'hits': pie::int}, {'anomaly': 'dyn_pltrel_bad_value', 'hits': (has_interp and not coalesce(role_evidence.has_soname, false))::int},
        {'anomaly': 'dyn_missing_mandatory', 'hits': case when filled then 3 + (not is_dso)::int else 0 end}, {'anomaly': 'dyn_rpath_and_runpath', 'hits': (has_rpath and has_runpath)::int},
        {'anomaly': 'dyn_missing_dependency', 'hits': (not is_dso)::int * ((n_needed > 0)::int + has_soname::int + has_rpath::int + has_runpath::int) + has_soname::int + has_interp::int + is_dso::int
            + case when n_needed > 0 then 1 + (not has_interp)::int else 0 end + (has_interp and n_needed = 0)::int},
        {'anomaly': 'dyn_no_hash', 'hits': (filled and not has_soname and not has_interp)::int}, {'anomaly': 'dyn_static_exec_with_dynamic', 'hits': (fixed and not has_interp and dyn)::int}, {'anomaly': 'dyn_empty', 'hits': (not filled)::int}], recursive := true) from q)
    select anomaly, count(*) as files, sum(hits)::bigint as hits from hits where hits > 0 group by 1""")
def dump_anomalies(spark: SparkSession, d: str) -> DataFrame:
    rows = dumps.dynamic_rows(_documents(spark, d).where("doc is not null"))
    return rules.anomalies(rows, rules.dynamic_rules(), ["path"]).groupBy("anomaly").agg(F.count("*").alias("files"), F.sum("hits").alias("hits"))


@query(_DUMPED + f" select path from q where has_interp and filled and {_PATH.format('source.relative')} in (select {_PATH.format('source.relative')} from elf_reports)")
def audit_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Programs with an interpreter and a dynamic section whose file is still listed."""
    paths = table(spark, d, "program_reports").select(F.col("report_id").cast("string").alias("path"), clean_path(F.col("source.relative")).alias("file"))
    present = table(spark, d, "elf_reports").select(clean_path(F.col("source.relative")).alias("file")).distinct()
    return dumps.audit_candidates(_documents(spark, d), paths.join(present, "file", "left_semi"))


def _binding(symbol: Column) -> Column:
    return F.get(F.array(*map(F.lit, ("Global", "Weak", "Local"))), F.length(symbol) % 3)


@query("""select path, symbol from (select path, soname, unnest(exports) as symbol from graph_record where soname is not null) where length(symbol) % 3 <> 2 and length(symbol) % 5 <> 4 and symbol <> '' group by all""")
def exported_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of the base libraries as dumps show them, some local and some undefined."""
    symbol = lambda x: F.struct(F.struct(F.struct(x.alias("Name")).alias("Name"), F.struct(_binding(x).alias("Name")).alias("Binding"), F.struct(F.when(F.length(x) % 5 == 4, "Undefined").otherwise(".text").alias("Name")).alias("Section")).alias("Symbol"))
    soname = F.when(F.col("soname").isNotNull(), F.array(F.struct(F.lit("SONAME").alias("Type"))))
    text = F.to_json(F.array(F.struct(soname.alias("DynamicSection"), F.transform("exports", symbol).alias("DynamicSymbols"))))
    return dumps.exported_symbols(dumps.documents(table(spark, d, "graph_record").select("path", text.alias("text")))).distinct()


# ---- packages -----------------------------------------------------------------------------


def _index(spark: SparkSession, d: str) -> DataFrame:
    """An index entry per program report: its keys are what it depends on, its soname is what it provides and what it conflicts with is its first key backwards."""
    keys = F.array_distinct(keys_of(F.col("needed")))
    provides = library_key(F.col("soname"))
    clean = lambda c: F.regexp_replace(c, r"[\s<>=~!]", "_")
    depends = F.concat(F.transform(keys, lambda k: F.concat(F.lit("so:"), clean(k), F.lit(">=1"))), F.transform(F.filter(F.array(provides), lambda k: k.isNotNull()), lambda k: F.concat(F.lit("!so:"), clean(k), F.lit("<1"))))
    text = F.concat_ws("\n", F.lit("T:old"), F.concat(F.lit("P:r"), F.col("report_id")), F.concat(F.lit("V:"), F.col("schema_version"), F.lit("-r0")), F.concat(F.lit("D:"), F.array_join(depends, " ")),
        F.concat(F.lit("p:so:"), clean(provides), F.lit("=1")), F.concat(F.lit("k:"), F.when(F.length("soname") % 2 == 0, F.length("soname").cast("string")).otherwise("none")), F.lit("T:new"))
    return table(spark, d, "program_reports").select(F.lit("main").alias("repo"), text.alias("text"))


def _packages(spark: SparkSession, d: str) -> DataFrame:
    return packages.index_packages(packages.index_records(_index(spark, d)), ["main"])


_CLEAN = "regexp_replace({0}, '[ \\t\\r\\n<>=~!]', '_', 'g')"
_INDEX = f"""with p as (select 'r' || report_id as name, schema_version || '-r0' as version, list_transform(list_distinct({_KEYS.format('needed')}), lambda k: 'so:' || {_CLEAN.format('k')}) as depends, 'so:' || {_CLEAN.format(_KEY.format('soname'))} as tag,
        case when length(soname) % 2 = 0 then length(soname) else 0 end as priority from program_reports)"""


@query(_INDEX + " select name, version, priority::int as priority, len(depends)::int as n_depends, tag as provides, (tag is not null)::int as n_conflicts from p")
def index_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = _packages(spark, d)
    return rows.select("name", "version", "priority", F.size("depends").alias("n_depends"), F.get("provides", 0).alias("provides"), F.size("conflicts").alias("n_conflicts"))


_PICKED = _INDEX.replace("with p as", "with recursive p as") + """, tags as (select tag, name as provider, priority from p where tag is not null union all select name, name, priority from p),
    best as (select tag, provider as pick, priority from (select *, row_number() over (partition by tag order by priority desc, provider) as r from tags) where r = 1),
    asked as (select name, unnest(list_distinct(depends)) as dep from p), picked as (select name, dep, pick, priority from asked left join best on best.tag = asked.dep)"""


@query(_PICKED + " select dep, pick, coalesce(priority, -1)::int as priority, count(*) as n from picked group by all")
def package_picks(spark: SparkSession, d: str) -> DataFrame:
    rows = _packages(spark, d)
    wanted = rows.select("name", F.explode(F.array_distinct("depends")).alias("dep"))
    return graph.package_picks(wanted, packages.tag_providers(rows)).groupBy("dep", "pick", F.coalesce("priority", F.lit(-1)).alias("priority")).agg(F.count("*").alias("n"))


_CLOSED = _PICKED + """, e as (select name as src, coalesce(pick, '?' || dep) as dst from picked), walk as (select src, dst from e union select walk.src, e.dst from walk join e on e.src = walk.dst)"""


@query(_CLOSED + " select src as path, count(distinct dst) filter (dst not like '?%' and dst <> src) as packages, count(distinct dst) filter (dst like '?%') as unresolved from walk group by 1")
def package_closures(spark: SparkSession, d: str) -> DataFrame:
    """What each package needs, directly or not, by priority, and what nothing provides."""
    rows = materialise(_packages(spark, d), "packages")
    found = graph.file_closures(graph.package_graph(rows, packages.tag_providers(rows)))
    return found.select("path", F.col("nodes").alias("packages"), F.col("external").alias("unresolved"))


@query(_CLOSED + """, members as (select src, dst from walk where dst not like '?%' union select name, name from p), declared as (select p.name, best.pick as target from p join best on best.tag = p.tag where best.pick <> p.name)
    select a.src as root, name, target from members a join declared on declared.name = a.dst join members b on b.src = a.src and b.dst = target""")
def package_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Conflicts between a package and the one preferred for what it provides, where both are in a closure."""
    rows = materialise(_packages(spark, d), "packages")
    providers = packages.tag_providers(rows)
    declared = graph.package_picks(rows.select("name", F.explode("conflicts").alias("dep")), providers).where("pick <> name").select("name", F.col("pick").alias("target"))
    return graph.closure_conflicts(graph.package_graph(rows, providers), materialise(declared, "conflicts"))


@query(f"""select repo, package, count(path) as files from (select unnest(['core', 'edge', 'absent']) as repo) w left join (select {_PATH.format('source.relative')} as path, string_split({_PATH.format('source.relative')}, '/')[1] as r,
    string_split({_PATH.format('source.relative')}, '/')[2] as package from program_reports where len(string_split({_PATH.format('source.relative')}, '/')) > 2) f on f.r = w.repo group by all""")
def package_directories(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "program_reports").select(clean_path(F.col("source.relative")).alias("path"))
    return packages.package_directories(files, ["core", "edge", "absent"])


@query(f"""with f as (select {_PATH.format('source.relative')} as path from program_reports), n as (select path, regexp_replace(string_split(path, '/')[2], '-[^-]+-r[0-9]+$', '') as name, string_split(path, '/')[1] as repo from f),
    top as (select name from n where repo = 'core' and name is not null group by 1 order by count(*) desc, name limit 5) select path, count(*) as n from n where repo = 'core' and name in (select name from top) group by 1""")
def files_of_packages(spark: SparkSession, d: str) -> DataFrame:
    """Files in one repository of the five packages with most files."""
    files = table(spark, d, "program_reports").select(clean_path(F.col("source.relative")).alias("path"))
    name = S.package_name(F.get(F.split("path", "/"), 1)).alias("name")
    counted = packages.of_packages(files, "core").groupBy(name).agg(F.count("*").alias("n")).where("name is not null")
    top = [r.name for r in sampling.top(counted, [F.desc("n"), F.col("name")], 5).collect()]
    return packages.of_packages(files, "core", top).groupBy("path").agg(F.count("*").alias("n"))


@query("""select package, key, value, n from (select 'p' || p_partkey as package, [{'key': 'pkgname', 'value': p_name}, {'key': 'size', 'value': p_size::varchar}, {'key': 'depend', 'value': p_type || ' ' || p_brand}] as kv from part),
    unnest(kv) as u(e), lateral (select e.key as key, e.value as value, case when e.key = 'depend' then 2 else 1 end as n)""")
def package_metadata(spark: SparkSession, d: str) -> DataFrame:
    """``key = value`` texts; repeated keys keep their order."""
    c = F.col
    text = F.concat(F.lit("# made\n\npkgname = "), c("p_name"), F.lit("\r\nsize =  "), c("p_size").cast("string"), F.lit("\ndepend = "), c("p_type"), F.lit("\nnonsense\ndepend = "), c("p_brand"), F.lit("\n"))
    files = table(spark, d, "part").select(F.concat(F.lit("p"), c("p_partkey")).alias("package"), text.alias("text"))
    return packages.metadata(files).select("package", "key", F.array_join("values", " ").alias("value"), F.size("values").alias("n"))


# ---- logs and addresses -------------------------------------------------------------------


@query("""select 'u' || user_id as file, count(*) filter (event_type = 'click') as relocations, bool_or(event_type = 'purchase') and count(*) filter (event_type = 'click') > 0 as ok from events group by 1""")
def audit_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Logs of runs, written as lines of JSON, some cut off, and read again."""
    kind = F.when(F.col("event_type") == "click", "reloc").when(F.col("event_type") == "purchase", "consistent").otherwise("search")
    line = F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id")).alias("file"), F.col("event_id").alias("seq"), kind.alias("event")))
    events = table(spark, d, "events")
    path = write_text(events.select(line.alias("value")).unionByName(events.select(F.substring(line, 1, 9).alias("value"))))
    return packages.audit_outcomes(packages.audit_events(spark, path))


def write_text(lines: DataFrame) -> str:
    path = write(lines.limit(0), "lines")  # names a folder that is removed in the end
    lines.write.text(f"{path}/text")
    return f"{path}/text"


_WORDS = "with w as (select report_id, unnest(program_headers, recursive := true) from (select report_id, program_headers from elf_reports)), k as (select report_id, index, case when index % 3 = 0 then vaddr - vaddr % 2 else filesz * 2 + 1 end as word from w)"


@query(_WORDS + """, g as (select *, sum((word % 2 = 0)::int) over (partition by report_id order by index) as grp from k), b as (select *, coalesce(first_value(case when word % 2 = 0 then word end) over (partition by report_id, grp order by index) + 8, 0) as base,
        sum((word % 2 <> 0)::int) over (partition by report_id, grp order by index) - 1 as nth from g),
    slots as (select report_id, unnest(case when word % 2 = 0 then [word] else list_transform(list_filter(range(1, 64), lambda i: (word >> i) & 1 = 1), lambda i: base + (nth * 63 + i - 1) * 8) end) as slot from b)
    select report_id, count(*) as slots, sum(slot % 1000003)::bigint as total, min(slot)::bigint as first from slots group by 1""")
def address_lists(spark: SparkSession, d: str) -> DataFrame:
    """Segments as a compressed list of addresses: every third word a base, the sizes between them bitmaps."""
    rows = table(spark, d, "elf_reports").select("report_id", F.inline("program_headers"))
    words = rows.select("report_id", "index", F.when(F.col("index") % 3 == 0, F.col("vaddr") - F.col("vaddr") % 2).otherwise(F.col("filesz") * 2 + 1).alias("word"))
    slots = ranges.bitmap_slots(words, ["report_id"], "index", "word")
    return slots.groupBy("report_id").agg(F.count("*").alias("slots"), F.sum(F.col("slot") % 1000003).alias("total"), F.min("slot").alias("first"))


def _case(column: str, names: dict[int, str], other: str) -> str:
    return f"case {column} " + " ".join(f"when {k} then '{v}'" for k, v in names.items()) + f" else '{other}' end"


@query(f"""select what, name, count(*) as n from (select 'relocation' as what, {_case('c', S.RELOCATIONS, 'UNKNOWN')} as name from (select l_partkey % 40 as c from lineitem)
    union all select 'auxiliary', {_case('c', S.AUXILIARY, 'AT_UNKNOWN')} from (select l_partkey % 55 as c from lineitem) union all select 'state', {_case('c', S.LOADER_STATES, 'RT_UNKNOWN')} from (select l_linenumber - 1 as c from lineitem)) group by all""")
def code_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of relocation, auxiliary and state codes."""
    names = {"relocation": (F.col("l_partkey") % 40, S.RELOCATIONS, "UNKNOWN"), "auxiliary": (F.col("l_partkey") % 55, S.AUXILIARY, "AT_UNKNOWN"), "state": (F.col("l_linenumber") - 1, S.LOADER_STATES, "RT_UNKNOWN")}
    rows = F.array(*[F.struct(F.lit(what).alias("what"), S.named(code, table_, other).alias("name")) for what, (code, table_, other) in names.items()])
    return table(spark, d, "lineitem").select(F.inline(rows)).groupBy("what", "name").agg(F.count("*").alias("n"))


@query(r"""with p as (select report_id, source.relative as r, list_filter(string_split(source.relative, '/'), lambda x: x <> '' and x <> '.') as parts from program_reports)
    select report_id, case when r not like '/%' and len(parts) > 0 and not list_contains(parts, '..') then array_to_string(parts, '/') end as member, array_to_string(list_concat(parts[1:len(parts) - 2], ['x', 'y']), '/') as target,
    case when len(parts) < 2 then null else '../' || array_to_string(list_concat(['x'], ['y']), '/') end as seen from p where r is not null and len(parts) > 1""")
def archive_paths(spark: SparkSession, d: str) -> DataFrame:
    """Members, link targets against the folder of the link, and targets as seen from it."""
    r = F.col("source.relative")
    rows = table(spark, d, "program_reports").select("report_id", r.alias("r"), clean_path(r).alias("p")).where("r is not null and instr(p, '/') > 0")
    folder = F.regexp_extract("p", "^(.*)/[^/]*$", 1)
    target = S.link_target(F.col("p"), F.lit("../x/./z/../y"))
    return rows.select("report_id", S.archive_path(F.col("r")).alias("member"), target.alias("target"), S.relative_path(folder, target).alias("seen"))


@query("""with s as (select report_id, e.p as p from program_reports, unnest(list_concat(coalesce(rpath, []), coalesce(runpath, []))) as e(p)),
    t as (select report_id, list_transform(list_filter(string_split(p, ':'), lambda x: x <> '' and not contains(x, '$ORIGIN')), lambda x: case when x like '/%' then '/sys' || x else x end) as kept from s where p is not null)
    select report_id, array_to_string(kept, ':') as kept, len(kept)::int as n from t""")
def search_paths(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = table(spark, d, "program_reports").select("report_id", F.explode(F.concat(F.coalesce("rpath", none), F.coalesce("runpath", none))).alias("p")).where("p is not null")
    kept = S.search_path(F.col("p"), "/sys")
    return rows.select("report_id", F.array_join(kept, ":").alias("kept"), F.size(kept).alias("n"))


@query("""select header.machine_name as machine, header.machine::bigint as code, case header.flags when 0 then 'none' else 'some' end as flags, count(*) as n from elf_reports where header.machine_name is not null group by all""")
def enum_texts(spark: SparkSession, d: str) -> DataFrame:
    """Names and numbers as dumps write them, read back."""
    h = F.col("header")
    rows = table(spark, d, "elf_reports").where("header.machine_name is not null").select(
        F.concat(h["machine_name"], F.lit(" (0x"), F.hex(h["machine"]), F.lit(")")).alias("text"), F.concat(F.lit("0x"), F.lower(F.hex(h["machine"]))).alias("code"), h["flags"].alias("flags")
    )
    flags = S.joined_flags(F.col("flags"), ((1 << 62, "top"),), "none", "some")
    return rows.groupBy(S.enum_name(F.col("text")).alias("machine"), S.parse_integer(F.col("code")).alias("code"), flags.alias("flags")).agg(F.count("*").alias("n"))


@query("""select report_id, min(vaddr) over (partition by report_id, name) as base, vaddr - min(vaddr) over (partition by report_id, name) as rel, index from
    (select report_id, coalesce(p_type_name, '') as name, vaddr, index from (select report_id, unnest(program_headers, recursive := true) from (select report_id, program_headers from elf_reports)))""")
def load_bases(spark: SparkSession, d: str) -> DataFrame:
    """Lowest address of all segments of one name in a file, and addresses relative to it."""
    rows = table(spark, d, "elf_reports").select("report_id", F.inline("program_headers")).select("report_id", F.coalesce("p_type_name", F.lit("")).alias("name"), "vaddr", "index")
    based = ranges.load_base(rows, ["report_id"], "name", "vaddr")
    return based.select("report_id", "base", (F.col("vaddr") - F.col("base")).alias("rel"), "index")


@query("""select report_id, relative, total from (select report_id, source.relative as relative, count(*) over () as total from elflint_reports where status in ('failed', 'timeout')) order by report_id limit 20""")
def first_failures(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 runs that failed, with the number of all."""
    rows = table(spark, d, "elflint_reports").where(F.col("status").isin("failed", "timeout")).select("report_id", F.col("source.relative").alias("relative"))
    return sampling.first_with_total(rows, [F.col("report_id")], 20)


# ---- reports ------------------------------------------------------------------------------


@query("""with c as (select event_type as key, count(*) as n from events group by 1) select lpad(n::varchar, 12, ' ') || '  ' || coalesce(key, '(none)') || '  ' || repeat('#', round(30 * n / (select max(n) from c))::int) as value from c""")
def text_report(spark: SparkSession, d: str) -> DataFrame:
    return report.text_lines(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n")


_ESCAPE = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


@query(f"""with c as (select f, count(*) as n from (select unnest(findings) as f from elflint_reports) group by 1) select '<tr><td>' || coalesce({_ESCAPE.format('f')}, '') || '</td><td>' || format('{{:,}}', n) || '</td></tr>' as value from c""")
def html_report(spark: SparkSession, d: str) -> DataFrame:
    """Findings as rows of a table."""
    return report.html_lines(table(spark, d, "elflint_reports").select(F.explode("findings").alias("f")).groupBy("f").agg(F.count("*").alias("n")))


@query("select kind, count(*) as n from elf_reports group by 1")
def report_parts(spark: SparkSession, d: str) -> DataFrame:
    """A part of a report, written as lines of JSON and read again."""
    counted = table(spark, d, "elf_reports").groupBy("kind").agg(F.count("*").alias("n"))
    folder = f"{write(counted.limit(0), 'report')}/parts"
    report.write_parts({"kinds": counted}, folder)
    return spark.read.schema(counted.schema).json(f"{folder}/kinds")


# ---- streams ------------------------------------------------------------------------------


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """What a stream gives until its source is used up, every batch written into a folder of its own."""
    spark, folder = stream.sparkSession, write(stream.sparkSession.range(0), name)
    batch = lambda df, number: df.write.mode("overwrite").parquet(f"{folder}/batches/{number}")
    running = stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/batches/*")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # a pattern, as a stream takes a folder or a pattern but no single file
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


@query(f"select distinct {_PATH.format('source.relative')} as path, lower(source.sha256) as sha from program_reports where arrived_at is not null")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Records of a stream of reports, each as it first arrives."""
    rows = _stream(spark, d, "program_reports").select(clean_path(F.col("source.relative")).alias("path"), F.lower("source.sha256").alias("sha"), "arrived_at").where("arrived_at is not null")
    return drained(arrivals.first_seen(rows, ["path", "sha"], "arrived_at"), "first-seen", "append").select("path", "sha")


@query("""select 'u' || user_id as file, bool_or(event_type = 'purchase') as fenced, count(*) filter (event_type = 'click') as relocations, bool_or(event_type = 'purchase') and count(*) filter (event_type = 'click') > 0 as ok from events group by 1""")
def stream_run_states(spark: SparkSession, d: str) -> DataFrame:
    """State of each run of a stream of its events, as it was last."""
    kind = F.when(F.col("event_type") == "click", "reloc").when(F.col("event_type") == "purchase", "consistent").otherwise("search")
    rows = _stream(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("file"), kind.alias("event"))
    seen = drained(arrivals.run_states(rows), "run-states", "update")
    return seen.groupBy("file").agg(F.max("fenced").alias("fenced"), F.max("relocations").alias("relocations"), F.max("ok").alias("ok"))
