"""Queries over the report tables: what a survey of a corpus of binaries asks, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import scalars as S
from lodestack.functions.records import clean_path, keys_of, library_key, package_of, term
from lodestack.operators import graph, incremental, lint, metrics, ranges, rules, sampling
from lodestack.session import materialise, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PATH = "array_to_string(list_filter(string_split({0}, '/'), lambda x: x <> '' and x <> '.'), '/')"
_KEY = r"nullif(regexp_extract(trim({0}, E' \t\r\n'), '[^/]*$'), '')"
_KEYS = "list_filter(list_transform(coalesce({0}, []), lambda x: " + _KEY.format("x") + "), lambda y: y is not null)"
_TERM = r"nullif(regexp_replace(trim({0}, E' \t\r\n'), '[ \t\r\n]+', ' ', 'g'), '')"


# ---- findings -----------------------------------------------------------------------------

_TEMPLATE = "{0}"
for _pattern, _to in S.MESSAGE_REWRITES:
    _TEMPLATE = f"regexp_replace({_TEMPLATE}, '" + _pattern.replace("'", "''") + "', '" + _to.replace("'", "''") + "', 'g')"
_FINDINGS = f"""with found as (select report_id, source.relative as relative, unnest(findings) as f from elflint_reports where status is null or status not in ('timeout', 'failed')),
    kinds as (select report_id, relative, trim({_TEMPLATE.format('f')}) as kind from found where f is not null)"""


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return lint.findings(table(spark, d, "elflint_reports"))


@query(_FINDINGS + " select kind, count(*) as n_findings, count(distinct report_id) as n_reports from kinds group by kind")
def finding_templates(spark: SparkSession, d: str) -> DataFrame:
    return lint.template_counts(_findings(spark, d))


@query(_FINDINGS + """ select kind, relative from (select kind, relative, row_number() over (partition by kind order by md5(kind || '|' || relative), relative) as r
    from (select distinct kind, relative from kinds where relative is not null)) where r <= 10""")
def finding_samples(spark: SparkSession, d: str) -> DataFrame:
    return lint.template_samples(_findings(spark, d))


@query("""select case when n <= 0 then '0' when n <= 1 then '1' when n <= 5 then '2-5' when n <= 10 then '6-10' when n <= 50 then '11-50' when n <= 100 then '51-100' else '>100' end as bucket, count(*) as n
    from (select coalesce(len(findings), 0) as n from elflint_reports where status in ('clean', 'dirty')) group by 1""")
def finding_histogram(spark: SparkSession, d: str) -> DataFrame:
    return lint.findings_histogram(table(spark, d, "elflint_reports"))


@query("""select *, findings / greatest(1, clean + dirty) as mean_findings from (select elf_kind, count(*) as runs, count(*) filter (status = 'clean') as clean, count(*) filter (status = 'dirty') as dirty,
    count(*) filter (status in ('failed', 'timeout')) as failed, coalesce(bool_or(status = 'dirty'), false) as any_dirty,
    coalesce(sum(case when status in ('clean', 'dirty') then coalesce(len(findings), 0) end), 0)::bigint as findings from elflint_reports group by elf_kind)""")
def lint_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return lint.outcomes(table(spark, d, "elflint_reports"), ["elf_kind"])


@query("""select return_code, case when contains(e, 'symbol lookup error') then 'symbol lookup error' when contains(e, 'cannot open shared object') then 'cannot open shared object' when contains(e, 'undefined symbol') then 'undefined symbol'
    when contains(e, 'no version information') then 'no version information' when contains(e, 'timeout after') then 'timeout after' else e[1:160] end as signature, count(*) as n
    from (select return_code, coalesce(stderr_first_line, '(none)') as e from elflint_reports where status in ('failed', 'timeout')) group by all""")
def lint_failures(spark: SparkSession, d: str) -> DataFrame:
    return lint.failures(table(spark, d, "elflint_reports"))


# ---- kinds and categories -----------------------------------------------------------------

_ELF = f"""with elf as (select *, coalesce(header.elf_type in (2, 3) and coalesce(len(list_filter(program_headers, lambda p: p.p_type = 1)), 0) = 0, false) or coalesce(len(list_filter(program_headers, lambda p: p.p_type = 1 and p.filesz > p.memsz)), 0) > 0 as malformed,
    {_PATH.format('source.relative')} as rel, {_PATH.format('source.relative')} like '%/usr/lib/debug/%' or regexp_matches({_PATH.format('source.relative')}, '\\.(debug|dbg)$') as debug from elf_reports),
    cat as (select *, case when debug then 'debuginfo' when kind = 'relocatable' then 'relocatable' when kind in ('core', 'other', 'wrong_format') or header.machine_name is null then 'other'
        when header.machine_name <> 'EM_X86_64' then 'cross_arch' else 'loadable' end as category from elf)"""


def _elf(spark: SparkSession, d: str) -> DataFrame:
    elf = table(spark, d, "elf_reports")
    return elf.withColumn("category", rules.category(clean_path(F.col("source.relative")), F.col("kind"), F.col("header.machine_name")))


@query(_ELF + """ select kind as stated, case when header is null then 'wrong_format' when header.machine <> 62 then 'wrong_machine' when header.elf_type = 1 then 'relocatable' when header.elf_type = 4 then 'core'
    when malformed then 'malformed_image' when header.elf_type not in (2, 3) then 'other'
    when role_evidence.has_pt_interp and role_evidence.has_pt_dynamic then 'dynamic_program'
    when role_evidence.entry_in_executable_load and (header.elf_type = 2 or role_evidence.df_1_pie or not role_evidence.has_soname) then 'static_program'
    when header.elf_type = 3 and role_evidence.has_pt_dynamic then 'dso' else 'load_image' end as computed, count(*) as n from elf group by all""")
def kind_check(spark: SparkSession, d: str) -> DataFrame:
    """The kind that the structure gives against the one that the report states."""
    computed = rules.kind(malformed=rules.malformed())
    return _elf(spark, d).groupBy(F.col("kind").alias("stated"), computed.alias("computed")).agg(F.count("*").alias("n"))


@query(_ELF + " select coalesce(category, 'all') as category, kind, count(*) as n from cat group by grouping sets ((category, kind), (kind))")
def category_kinds(spark: SparkSession, d: str) -> DataFrame:
    return metrics.with_total(_elf(spark, d), "category", ["kind"], F.count("*").alias("n"))


@query(_ELF + """, tall as (select category, unnest([{'metric': 'class', 'key': format.class_name}, {'metric': 'encoding', 'key': format.data_name}, {'metric': 'machine', 'key': header.machine_name},
        {'metric': 'type', 'key': header.elf_type_name}, {'metric': 'segments', 'key': len(program_headers)::varchar}, {'metric': 'interpreter', 'key': interpreter}], recursive := true) from cat)
    select coalesce(category, 'all') as category, metric, key, count(*) as n from tall where key is not null group by grouping sets ((category, metric, key), (metric, key))""")
def header_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Many counters per category and in total, in one aggregate over tall rows."""
    one = lambda c: F.array_compact(F.array(c.cast("string")))
    counters = {
        "class": one(F.col("format.class_name")), "encoding": one(F.col("format.data_name")), "machine": one(F.col("header.machine_name")),
        "type": one(F.col("header.elf_type_name")), "segments": one(F.size("program_headers")), "interpreter": one(F.col("interpreter")),
    }
    return metrics.with_total(metrics.tall(_elf(spark, d), ["category"], counters), "category", ["metric", "key"], F.count("*").alias("n"))


@query("""select header.machine_name as machine, header.elf_type_name as type, count(*) as n, sum(source.size)::bigint as bytes from elf_reports group by all""")
def machine_types(spark: SparkSession, d: str) -> DataFrame:
    elf = table(spark, d, "elf_reports")
    return elf.groupBy(F.col("header.machine_name").alias("machine"), F.col("header.elf_type_name").alias("type")).agg(
        F.count("*").alias("n"), F.sum("source.size").alias("bytes")
    )


@query(_ELF + """ select metric, n from (select count(*) filter (header is not null) as with_header, count(*) filter (interpreter is not null) as with_interpreter,
    count(*) filter (len(list_filter(program_headers, lambda p: p.p_type = 7)) > 0) as with_tls, count(*) filter (len(list_filter(program_headers, lambda p: p.p_type = 1685382481 and p.flags & 1 <> 0)) > 0) as with_executable_stack,
    count(*) filter (role_evidence.df_1_pie) as pie, count(*) filter (len(issues) > 0) as with_issues from elf) unpivot (n for metric in (with_header, with_interpreter, with_tls, with_executable_stack, pie, with_issues))""")
def presence_counts(spark: SparkSession, d: str) -> DataFrame:
    has = lambda f: F.exists("program_headers", f)
    return metrics.presence(table(spark, d, "elf_reports"), {
        "with_header": F.col("header").isNotNull(), "with_interpreter": F.col("interpreter").isNotNull(), "with_tls": has(lambda p: p["p_type"] == 7),
        "with_executable_stack": has(lambda p: (p["p_type"] == 0x6474E551) & (p["flags"].bitwiseAND(F.lit(1)) != 0)),
        "pie": F.col("role_evidence.df_1_pie"), "with_issues": F.size("issues") > 0,
    })


@query(f"""select style, count(*) as n from (select case when interpreter is not null then 'interpreted' when elf_kind = 'static_program' and len({_KEYS.format('needed')}) = 0 then 'static'
    when len({_KEYS.format('needed')}) = 0 then 'alone' else 'linked' end as style from program_reports) group by style""")
def linking_styles(spark: SparkSession, d: str) -> DataFrame:
    """Exclusive classes: the first that fits."""
    none = F.size(keys_of(F.col("needed"))) == 0
    style = F.when(F.col("interpreter").isNotNull(), "interpreted").when((F.col("elf_kind") == "static_program") & none, "static").when(none, "alone").otherwise("linked")
    return table(spark, d, "program_reports").groupBy(style.alias("style")).agg(F.count("*").alias("n"))


# ---- segments -----------------------------------------------------------------------------

_SEGMENTS = "with seg as (select report_id, unnest(program_headers, recursive := true) from (select report_id, program_headers from elf_reports))"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elf_reports").select("report_id", F.inline("program_headers"))


@query(_SEGMENTS + f" select {_TERM.format('p_type_name')} as name, count(*) as occurrences, count(distinct report_id) as files from seg group by 1")
def segment_types(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and files: two map-side combined steps in place of a distinct count."""
    per_file = _segments(spark, d).groupBy(term(F.col("p_type_name")).alias("name"), "report_id").agg(F.count("*").alias("n"))
    return per_file.groupBy("name").agg(F.sum("n").alias("occurrences"), F.count("*").alias("files"))


@query(_SEGMENTS + """, perms as (select coalesce(nullif((case when flags & 4 <> 0 then 'R' else '' end) || (case when flags & 2 <> 0 then 'W' else '' end) || (case when flags & 1 <> 0 then 'X' else '' end), ''), '(none)') as permission from seg where p_type = 1)
    select permission, count(*) as n, count(*) * 100.0::double / (select count(*) from perms) as share from perms group by permission""")
def load_permissions(spark: SparkSession, d: str) -> DataFrame:
    loads = _segments(spark, d).where("p_type = 1").groupBy(S.permission(F.col("flags")).alias("permission")).agg(F.count("*").alias("n"))
    return metrics.shares(loads)


@query(_SEGMENTS + """ select list_filter([case when flags & 4 <> 0 then 'PF_R' end, case when flags & 2 <> 0 then 'PF_W' end, case when flags & 1 <> 0 then 'PF_X' end], lambda x: x is not null) = flags_names as agree, count(*) as n from seg group by 1""")
def flag_name_check(spark: SparkSession, d: str) -> DataFrame:
    """Names of set bits as computed against those that the reports list."""
    return _segments(spark, d).groupBy((S.flag_names(F.col("flags")) == F.col("flags_names")).alias("agree")).agg(F.count("*").alias("n"))


@query(_SEGMENTS + """, cut as (select report_id, max(case when memsz > 0 then greatest(0.0::double, (memsz - filesz) / memsz) end) as s from seg where p_type = 1 group by 1)
    select case when s <= 0.1 then '<=0.1' when s <= 0.5 then '0.1-0.5' when s <= 0.9 then '0.5-0.9' else '>0.9' end as bucket, count(*) as n from cut where s is not null group by 1""")
def bss_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Files by the largest zero-filled share of a loadable segment; no join and no explode."""
    loads = F.filter("program_headers", lambda p: p["p_type"] == 1)
    most = F.array_max(F.transform(loads, lambda p: S.zero_filled_share(p["filesz"], p["memsz"])))
    files = table(spark, d, "elf_reports").select(most.alias("s")).where("s is not null")
    return files.groupBy(S.bucket(F.col("s"), S.BSS_CUTS, ">0.9").alias("bucket")).agg(F.count("*").alias("n"))


@query("select len(program_headers) as segments, count(*) as n from elf_reports where program_headers is not null group by 1")
def segment_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elf_reports").where("program_headers is not null").groupBy(F.size("program_headers").alias("segments")).agg(F.count("*").alias("n"))


@query("select report_id, source.relative as relative, len(program_headers) as segments from elf_reports where program_headers is not null order by 3 desc, 2, 1 limit 100")
def most_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "elf_reports").where("program_headers is not null")
    rows = rows.select("report_id", F.col("source.relative").alias("relative"), F.size("program_headers").alias("segments"))
    return sampling.top(rows, [F.desc("segments"), F.col("relative"), F.col("report_id")], 100)


@query(_SEGMENTS + """, marked as (select report_id, p_type = 1 and vaddr <= last_value(case when p_type = 1 then vaddr end ignore nulls) over w as unsorted,
        p_type = 3 and coalesce(bool_or(p_type = 1) over w, false) as late from seg window w as (partition by report_id order by index rows between unbounded preceding and 1 preceding))
    select load_not_sorted, interp_after_load, count(*) as n from (select report_id, coalesce(bool_or(unsorted), false) as load_not_sorted, coalesce(bool_or(late), false) as interp_after_load from marked group by 1) group by 1, 2""")
def segment_order(spark: SparkSession, d: str) -> DataFrame:
    return rules.segment_order(table(spark, d, "elf_reports"), "report_id").groupBy("load_not_sorted", "interp_after_load").agg(F.count("*").alias("n"))


@query(_SEGMENTS + """, cut as (select *, coalesce("offset" <> lag("offset" + filesz) over (partition by report_id order by index), true) as opens from seg),
    runs as (select *, sum(opens::int) over (partition by report_id order by index rows unbounded preceding) as island from cut)
    select n_segments, count(*) as n, sum(bytes)::bigint as bytes from (select report_id, island, count(*) as n_segments, sum(filesz) as bytes from runs group by 1, 2) group by 1""")
def segment_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of segments that follow each other without a gap in the file, by length."""
    before = F.lag(F.col("offset") + F.col("filesz")).over(Window.partitionBy("report_id").orderBy("index"))
    runs = ranges.islands(_segments(spark, d), ["report_id"], ["index"], F.col("offset") != before, F.count("*").alias("n_segments"), F.sum("filesz").alias("bytes"))
    return runs.groupBy("n_segments").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query(_SEGMENTS + """, mids as (select report_id, vaddr + memsz // 2 as addr from seg where memsz > 0)
    select p_type as held_by, count(*) as n, count(distinct mids.report_id) as files from mids join seg on seg.report_id = mids.report_id and vaddr <= addr and addr < vaddr + memsz where p_type = 1 group by 1""")
def address_owners(spark: SparkSession, d: str) -> DataFrame:
    """Which loadable segments of its file hold the middle of each segment: a range join on page cells."""
    segments = _segments(spark, d)
    points = segments.where("memsz > 0").select("report_id", (F.col("vaddr") + F.expr("memsz div 2")).alias("addr"))
    loads = segments.where("p_type = 1").select("report_id", F.col("p_type").alias("held_by"), F.col("vaddr").alias("lo"), (F.col("vaddr") + F.col("memsz")).alias("hi"))
    held = ranges.range_lookup(points, loads, ["report_id"], "addr", "lo", "hi", 1 << 14)
    return held.groupBy("held_by", "report_id").agg(F.count("*").alias("n")).groupBy("held_by").agg(F.sum("n").alias("n"), F.count("*").alias("files"))


@query("select bit, count(*) as n from (select unnest(list_filter(range(64), lambda i: (entry >> i) & 1 = 1)) as bit from program_reports where entry is not null) group by 1")
def entry_bits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "program_reports").where("entry is not null")
    bits = rows.select(F.explode(ranges.set_bits(F.col("entry"))).alias("bit")).groupBy("bit").agg(F.count("*").alias("n"))
    return bits.select(F.col("bit").cast("bigint").alias("bit"), "n")


# ---- anomalies ----------------------------------------------------------------------------

_BAD = """, p as (select report_id, category, rel, header as h, program_headers as ph, format as f from cat),
    hits as (select report_id, category, rel, unnest([
        {'anomaly': 'ehdr_ehsize_nonstandard', 'hits': (case f.class when 2 then h.ehsize not in (0, 64) when 1 then h.ehsize not in (0, 52) end)::int},
        {'anomaly': 'ehdr_phentsize_nonstandard', 'hits': (case f.class when 2 then h.phentsize not in (0, 56) when 1 then h.phentsize not in (0, 32) end)::int},
        {'anomaly': 'ehdr_shentsize_nonstandard', 'hits': (case f.class when 2 then h.shentsize not in (0, 64) when 1 then h.shentsize not in (0, 40) end)::int}, {'anomaly': 'ehdr_ident_version', 'hits': (f.ident_version <> 1)::int},
        {'anomaly': 'ehdr_object_version', 'hits': (h.version <> 1)::int}, {'anomaly': 'ehdr_unknown_etype', 'hits': (h.elf_type between 5 and 65023)::int},
        {'anomaly': 'ehdr_phoff_zero_phnum_nonzero', 'hits': (h.phoff = 0 and h.phnum <> 0)::int}, {'anomaly': 'ehdr_phoff_nonzero_phnum_zero', 'hits': (h.phoff <> 0 and h.phnum = 0)::int},
        {'anomaly': 'ehdr_exec_no_phdr', 'hits': (h.phoff = 0 and h.elf_type in (2, 3))::int}, {'anomaly': 'ehdr_shoff_zero_shnum_nonzero', 'hits': (h.shoff = 0 and h.shnum <> 0)::int},
        {'anomaly': 'arch_mismatch', 'hits': (trim(h.machine_name) not in ('', 'EM_X86_64') and not regexp_matches(lower(trim(h.machine_name)), '^(unknown|0x)'))::int},
        {'anomaly': 'ehdr_unknown_machine', 'hits': (h is not null and regexp_matches(lower(coalesce(trim(h.machine_name), '')), '^(unknown|0x|$)'))::int},
        {'anomaly': 'ph_unknown_type', 'hits': len(list_filter(ph, lambda x: coalesce(regexp_matches(TERM, '^([uU][nN][kK][nN][oO][wW][nN]|0[xX]|PT_LO|PT_HI)') and TERM <> 'PT_LOAD' and not regexp_matches(TERM, '^PT_(LOOS|HIOS|LOPROC|HIPROC|ARM|MIPS|RISCV|AARCH64|HP|IA_64|S390)'), false)))},
        {'anomaly': 'ph_load_not_sorted', 'hits': (len(list_filter(list_sort(list_transform(list_filter(ph, lambda x: x.p_type = 1), lambda x: x.index)), lambda i: len(list_filter(ph, lambda y: y.p_type = 1 and y.index < i
            and y.index = list_max(list_transform(list_filter(ph, lambda z: z.p_type = 1 and z.index < i), lambda z: z.index)) and y.vaddr >= list_filter(ph, lambda z: z.index = i)[1].vaddr)) > 0)) > 0)::int},
        {'anomaly': 'ph_interp_after_load', 'hits': (list_max(list_transform(list_filter(ph, lambda x: x.p_type = 3), lambda x: x.index)) > list_min(list_transform(list_filter(ph, lambda x: x.p_type = 1), lambda x: x.index)))::int},
        {'anomaly': 'ph_load_wx', 'hits': len(list_filter(ph, lambda x: x.p_type = 1 and x.flags & 2 <> 0 and x.flags & 1 <> 0))},
        {'anomaly': 'ph_load_filesz_gt_memsz', 'hits': len(list_filter(ph, lambda x: x.p_type = 1 and x.filesz > x.memsz))},
        {'anomaly': 'ph_exec_stack', 'hits': len(list_filter(ph, lambda x: x.p_type = 1685382481 and x.flags & 1 <> 0))},
        {'anomaly': 'ph_eh_frame_writable', 'hits': len(list_filter(ph, lambda x: x.p_type = 1685382480 and x.flags & 2 <> 0))},
        {'anomaly': 'ph_eh_frame_executable', 'hits': len(list_filter(ph, lambda x: x.p_type = 1685382480 and x.flags & 1 <> 0))},
        {'anomaly': 'ph_eh_frame_not_readable', 'hits': len(list_filter(ph, lambda x: x.p_type = 1685382480 and x.flags & 4 = 0))},
        {'anomaly': 'ph_align_not_pow2', 'hits': len(list_filter(ph, lambda x: x.align > 1 and x.align & (x.align - 1) <> 0))},
        {'anomaly': 'ph_offset_vaddr_misaligned', 'hits': len(list_filter(ph, lambda x: x.align > 1 and x.align & (x.align - 1) = 0 and (x.vaddr - x."offset") % x.align <> 0))},
        {'anomaly': 'ph_filesz_gt_memsz', 'hits': len(list_filter(ph, lambda x: x.p_type not in (1, 4) and x.memsz <> 0 and x.filesz > x.memsz))},
        {'anomaly': 'ph_phdr_offset_mismatch', 'hits': (h.phoff <> 0 and list_filter(ph, lambda x: x.p_type = 6)[-1]."offset" <> h.phoff)::int},
        {'anomaly': 'ph_phdr_not_in_load', 'hits': (len(list_filter(ph, lambda x: x.p_type = 6)) > 0 and len(list_filter(ph, lambda x: x.p_type = 1)) > 0
            and len(list_filter(ph, lambda a: a.p_type = 6 and len(list_filter(ph, lambda l: l.p_type = 1 and l.vaddr <= a.vaddr and a.vaddr + a.memsz <= l.vaddr + l.memsz)) > 0)) = 0)::int},
        {'anomaly': 'ph_multiple_pt_phdr', 'hits': (len(list_filter(ph, lambda x: x.p_type = 6)) > 1)::int}, {'anomaly': 'ph_multiple_pt_interp', 'hits': (len(list_filter(ph, lambda x: x.p_type = 3)) > 1)::int},
        {'anomaly': 'ph_multiple_pt_dynamic', 'hits': (len(list_filter(ph, lambda x: x.p_type = 2)) > 1)::int}, {'anomaly': 'ph_multiple_pt_tls', 'hits': (len(list_filter(ph, lambda x: x.p_type = 7)) > 1)::int},
        {'anomaly': 'ph_multiple_pt_gnu_relro', 'hits': (len(list_filter(ph, lambda x: x.p_type = 1685382482)) > 1)::int}], recursive := true) from p),
    bad as (select * from hits where hits > 0)""".replace("TERM", _TERM.format("x.p_type_name"))


def _anomalies(spark: SparkSession, d: str) -> DataFrame:
    elf = _elf(spark, d).withColumn("rel", clean_path(F.col("source.relative")))
    return rules.anomalies(elf, rules.header_rules() + rules.segment_rules(), ["report_id", "category", "rel"])


@query(_ELF + _BAD + " select coalesce(category, 'all') as category, anomaly, count(*) as files, sum(hits)::bigint as hits from bad group by grouping sets ((category, anomaly), (anomaly))")
def anomaly_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.with_total(_anomalies(spark, d), "category", ["anomaly"], F.count("*").alias("files"), F.sum("hits").alias("hits"))


@query(_ELF + _BAD + """ select anomaly, coalesce(sum(hits) filter (category = 'loadable'), 0)::bigint as loadable, coalesce(sum(hits) filter (category = 'debuginfo'), 0)::bigint as debuginfo,
    coalesce(sum(hits) filter (category = 'relocatable'), 0)::bigint as relocatable, coalesce(sum(hits) filter (category = 'cross_arch'), 0)::bigint as cross_arch, coalesce(sum(hits) filter (category = 'other'), 0)::bigint as other from bad group by 1""")
def anomaly_matrix(spark: SparkSession, d: str) -> DataFrame:
    wide = _anomalies(spark, d).groupBy("anomaly").pivot("category", ["loadable", "debuginfo", "relocatable", "cross_arch", "other"]).agg(F.sum("hits"))
    return wide.na.fill(0)


@query(_ELF + _BAD + """ select case anomaly when 'ehdr_unknown_machine' then 'unknown_machine' else anomaly end as outlier, category, count(*) as n from bad where anomaly in ('arch_mismatch', 'ehdr_unknown_machine') group by all""")
def outlier_counts(spark: SparkSession, d: str) -> DataFrame:
    """Outliers that file headers show; the others need dynamic sections."""
    return rules.outliers(_anomalies(spark, d)).groupBy("outlier", "category").agg(F.count("*").alias("n"))


@query(_ELF + """ select kind, coalesce(header.machine = 62 and header.elf_type in (2, 3) and len(list_filter(program_headers, lambda p: p.p_type = 1)) > 0 and kind not in ('wrong_format', 'wrong_machine'), false) as candidate,
    kind in ('dynamic_program', 'static_program') as program, count(*) as n from elf group by all""")
def load_candidates(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("kind")
    return _elf(spark, d).groupBy("kind", rules.is_load_candidate(kind).alias("candidate"), rules.is_program(kind).alias("program")).agg(F.count("*").alias("n"))


@query(_SEGMENTS.replace("select report_id, program_headers", "select report_id, header.machine_name as machine, program_headers").replace("unnest(program_headers", "machine, unnest(program_headers")
    + f" select machine, {_TERM.format('p_type_name')} as name, count(*) as n from seg group by all")
def segment_types_by_machine(spark: SparkSession, d: str) -> DataFrame:
    """A counter within a counter: types per machine."""
    rows = table(spark, d, "elf_reports").select(F.col("header.machine_name").alias("machine"), F.inline("program_headers"))
    return rows.groupBy("machine", term(F.col("p_type_name")).alias("name")).agg(F.count("*").alias("n"))


@query(_ELF + _BAD + " select anomaly, report_id, rel from (select *, row_number() over (partition by anomaly order by md5(anomaly || '|' || rel || '|' || report_id), report_id) as r from bad) where r <= 200")
def anomaly_samples(spark: SparkSession, d: str) -> DataFrame:
    found = _anomalies(spark, d)
    return sampling.smallest_per_group(found, ["anomaly"], S.md5_draw(F.col("anomaly"), F.col("rel"), F.col("report_id").cast("string")), ["report_id"], 200).select("anomaly", "report_id", "rel")


# ---- libraries ----------------------------------------------------------------------------

_USES = f"""with lib as (select {_PATH.format('source.relative')} as path, {_KEY.format('soname')} as soname, {_KEYS.format('needed')} as needed from program_reports
        union all select path, {_KEY.format('soname')}, {_KEYS.format('needed')} from graph_record),
    uses as (select path, unnest(needed) as soname from lib), edges as (select distinct lib.soname as src, u.k as dst from lib, unnest(needed) as u(k) where lib.soname is not null)"""


def _libraries(spark: SparkSession, d: str) -> DataFrame:
    """(path, soname, needed) of the reports and of the base libraries."""
    own = table(spark, d, "program_reports").select(clean_path(F.col("source.relative")).alias("path"), "soname", "needed")
    base = table(spark, d, "graph_record").select("path", "soname", "needed")
    return own.unionByName(base).select("path", library_key(F.col("soname")).alias("soname"), keys_of(F.col("needed")).alias("needed"))


def _uses(spark: SparkSession, d: str) -> DataFrame:
    return _libraries(spark, d).select("path", F.explode("needed").alias("soname"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    rows = _libraries(spark, d).where("soname is not null")
    return rows.select(F.col("soname").alias("src"), F.explode("needed").alias("dst")).distinct()


@query(_USES + " select soname, count(*) as entries, count(distinct path) as files from uses group by 1")
def library_uses(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_degree(_uses(spark, d))


@query(_USES + """, counted as (select soname, count(*) as n from uses group by 1), top as (select * from counted order by n desc, soname limit 30)
    select * from top union all select '(other)', (select sum(n) from counted)::bigint - (select sum(n) from top)::bigint as n where (select sum(n) from counted) > (select sum(n) from top)""")
def top_libraries(spark: SparkSession, d: str) -> DataFrame:
    return metrics.top_and_rest(_uses(spark, d).groupBy("soname").agg(F.count("*").alias("n")), "soname", "n", 30)


@query(_USES + " select len(needed) as n_needed, count(*) as n from lib group by 1")
def needed_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _libraries(spark, d).groupBy(F.size("needed").alias("n_needed")).agg(F.count("*").alias("n"))


@query(_USES + " select soname, min(path) as provider from lib where soname is not null group by 1")
def first_provider(spark: SparkSession, d: str) -> DataFrame:
    return graph.first_provider(_libraries(spark, d))


@query(_USES + " select soname, count(distinct path) as n_paths, list_sort(list(distinct path))[1:25] as paths from lib where soname is not null group by 1 having count(distinct path) > 1")
def provider_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return graph.conflicts(_libraries(spark, d))


@query(_USES + " select soname, count(*) as n_uses from uses where soname not in (select soname from lib where soname is not null) group by 1")
def external_libraries(spark: SparkSession, d: str) -> DataFrame:
    return graph.external(_uses(spark, d), _libraries(spark, d))


@query(_USES + " select path, soname, count(*) as times from uses group by all having count(*) > 1")
def repeated_needed(spark: SparkSession, d: str) -> DataFrame:
    return graph.repeated_entries(_uses(spark, d))


_STEM = "regexp_extract({0}, '^(.*\\.so)\\.([0-9.]+)$', {1})"


@query(_USES + f""", declared as (select distinct {_STEM.format('soname', 1)} as soname, {_STEM.format('soname', 2)} as verset from lib where {_STEM.format('soname', 1)} <> ''),
    asked as (select {_STEM.format('soname', 1)} as soname, {_STEM.format('soname', 2)} as verset, count(distinct path) as n_files from uses where {_STEM.format('soname', 1)} <> '' group by 1, 2)
    select * from asked where soname in (select soname from declared) and (soname, verset) not in (select soname, verset from declared)""")
def version_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Versions of a library that are needed while only others are provided."""
    pattern = r"^(.*\.so)\.([0-9.]+)$"
    split = lambda df: df.where(F.col("soname").rlike(pattern)).withColumn("verset", F.regexp_extract("soname", pattern, 2)).withColumn("soname", F.regexp_extract("soname", pattern, 1))
    return graph.version_mismatches(split(_uses(spark, d)), split(_libraries(spark, d)).select("soname", "verset"))


@query("""with asked as (select path, u.r.key as s, unnest(u.r.value) as v from graph_record, unnest(map_entries(verneed)) as u(r)),
    required as (select path, nullif(regexp_extract(trim(s, E' \\t\\r\\n'), '[^/]*$'), '') as soname, v as verset from asked where v is not null),
    declared as (select distinct nullif(regexp_extract(trim(soname, E' \\t\\r\\n'), '[^/]*$'), '') as soname, unnest(verdef) as verset from graph_record)
    select soname, verset, count(distinct path) as n_files from required where soname in (select soname from declared where verset is not null and soname is not null)
    and not exists (select 1 from declared where declared.soname = required.soname and declared.verset = required.verset) group by all""")
def verset_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Version sets that a base library requests of a soname whose providers declare others only; reports have no version sets."""
    rows = table(spark, d, "graph_record")
    asked = rows.select("path", F.explode("verneed").alias("soname", "versets")).select("path", library_key(F.col("soname")).alias("soname"), F.explode("versets").alias("verset"))
    declared = rows.select(library_key(F.col("soname")).alias("soname"), F.explode("verdef").alias("verset"))
    return graph.version_mismatches(asked.where("verset is not null"), declared)


@query("""with asked as (select u.r.key as s, unnest(u.r.value) as v from graph_record, unnest(map_entries(verneed)) as u(r)),
    cut as (select distinct nullif(regexp_extract(trim(s, E' \\t\\r\\n'), '[^/]*$'), '') as soname, v[1:instr(v, '_') - 1] as verset, v[instr(v, '_') + 1:] as version from asked where instr(v, '_') > 0)
    select soname, verset, arg_max(version, list_transform(string_split(version, '.'), lambda x: x::bigint)) as version from cut where regexp_matches(version, '^[0-9]+(\\.[0-9]+)*$') group by all""")
def greatest_versets(spark: SparkSession, d: str) -> DataFrame:
    """The greatest version that is requested of each library and version set."""
    rows = table(spark, d, "graph_record").select(F.explode("verneed").alias("soname", "versets")).select(library_key(F.col("soname")).alias("soname"), F.explode("versets").alias("v"))
    return metrics.greatest_version(rows.select("soname", *S.split_version(F.col("v"))), ["soname", "verset"], "version", S.version_numbers(F.col("version")))


@query(_USES + f""", v as (select distinct {_STEM.format('soname', 1)} as stem, {_STEM.format('soname', 2)} as version from lib where regexp_matches({_STEM.format('soname', 2)}, '^[0-9]+(\\.[0-9]+)*$'))
    select stem, arg_max(version, list_transform(string_split(version, '.'), lambda x: x::bigint)) as version from v group by 1""")
def greatest_versions(spark: SparkSession, d: str) -> DataFrame:
    pattern = r"^(.*\.so)\.([0-9.]+)$"
    rows = _libraries(spark, d).select(F.regexp_extract("soname", pattern, 1).alias("stem"), F.regexp_extract("soname", pattern, 2).alias("version"))
    return metrics.greatest_version(rows, ["stem"], "version", S.version_numbers(F.col("version")))


_REACH = _USES.replace("with lib", "with recursive lib") + """, reach as (select src as root, dst as node from edges union select r.root, e.dst from reach r join edges e on e.src = r.node)"""


@query(_REACH + """, depth as (select root, count(*) as nodes, count(*) filter (node not in (select soname from lib where soname is not null)) as external from reach group by 1)
    select * from depth""")
def soname_closures(spark: SparkSession, d: str) -> DataFrame:
    """Sonames that each soname needs, directly or not, and those of them that nothing provides; files of one soname are one node."""
    reach = graph.closure(_edges(spark, d))
    known = _libraries(spark, d).where("soname is not null").select(F.col("soname").alias("node"), F.lit(1).alias("own")).distinct()
    return reach.join(known, "node", "left").groupBy("root").agg(F.count("*").alias("nodes"), F.count_if(F.col("own").isNull()).alias("external"))


@query(_REACH + " select a.root as node, min(a.node) as component from reach a join reach b on a.root = b.node and a.node = b.root group by 1")
def library_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Sonames on cycles: what can't be on one is trimmed, so that only the rest is closed over."""
    return graph.cycles(graph.closure(graph.trimmed(_edges(spark, d))))


@query(_REACH + """, nodes as (select root, node from reach union select root, root from reach)
    select root, count(*) filter (nodes.node <> root) as nodes, coalesce(sum(d), 0)::bigint as edges, coalesce(sum(d), 0)::bigint - count(*) filter (nodes.node <> root) as extra
    from nodes left join (select src, count(*) as d from edges group by 1) o on o.src = nodes.node group by root""")
def soname_diamonds(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return graph.diamonds(graph.closure(edges), edges)


#: Files with their entries, resolved to the first provider; what each reaches; the measures of each.
_FILES = _USES.replace("with lib", "with recursive lib") + """, listed as (select path, r, unnest(needed) as soname from (select path, needed, row_number() over () as r from lib)),
    entries as (select path as src, soname, max(n) as times from (select path, r, soname, count(*) as n from listed group by all) group by all),
    first as (select soname, min(path) as dst from lib where soname is not null group by 1),
    e as (select src, coalesce(dst, '?' || entries.soname) as dst, dst is not null as known, times from entries left join first using (soname)),
    walk as (select src, dst from e union select walk.src, e.dst from walk join e on e.src = walk.dst),
    outs as (select src, coalesce(sum(times) filter (known), 0)::bigint as n from e group by 1),
    sums as (select walk.src, count(*) filter (walk.dst not like '?%') as nodes, count(*) filter (walk.dst like '?%') as external, coalesce(sum(n), 0)::bigint as below
        from walk left join outs on outs.src = walk.dst where walk.src <> walk.dst group by 1),
    sizes as (select outs.src as path, coalesce(nodes, 0)::bigint as nodes, coalesce(external, 0)::bigint as external, n + coalesce(below, 0)::bigint as edges, n + coalesce(below, 0)::bigint - coalesce(nodes, 0)::bigint as extra
        from outs left join sums on sums.src = outs.src)"""


def _closures(spark: SparkSession, d: str) -> DataFrame:
    return graph.file_closures(graph.file_graph(_libraries(spark, d)))


@query(_FILES + " select path, nodes, external from sizes")
def closure_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Each file that needs anything, programs too: providers that it reaches by the first provider of each soname, and sonames that nothing provides."""
    return _closures(spark, d).select("path", "nodes", "external")


@query(_FILES + """, level(src, dst, d) using key (src, dst) as (select src, dst, 1 from e where known and src <> dst
        union select l.src, e.dst, min(l.d) + 1 from level l join e on e.src = l.dst and known and e.dst <> l.src where not exists (select 1 from recurring.level x where x.src = l.src and x.dst = e.dst) group by 1, 2)
    select outs.src as path, coalesce(max(d), 0)::bigint as depth from outs left join level on level.src = outs.src group by 1""")
def closure_depths(spark: SparkSession, d: str) -> DataFrame:
    """Steps from each file to the farthest provider that it reaches."""
    return _closures(spark, d).select("path", "depth")


@query(_FILES + " select path, nodes, edges, extra from sizes where nodes > 0")
def closure_diamonds(spark: SparkSession, d: str) -> DataFrame:
    return _closures(spark, d).where("nodes > 0").select("path", "nodes", "edges", "extra")


@query(_FILES + """ select case when extra <= 0 then 'tree' when extra <= 1 then '1' when extra <= 2 then '2' when extra <= 5 then '3-5' when extra <= 10 then '6-10' when extra <= 20 then '11-20' when extra <= 50 then '21-50'
    when extra <= 100 then '51-100' when extra <= 200 then '101-200' when extra <= 500 then '201-500' when extra <= 1000 then '501-1000' when extra <= 10000 then '1001-10000' else '>10000' end as bucket, count(*) as files,
    sum(greatest(extra, 0))::bigint as extra from sizes where nodes > 0 group by 1""")
def diamond_histogram(spark: SparkSession, d: str) -> DataFrame:
    return graph.diamond_totals(_closures(spark, d))


@query(_FILES + " select nodes as size, count(*) as files from sizes group by 1")
def closure_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _closures(spark, d).groupBy(F.col("nodes").alias("size")).agg(F.count("*").alias("files"))


@query(_FILES + """ select case when nodes <= 0 then '0' when nodes <= 1 then '1' when nodes <= 5 then '2-5' when nodes <= 10 then '6-10' when nodes <= 20 then '11-20' when nodes <= 50 then '21-50' when nodes <= 100 then '51-100'
    when nodes <= 200 then '101-200' else '>200' end as bucket, count(*) as files from sizes group by 1""")
def closure_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _closures(spark, d).groupBy(S.bucket(F.col("nodes"), S.CLOSURE_CUTS, ">200").alias("bucket")).agg(F.count("*").alias("files"))


@query(_FILES + """, spread as (select *, extra / edges as share from sizes where nodes > 0 and extra > 0),
    ranked as (select 'nodes' as ranking, row_number() over (order by nodes desc, path) as place, path, nodes, edges, extra from sizes where nodes > 0
        union all select 'extra', row_number() over (order by extra desc, share desc, path desc), path, nodes, edges, extra from spread
        union all select 'share', row_number() over (order by share desc, extra desc, path), path, nodes, edges, extra from spread where edges >= 50)
    select ranking, place::int as place, path, nodes, edges, extra from ranked where place <= 25""")
def closure_ranks(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure_ranks(materialise(_closures(spark, d), "closures"))


@query(_FILES + """, outdeg as (select path, max(len(needed)) as out_degree from lib where len(needed) > 0 group by 1) select path, out_degree::int as out_degree from outdeg order by 2 desc, 1 limit 50""")
def out_degrees(spark: SparkSession, d: str) -> DataFrame:
    """The 50 files with the longest lists."""
    sizes = _libraries(spark, d).groupBy("path").agg(F.max(F.size("needed")).alias("out_degree")).where("out_degree > 0")
    return sampling.top(sizes, [F.desc("out_degree"), F.col("path")], 50)


def _shadow(symbol: str) -> str:
    return _FILES + f""", ex as (select path as dst, {symbol} as symbol from (select path, soname, unnest(exports) as x from graph_record) where nullif(regexp_extract(trim(soname, E' \\t\\r\\n'), '[^/]*$'), '') is not null),
    near as (select w.src, w.dst, e.src is not null as direct from walk w left join e on e.src = w.src and e.dst = w.dst where w.src <> w.dst and w.dst not like '?%'),
    shadow as (select src as path, symbol, count(*) filter (direct) as n_direct, count(*) filter (not direct) as n_indirect from near join (select distinct * from ex where symbol is not null) x using (dst) group by 1, 2
        having count(*) filter (direct) > 0 and count(*) filter (not direct) > 0)"""


def _shadowed(spark: SparkSession, d: str, symbol: Column) -> DataFrame:
    rows = table(spark, d, "graph_record").where(library_key(F.col("soname")).isNotNull()).select("path", F.explode("exports").alias("x"))
    return graph.file_shadowing(graph.file_graph(_libraries(spark, d)), rows.select("path", symbol.alias("symbol")))


@query(_shadow("x") + " select * from shadow")
def shadowed_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that a file gets from a direct provider while a provider that it reaches only indirectly defines them, too."""
    return _shadowed(spark, d, F.col("x"))


def _verb() -> Column:
    return F.nullif(F.regexp_extract("x", "_([^_]+)$", 1), F.lit(""))


_VERB_SQL = "nullif(regexp_extract(x, '_([^_]+)$', 1), '')"


@query(_shadow(_VERB_SQL) + " select * from shadow")
def shadowed_verbs(spark: SparkSession, d: str) -> DataFrame:
    """The same for the last part of the symbols' names, which base libraries do share."""
    return _shadowed(spark, d, _verb())


@query(_shadow(_VERB_SQL) + """ select * from (select 'consumer' as what, path as name, count(*) as n from shadow group by 2 order by 3 desc, 2 desc limit 25)
    union all select * from (select 'symbol', symbol, count(*) from shadow group by 2 order by 3 desc, 2 limit 25)""")
def shadowing_ranks(spark: SparkSession, d: str) -> DataFrame:
    found = materialise(_shadowed(spark, d, _verb()), "shadowed")
    ranked = lambda what, key, tie: sampling.top(found.groupBy(F.col(key).alias("name")).agg(F.count("*").alias("n")), [F.desc("n"), tie], 25).select(F.lit(what).alias("what"), "name", "n")
    return ranked("consumer", "path", F.desc("name")).unionByName(ranked("symbol", "symbol", F.col("name")))


@query("""with paths as (select unnest(coalesce(rpath, [])) as p, 'rpath' as field from program_reports union all select unnest(coalesce(runpath, [])), 'runpath' from program_reports)
    select field, case when p like '%$ORIGIN%' or p like '%${ORIGIN}%' then '$ORIGIN' when p like '/%' then 'absolute' when p like '%/%' then 'relative-multi' when p is not null then 'relative-bare' end as style, count(*) as n from paths group by all""")
def run_path_styles(spark: SparkSession, d: str) -> DataFrame:
    reports = table(spark, d, "program_reports")
    rows = reports.select(F.lit("rpath").alias("field"), F.explode("rpath").alias("p")).unionByName(reports.select(F.lit("runpath").alias("field"), F.explode("runpath").alias("p")))
    return rows.groupBy("field", S.run_path_style(F.col("p")).alias("style")).agg(F.count("*").alias("n"))


# ---- packages and files -------------------------------------------------------------------

_PACKAGE = f"string_split({_PATH.format('source.relative')}, '/')[2]"


@query(f"select {_PACKAGE} as package, count(*) as files, sum(source.size)::bigint as bytes, sum(coalesce(len(needed), 0))::bigint as entries from program_reports group by 1")
def packages(spark: SparkSession, d: str) -> DataFrame:
    size = F.greatest(F.lit(0), F.coalesce(F.size("needed"), F.lit(0)))
    return table(spark, d, "program_reports").groupBy(package_of(F.col("source.relative")).alias("package")).agg(
        F.count("*").alias("files"), F.sum("source.size").alias("bytes"), F.sum(size.cast("bigint")).alias("entries")
    )


@query(f"""with n as (select string_split({_PATH.format('source.relative')}, '/')[1] as repo, {_PACKAGE} as package, count(*) as files from program_reports group by 1, 2)
    select repo, count(*) as n, median(files) as median, list_sort(list(files))[least(count(*) - 1, count(*) * 99 // 100) + 1] as quantile from n group by 1""")
def package_sizes(spark: SparkSession, d: str) -> DataFrame:
    relative = F.col("source.relative")
    per = table(spark, d, "program_reports").groupBy(F.get(F.split(clean_path(relative), "/"), 0).alias("repo"), package_of(relative).alias("package")).agg(F.count("*").alias("files"))
    return metrics.median_and_index(per, ["repo"], "files", 99)


@query("""with f as (select distinct source.path as path, source.package as package from program_reports where source.path is not null and source.package is not null)
    select path, min(package) as owner, count(*) as n_owners from f group by 1""")
def file_owners(spark: SparkSession, d: str) -> DataFrame:
    return graph.file_owners(table(spark, d, "program_reports").select("source.path", "source.package"))


@query(f"""with b as (select {_PATH.format('source.relative')} as path, report_id, {_KEYS.format('needed')} as now, lag({_KEYS.format('needed')}) over (partition by {_PATH.format('source.relative')} order by arrived_at, report_id) as was from program_reports),
    c as (select path, report_id, unnest(range(greatest(len(was), len(now)))) as pos, was, now from b where was is not null)
    select report_id, pos::int as pos, was[pos + 1] as was, now[pos + 1] as now from c where was[pos + 1] is distinct from now[pos + 1]""")
def build_changes(spark: SparkSession, d: str) -> DataFrame:
    """Positions at which ``needed`` differs between one report of a path and the next."""
    rows = table(spark, d, "program_reports").select("report_id", "arrived_at", clean_path(F.col("source.relative")).alias("path"), keys_of(F.col("needed")).alias("now"))
    was = F.lag("now").over(Window.partitionBy("path").orderBy("arrived_at", "report_id"))
    return rows.withColumn("was", was).where("was is not null").select("report_id", F.inline(ranges.positional_changes(F.col("was"), F.col("now"))))


@query(f"""select elf_reports.report_id from elf_reports where kind in ('dynamic_program', 'static_program')
    and ({_PATH.format('source.relative')}, lower(source.sha256)) not in (select {_PATH.format('source.relative')}, lower(source.sha256) from program_reports where schema_version = 1)""")
def pending_programs(spark: SparkSession, d: str) -> DataFrame:
    """Programs without a program report of the current schema version."""
    key = [clean_path(F.col("source.relative")).alias("path"), F.lower("source.sha256").alias("sha")]
    elf = table(spark, d, "elf_reports").where(rules.is_program(F.col("kind"))).select("report_id", *key)
    return incremental.pending(elf, table(spark, d, "program_reports").select("schema_version", *key), ["path", "sha"], 1).select("report_id")


@query("select sha256(text) as digest, count(*) as n from documents where text is not null group by 1")
def distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    return incremental.distinct_contents(table(spark, d, "documents"), "text")


@query(f"select report_id, rel as relative from (select report_id, {_PATH.format('source.relative')} as rel from program_reports) order by md5('42|' || rel || '|' || report_id), report_id limit 100")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "program_reports").select("report_id", clean_path(F.col("source.relative")).alias("relative"))
    return sampling.top(rows, [S.md5_draw(F.lit("42"), F.col("relative"), F.col("report_id").cast("string")), F.col("report_id")], 100)


@query("select event_type, count(*) as n, sum(k)::bigint as total, max(k) as most from (select event_type, (props->>'$.k')::bigint as k from events) group by 1")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))
