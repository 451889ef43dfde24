"""Classification of files and rule-based anomalies, as conditions on nested columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.scalars import MANDATORY_TAGS, REPEATABLE_TAGS, SEGMENT_TYPES, TAG_NEEDS, is_congruent, is_power_of_two, parse_integer
from lodestack.functions.records import term


def kind(header: str = "header", role: str = "role_evidence", malformed: Column | None = None) -> Column:
    """The structural kind of a file from its header and role evidence; ``wrong_format`` without a header."""
    h, r = (lambda x: F.col(f"{header}.{x}")), (lambda x: F.coalesce(F.col(f"{role}.{x}"), F.lit(False)))
    interpreted = r("has_pt_interp") & r("has_pt_dynamic")
    starts = r("entry_in_executable_load")
    bad = F.lit(False) if malformed is None else malformed
    image = F.col(f"{header}.elf_type").isin(2, 3)
    return (
        F.when(F.col(header).isNull(), "wrong_format")
        .when(h("machine") != 62, "wrong_machine")
        .when(h("elf_type") == 1, "relocatable")
        .when(h("elf_type") == 4, "core")
        .when(bad, "malformed_image")
        .when(~image, "other")
        .when(interpreted, "dynamic_program")
        .when(starts & ((h("elf_type") == 2) | r("df_1_pie") | ~r("has_soname")), "static_program")
        .when((h("elf_type") == 3) & r("has_pt_dynamic"), "dso")
        .otherwise("load_image")
    )


def malformed(header: str = "header", headers: str = "program_headers", bad_table: Column | None = None) -> Column:
    """A bad segment table, a loadable segment that is larger in the file than in memory, or an executable or shared object without any.

    Other issues, such as an interpreter outside the file, don't make an image malformed.
    """
    loads = F.filter(headers, lambda p: p["p_type"] == 1)
    none = F.col(f"{header}.elf_type").isin(2, 3) & (F.coalesce(F.size(loads), F.lit(0)) <= 0)
    bad = F.coalesce(F.exists(loads, lambda p: p["filesz"] > p["memsz"]), F.lit(False)) | F.coalesce(none, F.lit(False))
    return bad if bad_table is None else bad | bad_table


def is_load_candidate(kind_: Column, header: str = "header", headers: str = "program_headers") -> Column:
    """An x86-64 executable or shared object with a loadable segment, and not of a wrong format or machine."""
    image = (F.col(f"{header}.machine") == 62) & F.col(f"{header}.elf_type").isin(2, 3)
    loads = F.exists(headers, lambda p: p["p_type"] == 1)
    return F.coalesce(image & loads & ~kind_.isin("wrong_format", "wrong_machine"), F.lit(False))


def is_program(kind_: Column) -> Column:
    return kind_.isin("dynamic_program", "static_program")


def category(path: Column, kind_: Column, machine: Column) -> Column:
    """The first of: debuginfo, relocatable, other, cross_arch, loadable."""
    debug = path.contains("/usr/lib/debug/") | path.rlike(r"\.(debug|dbg)$")
    return (
        F.when(debug, "debuginfo")
        .when(kind_ == "relocatable", "relocatable")
        .when(kind_.isin("core", "other", "wrong_format") | machine.isNull(), "other")
        .when(machine != "EM_X86_64", "cross_arch")
        .otherwise("loadable")
    )


def entry_in_executable(entry: Column, headers: str = "program_headers") -> Column:
    """The entry address lies in [vaddr, vaddr + memsz) of an executable loadable segment."""
    return F.exists(
        headers, lambda p: (p["p_type"] == 1) & (p["flags"].bitwiseAND(F.lit(1)) != 0) & (p["vaddr"] <= entry) & (entry < p["vaddr"] + p["memsz"])
    )


@dataclass(frozen=True)
class Rule:
    """One anomaly: ``per_file``, a condition on the row; ``element``, on a segment; or ``hits``, their number."""

    name: str
    per_file: Column | None = None
    element: Callable[[Column], Column] | None = None
    hits: Column | None = None


def _off(column: str, size64: int, size32: int) -> Column:
    """A size that is neither 0 nor that of the file's class."""
    return F.when(F.col("format.class") == 2, ~F.col(column).isin(0, size64)).when(F.col("format.class") == 1, ~F.col(column).isin(0, size32))


def _looks_unknown(name: Column) -> Column:
    return F.lower(name).startswith("unknown") | F.lower(name).startswith("0x")


def _count(type_: int) -> Column:
    return F.size(F.filter("program_headers", lambda p: p["p_type"] == type_))


def _flag(p: Column, bit: int) -> Column:
    return p["flags"].bitwiseAND(F.lit(bit)) != 0


def header_rules() -> list[Rule]:
    """Rules on the file header."""
    c = F.col
    machine = F.coalesce(F.btrim("header.machine_name"), F.lit(""))
    return [
        Rule("ehdr_ehsize_nonstandard", _off("header.ehsize", 64, 52)),
        Rule("ehdr_phentsize_nonstandard", _off("header.phentsize", 56, 32)),
        Rule("ehdr_shentsize_nonstandard", _off("header.shentsize", 64, 40)),
        Rule("ehdr_ident_version", c("format.ident_version") != 1),
        Rule("ehdr_object_version", c("header.version") != 1),
        # types of systems and processors, from 0xfe00 on, are known
        Rule("ehdr_unknown_etype", c("header.elf_type").between(5, 0xFDFF)),
        Rule("ehdr_phoff_zero_phnum_nonzero", (c("header.phoff") == 0) & (c("header.phnum") != 0)),
        Rule("ehdr_phoff_nonzero_phnum_zero", (c("header.phoff") != 0) & (c("header.phnum") == 0)),
        Rule("ehdr_exec_no_phdr", (c("header.phoff") == 0) & c("header.elf_type").isin(2, 3)),
        Rule("ehdr_shoff_zero_shnum_nonzero", (c("header.shoff") == 0) & (c("header.shnum") != 0)),
        Rule("ehdr_unknown_machine", c("header").isNotNull() & ((machine == "") | _looks_unknown(machine))),
        Rule("arch_mismatch", (machine != "") & ~_looks_unknown(machine) & (machine != "EM_X86_64")),
    ]


def ident_rules(abi_version: str = "abi_version", padding: str = "padding") -> list[Rule]:
    """Rules on identification bytes that only images show: a number and the array of reserved bytes."""
    return [Rule("ehdr_nonzero_abiversion", F.col(abi_version) != 0), Rule("ehdr_padding_nonzero", F.exists(padding, lambda b: b != 0))]


# Beginnings of the names of segment types that systems and processors define.
RESERVED_TYPES = ("PT_LOOS", "PT_HIOS", "PT_LOPROC", "PT_HIPROC", "PT_ARM", "PT_MIPS", "PT_RISCV", "PT_AARCH64", "PT_HP", "PT_IA_64", "PT_S390")

#: Anomalies that are listed as outliers, too, and under which name.
OUTLIERS = {"dyn_textrel": "text_relocs", "arch_mismatch": "arch_mismatch", "dyn_empty": "empty_dynamic", "ehdr_unknown_machine": "unknown_machine"}


def segment_rules() -> list[Rule]:
    name = lambda p: term(p["p_type_name"])
    reserved = lambda p: reduce(or_, (name(p).startswith(x) for x in RESERVED_TYPES))
    unknown = lambda p: ~reserved(p) & (_looks_unknown(name(p)) | name(p).startswith("PT_LO") | name(p).startswith("PT_HI")) & (name(p) != "PT_LOAD")
    load, note = (lambda p: p["p_type"] == 1), (lambda p: p["p_type"] == 4)
    eh = lambda p: p["p_type"] == 0x6474E550
    phdr_in_load = F.exists("program_headers", lambda a: (a["p_type"] == 6) & F.exists(
        "program_headers", lambda l: (l["p_type"] == 1) & (l["vaddr"] <= a["vaddr"]) & (a["vaddr"] + a["memsz"] <= l["vaddr"] + l["memsz"])))
    ordered = F.array_sort(F.transform("program_headers", lambda p: F.struct(p["index"].alias("index"), p["p_type"].alias("p_type"), p["vaddr"].alias("vaddr"))))
    loads = F.filter(ordered, lambda p: p["p_type"] == 1)
    at = lambda t: F.transform(F.filter("program_headers", lambda p: p["p_type"] == t), lambda p: p["index"])
    return [
        Rule("ph_unknown_type", element=lambda p: F.coalesce(unknown(p), F.lit(False))),
        Rule("ph_load_wx", element=lambda p: load(p) & _flag(p, 2) & _flag(p, 1)),
        Rule("ph_load_filesz_gt_memsz", element=lambda p: load(p) & (p["filesz"] > p["memsz"])),
        Rule("ph_exec_stack", element=lambda p: (p["p_type"] == 0x6474E551) & _flag(p, 1)),
        Rule("ph_eh_frame_writable", element=lambda p: eh(p) & _flag(p, 2)),
        Rule("ph_eh_frame_executable", element=lambda p: eh(p) & _flag(p, 1)),
        Rule("ph_eh_frame_not_readable", element=lambda p: eh(p) & ~_flag(p, 4)),
        Rule("ph_align_not_pow2", element=lambda p: (p["align"] > 1) & ~is_power_of_two(p["align"])),
        Rule("ph_offset_vaddr_misaligned", element=lambda p: ((p["align"] <= 1) | is_power_of_two(p["align"])) & ~is_congruent(p["vaddr"], p["offset"], p["align"])),
        Rule("ph_filesz_gt_memsz", element=lambda p: ~load(p) & ~note(p) & (p["memsz"] != 0) & (p["filesz"] > p["memsz"])),
        Rule("ph_phdr_offset_mismatch", (F.col("header.phoff") != 0) & (F.try_element_at(F.filter("program_headers", lambda p: p["p_type"] == 6), F.lit(-1))["offset"] != F.col("header.phoff"))),
        Rule("ph_phdr_not_in_load", (_count(6) > 0) & (_count(1) > 0) & ~phdr_in_load),
        Rule("ph_load_not_sorted", F.exists(F.zip_with(F.slice(loads, 1, F.greatest(F.size(loads) - 1, F.lit(0))), F.slice(loads, 2, F.greatest(F.size(loads) - 1, F.lit(0))), lambda a, b: b["vaddr"] <= a["vaddr"]), lambda x: x)),
        Rule("ph_interp_after_load", F.array_max(at(3)) > F.array_min(at(1))),
        *[Rule(f"ph_multiple_{SEGMENT_TYPES[t].lower()}", _count(t) > 1) for t in (6, 3, 2, 7, 0x6474E552)],
    ]


def anomalies(reports: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """(*keep, anomaly, hits): one row per file and rule that applies; conditions that are null don't."""
    hits = []
    for rule in rules:
        if rule.hits is not None:
            n = F.coalesce(rule.hits, F.lit(0))
        elif rule.per_file is not None:
            n = F.when(F.coalesce(rule.per_file, F.lit(False)), 1).otherwise(0)
        else:
            n = F.coalesce(F.size(F.filter("program_headers", rule.element)), F.lit(0))
        hits.append(F.struct(F.lit(rule.name).alias("anomaly"), n.alias("hits")))
    found = F.filter(F.array(*hits), lambda x: x["hits"] > 0)
    return reports.select(*keep, F.inline(found))


def segment_order(reports: DataFrame, key: str) -> DataFrame:
    """(key, load_not_sorted, interp_after_load): loadable segments must ascend, the interpreter precedes them.

    Both are windows over one file's segments.
    """
    segments = reports.select(key, F.inline("program_headers"))
    own = Window.partitionBy(key).orderBy("index")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    is_load = F.col("p_type") == 1
    previous = F.last(F.when(is_load, F.col("vaddr")), ignorenulls=True).over(before)
    marked = segments.select(
        key,
        (is_load & (F.col("vaddr") <= previous)).alias("_unsorted"),
        ((F.col("p_type") == 3) & F.coalesce(F.max(is_load).over(before), F.lit(False))).alias("_late"),
    )
    return marked.groupBy(key).agg(
        F.coalesce(F.bool_or("_unsorted"), F.lit(False)).alias("load_not_sorted"), F.coalesce(F.bool_or("_late"), F.lit(False)).alias("interp_after_load")
    )


def dynamic_rules(entries: str = "dynamic", image: str = "elf_type in (2, 3)", fixed: str = "elf_type = 2", object_: str = "elf_type not in (1, 4)") -> list[Rule]:
    """Rules on a dynamic section, an array of (tag, value) in file order, ``NULL`` included.

    ``image`` tells executables and shared objects, ``fixed`` executables of fixed address, ``object_`` all but
    relocatable files and cores; ``interpreted`` and ``has_dynamic`` are boolean columns. Rules per tag or pair of tags count each.
    """
    tags = F.coalesce(F.transform(entries, lambda e: e["tag"]), F.array().cast("array<string>"))
    has = lambda tag: F.array_contains(tags, tag)
    number = lambda test: F.size(F.filter(tags, test))
    some = F.size(tags) > 0
    repeated = F.size(F.filter(F.array_distinct(tags), lambda t: ~t.isin(*REPEATABLE_TAGS) & (F.size(F.filter(tags, lambda o: o == t)) > 1)))
    plt = F.try_element_at(F.filter(entries, lambda e: e["tag"] == "PLTREL"), F.lit(-1))["value"]
    end = F.array_position(tags, "NULL")
    later = F.exists(F.slice(tags, F.greatest(end, F.lit(1)).cast("int"), F.greatest(F.size(tags), F.lit(0))), lambda t: t != "NULL")
    mandatory = F.size(F.array_except(F.array(*map(F.lit, MANDATORY_TAGS)), tags))
    needs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in TAG_NEEDS])
    lacking = F.size(F.filter(needs, lambda n: F.array_contains(tags, n["a"]) & ~F.array_contains(tags, n["b"])))
    return [
        Rule("dyn_textrel", hits=number(lambda t: t == "TEXTREL")),
        Rule("dyn_unknown_tag", hits=number(lambda t: t.startswith("Unknown"))),
        Rule("dyn_entries_after_null", (end > 0) & later),
        Rule("dyn_duplicate_tag", hits=repeated),
        Rule("dyn_pltrel_bad_value", plt.isNotNull() & ~parse_integer(plt).isin(7, 17)),
        Rule("dyn_missing_mandatory", hits=F.when(some & F.expr(image), mandatory)),
        Rule("dyn_missing_dependency", hits=F.when(some, lacking)),
        Rule("dyn_rpath_and_runpath", has("RPATH") & has("RUNPATH")),
        Rule("dyn_no_hash", some & F.expr(image) & ~has("HASH") & ~has("GNU_HASH")),
        Rule("dyn_static_exec_with_dynamic", F.expr(fixed) & ~F.col("interpreted") & F.col("has_dynamic")),
        Rule("dyn_empty", F.expr(object_) & ~some),
    ]


def outliers(found: DataFrame) -> DataFrame:
    """Rows of ``anomalies`` that are outliers, with ``outlier``, their name as such."""
    names = F.create_map(*[F.lit(x) for pair in OUTLIERS.items() for x in pair])
    return found.withColumn("outlier", F.try_element_at(names, F.col("anomaly"))).where("outlier is not null")


def missing_tags(rows: DataFrame, key: str, tags: str, needs: DataFrame) -> DataFrame:
    """(key, tag, needs): rules (tag, needs) whose tag a file has without what it needs; the rule table is broadcast."""
    own = rows.select(key, F.explode(F.array_distinct(tags)).alias("tag"), F.col(tags).alias("_tags"))
    return own.join(F.broadcast(needs), "tag").where(~F.array_contains("_tags", F.col("needs"))).select(key, "tag", "needs")
