"""Dumps of binaries as JSON documents, one array of one object per file, read by Spark's own JSON functions.

Texts are (path, text). ``documents`` mends the two defects that dumps are known for and parses
them; the other functions take what it gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.scalars import ISA_LEVELS, enum_name, feature_list, isa_rank, relocation_family

_NAMED = "struct<Name: string, Value: bigint>"
#: What is read of a document; fields that are absent are null.
SCHEMA = (
    f"array<struct<FileSummary: struct<Arch: string>, ElfHeader: struct<Type: {_NAMED}, Machine: {_NAMED}>,"
    f" ProgramHeaders: array<struct<ProgramHeader: struct<Type: {_NAMED}>>>,"
    " DynamicSection: array<struct<Type: string, Value: string, Library: string, Name: string, Path: array<string>>>,"
    f" Relocations: array<struct<Relocs: array<struct<Relocation: struct<Type: {_NAMED}>>>>>,"
    f" DynamicSymbols: array<struct<Symbol: struct<Name: {_NAMED}, Binding: {_NAMED}, Section: {_NAMED}>>>,"
    " VersionDefinitions: array<struct<Definition: struct<Name: string, Predecessors: array<string>>>>,"
    " NoteSections: array<struct<NoteSection: struct<Notes: array<struct<`Build ID`: string, Property: array<string>>>>>>>>"
)


def _mended(text: Column, mark: str, ends: str, value) -> Column:
    """Each ``mark`` followed by what ``ends`` matches up to a line end becomes a field of ``value``; others stay."""
    parts = F.split(text, mark)
    fixed = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.when(p.rlike(rf"^{ends}\n"), F.concat(F.lit(","), value(F.regexp_extract(p, rf"^{ends}\n", 1)), F.regexp_replace(p, rf"^{ends}\n", ""))).otherwise(F.concat(F.lit(mark.replace("\\", "")), p)),
    )
    return F.concat(F.get(parts, 0), F.array_join(fixed, ""))


def repaired_json(text: Column) -> Column:
    """Two defects of dumped JSON mended: unquoted names in ``Predecessors: [...]`` and a bare ``Machine: N``, both without comma."""
    quoted = lambda names: F.when(names == "", F.lit("")).otherwise(F.concat_ws(",", F.transform(F.split(names, ","), lambda n: F.concat(F.lit('"'), F.trim(n), F.lit('"')))))
    number = lambda n: F.when(n.startswith("0x"), F.conv(F.substring(n, 3, 20), 16, 10)).otherwise(n)
    text = _mended(text, r"Predecessors: \[", r"([^\]\n]*)\]", lambda names: F.concat(F.lit('"Predecessors":['), quoted(names), F.lit("]")))
    return _mended(text, "Machine: ", r"(0x[0-9a-fA-F]+|\d+)", lambda n: F.concat(F.lit('"Machine":{"Name":"Unknown","Value":'), number(n), F.lit("}")))


def documents(texts: DataFrame) -> DataFrame:
    """(path, doc) of (path, text); ``doc`` is null where the text is no document even when mended. Null texts are left out."""
    doc = F.get(F.from_json(repaired_json(F.col("text")), SCHEMA), 0)
    return texts.where("text is not null").select("path", doc.alias("doc"))


def _tags() -> Column:
    return F.coalesce(F.col("doc.DynamicSection.Type"), F.array().cast("array<string>"))


def _is_image() -> Column:
    return F.coalesce(enum_name(F.col("doc.ElfHeader.Type.Name")).isin("SharedObject", "Executable"), F.lit(False))


def exported_symbols(docs: DataFrame) -> DataFrame:
    """(path, symbol) of files with a soname: global or weak symbols that are defined in a section, with a name."""
    symbols = docs.where(F.array_contains(_tags(), "SONAME")).select("path", F.explode("doc.DynamicSymbols.Symbol").alias("s"))
    bound = F.col("s.Binding.Name").isin("Global", "Weak")
    defined = F.col("s.Section.Name").isNotNull() & ~F.col("s.Section.Name").isin("Undefined", "Absolute")
    return symbols.where(bound & defined & (F.col("s.Name.Name") != "")).select("path", F.col("s.Name.Name").alias("symbol"))


def audit_candidates(docs: DataFrame, present: DataFrame) -> DataFrame:
    """(path) of documents with an interpreter segment and a dynamic section whose file is among ``present`` (path)."""
    interpreted = F.exists(F.coalesce(F.col("doc.ProgramHeaders.ProgramHeader.Type.Name"), F.array().cast("array<string>")), lambda t: enum_name(t) == "PT_INTERP")
    return docs.where(interpreted & (F.size(_tags()) > 0)).select("path").join(present.select("path").distinct(), "path", "left_semi")


def hash_style() -> Column:
    """Which hash tables a document's dynamic section names: both, one, or neither where an image has a dynamic section."""
    old, new = F.array_contains(_tags(), "HASH"), F.array_contains(_tags(), "GNU_HASH")
    return F.when(old & new, "both").when(old, "HASH").when(new, "GNU_HASH").when(_is_image() & (F.size(_tags()) > 0), "neither").otherwise("none asked")


def relocation_types() -> Column:
    groups = F.coalesce(F.col("doc.Relocations.Relocs"), F.array().cast("array<array<struct<Relocation: struct<Type: struct<Name: string, Value: bigint>>>>>"))
    return F.transform(F.flatten(groups), lambda r: enum_name(r["Relocation"]["Type"]["Name"]))


def presence_flags() -> dict[str, Column]:
    """Conditions on ``doc`` that a survey counts files by."""
    has = lambda tag: F.array_contains(_tags(), tag)
    family = lambda name: F.exists(relocation_types(), lambda t: relocation_family(t) == name)
    builds = F.col("doc.NoteSections.NoteSection.Notes")
    return {
        "runpath": has("RUNPATH"), "rpath": has("RPATH"), "bind_now": has("BIND_NOW"), "textrel": has("TEXTREL"), "relr": has("RELR") | has("RELRSZ") | has("RELRENT"), "jmprel": has("JMPREL"), "soname": has("SONAME"),
        "no_relocations": F.size(relocation_types()) == 0, "ifunc": family("ifunc"), "copy": family("copy"), "tls_relocations": family("tls"),
        "verdef": F.coalesce(F.size("doc.VersionDefinitions"), F.lit(0)) > 0, "build_id": F.exists(F.flatten(builds), lambda n: F.length(n["Build ID"]) > 0),
    }


def relocation_counts(docs: DataFrame) -> DataFrame:
    """(machine, type, files, occurrences): one counter per machine."""
    rows = docs.select("path", F.col("doc.ElfHeader.Machine.Name").alias("machine"), F.explode(relocation_types()).alias("type"))
    per_file = rows.groupBy("machine", "type", "path").agg(F.count("*").alias("n"))
    return per_file.groupBy("machine", "type").agg(F.count("*").alias("files"), F.sum("n").alias("occurrences"))


def note_features(docs: DataFrame) -> DataFrame:
    """(metric, key, files): build-id bytes, the highest ISA level, and features of each family, each once per file."""
    notes = docs.select("path", F.explode(F.flatten("doc.NoteSections.NoteSection.Notes")).alias("note"))
    sizes = notes.where(F.length("note.`Build ID`") > 0).groupBy("path").agg(F.max(F.floor(F.length("note.`Build ID`") / 2)).alias("n"))
    sizes = sizes.select("path", F.lit("build_id_bytes").alias("metric"), F.col("n").cast("string").alias("key"))
    families = {"x86 feature": "cet", "x86 feature used": "x86 (used)", "x86 feature needed": "x86 (needed)", "x86 isa used": "isa", "x86 isa needed": "isa", "aarch64 feature": "aarch64"}
    table = F.create_map(*[F.lit(x) for pair in families.items() for x in pair])
    head, items = feature_list(F.col("p"))
    found = notes.select("path", F.explode("note.Property").alias("p")).select("path", F.try_element_at(table, F.lower(head)).alias("metric"), F.explode(items).alias("key"))
    listed = found.where("metric is not null and metric <> 'isa'").distinct()
    levels = found.where("metric = 'isa'").groupBy("path").agg(F.max(isa_rank(F.col("key"))).alias("rank")).where("rank > 0")
    levels = levels.select("path", F.lit("isa").alias("metric"), F.get(F.array(*map(F.lit, ISA_LEVELS)), F.col("rank") - 1).alias("key"))
    return sizes.unionByName(listed).unionByName(levels).groupBy("metric", "key").agg(F.count("*").alias("files"))


def dynamic_rows(docs: DataFrame) -> DataFrame:
    """(path, dynamic, elf_type, interpreted, has_dynamic) as ``rules.dynamic_rules`` takes them."""
    kinds = F.create_map(*[F.lit(x) for x in ("Relocatable", 1, "Executable", 2, "SharedObject", 3, "Core", 4)])
    types = F.coalesce(F.col("doc.ProgramHeaders.ProgramHeader.Type.Name"), F.array().cast("array<string>"))
    return docs.select(
        "path", F.transform("doc.DynamicSection", lambda e: F.struct(e["Type"].alias("tag"), e["Value"].alias("value"))).alias("dynamic"),
        F.coalesce(F.try_element_at(kinds, enum_name(F.col("doc.ElfHeader.Type.Name"))), F.lit(0)).alias("elf_type"),
        F.array_contains(types, "PT_INTERP").alias("interpreted"), F.array_contains(types, "PT_DYNAMIC").alias("has_dynamic"),
    )
