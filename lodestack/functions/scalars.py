"""Column builders for binary-report corpora. Each is null for null input unless it says otherwise."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rewrites that turn a message into its template, in order.
MESSAGE_REWRITES = (
    (r"\[\s*\d+\s*\]", "[N]"),
    (r"'[^']*'", "'STR'"),
    (r"\([^)]*\)", "(STR)"),
    (r"\b0x[0-9a-fA-F]+\b", "0xN"),
    (r"\b\d+\b", "N"),
    (r"\s+", " "),
)

# Codes and names of relocations, of entries of the auxiliary vector, and of loader states.
RELOCATIONS = {
    0: "NONE", 1: "64", 2: "PC32", 3: "GOT32", 4: "PLT32", 5: "COPY", 6: "GLOB_DAT", 7: "JUMP_SLOT", 8: "RELATIVE", 9: "GOTPCREL", 10: "32", 11: "32S", 12: "16", 13: "PC16", 14: "8",
    15: "PC8", 16: "DTPMOD64", 17: "DTPOFF64", 18: "TPOFF64", 19: "TLSGD", 20: "TLSLD", 21: "DTPOFF32", 22: "GOTTPOFF", 23: "TPOFF32", 24: "PC64", 25: "GOTOFF64", 26: "GOTPC32", 36: "TLSDESC", 37: "IRELATIVE",
}
AUXILIARY = {
    0: "AT_NULL", 1: "AT_IGNORE", 2: "AT_EXECFD", 3: "AT_PHDR", 4: "AT_PHENT", 5: "AT_PHNUM", 6: "AT_PAGESZ", 7: "AT_BASE", 8: "AT_FLAGS", 9: "AT_ENTRY", 10: "AT_NOTELF", 11: "AT_UID", 12: "AT_EUID", 13: "AT_GID",
    14: "AT_EGID", 15: "AT_PLATFORM", 16: "AT_HWCAP", 17: "AT_CLKTCK", 23: "AT_SECURE", 24: "AT_BASE_PLATFORM", 25: "AT_RANDOM", 26: "AT_HWCAP2", 27: "AT_RSEQ_FEATURE_SIZE", 28: "AT_RSEQ_ALIGN", 31: "AT_EXECFN",
    32: "AT_SYSINFO", 33: "AT_SYSINFO_EHDR", 51: "AT_MINSIGSTKSZ",
}
LOADER_STATES = {0: "RT_CONSISTENT", 1: "RT_ADD", 2: "RT_DELETE"}

# Bits and names of segment flags.
SEGMENT_FLAGS = ((4, "PF_R"), (2, "PF_W"), (1, "PF_X"))

# Codes and names of file types and machines.
FILE_TYPES = {0: "ET_NONE", 1: "ET_REL", 2: "ET_EXEC", 3: "ET_DYN", 4: "ET_CORE"}
MACHINES = {3: "EM_386", 40: "EM_ARM", 62: "EM_X86_64", 183: "EM_AARCH64", 243: "EM_RISCV"}
CLASSES = {1: "ELF32", 2: "ELF64"}
ENCODINGS = {1: "little", 2: "big"}

# Codes and names of segment types.
SEGMENT_TYPES = {
    0: "PT_NULL", 1: "PT_LOAD", 2: "PT_DYNAMIC", 3: "PT_INTERP", 4: "PT_NOTE", 5: "PT_SHLIB", 6: "PT_PHDR", 7: "PT_TLS",
    0x6474E550: "PT_GNU_EH_FRAME", 0x6474E551: "PT_GNU_STACK", 0x6474E552: "PT_GNU_RELRO", 0x6474E553: "PT_GNU_PROPERTY",
}

# Instruction-set levels in ascending order.
ISA_LEVELS = ("x86-64-baseline", "x86-64-v2", "x86-64-v3", "x86-64-v4")

# Parts of an error text that name a failure, first match wins.
FAILURES = ("symbol lookup error", "cannot open shared object", "undefined symbol", "no version information", "timeout after")

# Bits and names of the second word of dynamic flags.
DYNAMIC_FLAGS = (
    (0x1, "DF_1_NOW"), (0x2, "DF_1_GLOBAL"), (0x4, "DF_1_GROUP"), (0x8, "DF_1_NODELETE"), (0x10, "DF_1_LOADFLTR"), (0x20, "DF_1_INITFIRST"),
    (0x40, "DF_1_NOOPEN"), (0x80, "DF_1_ORIGIN"), (0x100, "DF_1_DIRECT"), (0x200, "DF_1_TRANS"), (0x400, "DF_1_INTERPOSE"), (0x800, "DF_1_NODEFLIB"),
    (0x1000, "DF_1_NODUMP"), (0x2000, "DF_1_CONFALT"), (0x4000, "DF_1_ENDFILTEE"), (0x8000, "DF_1_DISPRELDNE"), (0x10000, "DF_1_DISPRELPND"),
    (0x20000, "DF_1_NODIRECT"), (0x40000, "DF_1_IGNMULDEF"), (0x80000, "DF_1_NOKSYMS"), (0x100000, "DF_1_NOHDR"), (0x200000, "DF_1_EDITED"),
    (0x400000, "DF_1_NORELOC"), (0x800000, "DF_1_SYMINTPOSE"), (0x1000000, "DF_1_GLOBAUDIT"), (0x2000000, "DF_1_SINGLETON"), (0x8000000, "DF_1_PIE"),
)

# Bits and names of the origin of a search path.
SEARCH_FLAGS = ((1, "LA_SER_ORIG"), (2, "LA_SER_LIBPATH"), (4, "LA_SER_RUNPATH"), (8, "LA_SER_CONFIG"), (64, "LA_SER_DEFAULT"), (128, "LA_SER_SECURE"))

# Tags that every dynamic section has, and tags that need others.
MANDATORY_TAGS = ("STRTAB", "SYMTAB", "STRSZ", "SYMENT")
TAG_NEEDS = (
    ("NEEDED", "STRTAB"), ("PLTRELSZ", "JMPREL"), ("HASH", "SYMTAB"), ("STRTAB", "STRSZ"), ("SYMTAB", "STRTAB"), ("SYMTAB", "SYMENT"), ("RELA", "RELASZ"),
    ("RELA", "RELAENT"), ("RELASZ", "RELA"), ("RELAENT", "RELA"), ("STRSZ", "STRTAB"), ("SYMENT", "SYMTAB"), ("SONAME", "STRTAB"), ("RPATH", "STRTAB"),
    ("REL", "RELSZ"), ("REL", "RELENT"), ("RELSZ", "REL"), ("RELENT", "REL"), ("JMPREL", "PLTRELSZ"), ("JMPREL", "PLTREL"), ("RUNPATH", "STRTAB"),
    ("PLTREL", "JMPREL"), ("GNU_HASH", "SYMTAB"),
)
# Tags that may occur more than once.
REPEATABLE_TAGS = ("NEEDED", "NULL", "POSFLAG_1", "AUXILIARY", "FILTER")


def template(message: Column) -> Column:
    """The message with numbers, quoted and bracketed parts replaced, white space squeezed."""
    for pattern, to in MESSAGE_REWRITES:
        message = F.regexp_replace(message, pattern, to)
    return F.trim(message)


def named(code: Column, names: dict[int, str], unknown: str = "unknown") -> Column:
    """A code's name; ``unknown`` for codes without one and for null."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit(unknown))


def flag_names(value: Column, flags: tuple[tuple[int, str], ...] = SEGMENT_FLAGS) -> Column:
    """Names of the bits that are set, in the order of ``flags``."""
    listed = F.array(*[F.when(value.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in flags])
    return F.when(value.isNotNull(), F.array_compact(listed))


def joined_flags(value: Column, flags: tuple[tuple[int, str], ...], none: str, other: str) -> Column:
    """``A|B``; ``none`` for zero; bits without a name add ``other``."""
    known = sum(bit for bit, _ in flags)
    rest = F.when(value.bitwiseAND(F.lit(~known)) != 0, F.array(F.lit(other))).otherwise(F.array().cast("array<string>"))
    return F.when(value == 0, none).otherwise(F.array_join(F.concat(flag_names(value, flags), rest), "|"))


def permission(flags: Column) -> Column:
    """R, W and X in this order, ``(none)`` without any."""
    letters = [F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name[-1])).otherwise("") for bit, name in SEGMENT_FLAGS]
    return F.when(flags.isNotNull(), F.coalesce(F.nullif(F.concat(*letters), F.lit("")), F.lit("(none)")))


def run_path_style(path: Column) -> Column:
    """How a run path is written."""
    return (
        F.when(path.contains("$ORIGIN") | path.contains("${ORIGIN}"), "$ORIGIN")
        .when(path.startswith("/"), "absolute")
        .when(path.contains("/"), "relative-multi")
        .when(path.isNotNull(), "relative-bare")
    )


def search_path(path: Column, root: str) -> Column:
    """Entries of a colon-separated path: absolute ones below ``root``, those with $ORIGIN dropped, others kept."""
    parts = F.filter(F.split(path, ":"), lambda x: (x != "") & ~x.contains("$ORIGIN"))
    return F.transform(parts, lambda x: F.when(x.startswith("/"), F.concat(F.lit(root), x)).otherwise(x))


def bucket(value: Column, cuts: list[tuple[float, str]], above: str) -> Column:
    """The name of the first cut that ``value`` doesn't exceed, else ``above``."""
    found = None
    for most, name in cuts:
        found = F.when(value <= most, name) if found is None else found.when(value <= most, name)
    return F.when(value.isNotNull(), found.otherwise(above))


# Upper ends of the buckets of zero-filled shares, findings, closure sizes and edges beyond a tree.
BSS_CUTS = [(0.1, "<=0.1"), (0.5, "0.1-0.5"), (0.9, "0.5-0.9")]
FINDING_CUTS = [(0, "0"), (1, "1"), (5, "2-5"), (10, "6-10"), (50, "11-50"), (100, "51-100")]
CLOSURE_CUTS = [(0, "0"), (1, "1"), (5, "2-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"), (100, "51-100"), (200, "101-200")]
EXTRA_CUTS = [
    (1, "1"), (2, "2"), (5, "3-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"), (100, "51-100"), (200, "101-200"), (500, "201-500"), (1000, "501-1000"), (10_000, "1001-10000"),
]


def zero_filled_share(filesz: Column, memsz: Column) -> Column:
    """Part of a segment's memory that the file doesn't fill; null where it takes no memory."""
    return F.when(memsz > 0, F.greatest(F.lit(0.0), (memsz - filesz) / memsz))


def version_numbers(text: Column) -> Column:
    """``1.2.10`` as [1, 2, 10], which compares as versions do; null for any other text."""
    return F.when(text.rlike(r"^\d+(\.\d+)*$"), F.transform(F.split(text, r"\."), lambda x: x.try_cast("bigint")))


def split_version(text: Column) -> list[Column]:
    """(verset, version) of ``NAME_1.2``, split at the first underscore."""
    at = F.instr(text, "_")
    return [F.when(at > 0, F.substring(text, F.lit(1), at - 1)).alias("verset"), F.when(at > 0, F.substring(text, at + 1, F.length(text))).alias("version")]


def isa_rank(level: Column) -> Column:
    """1 for the lowest level; 0 for others and null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, ISA_LEVELS)), level).cast("int"), F.lit(0))


def is_power_of_two(value: Column) -> Column:
    return (value > 0) & (value.bitwiseAND(value - 1) == 0)


def is_congruent(vaddr: Column, offset: Column, align: Column) -> Column:
    """Address and file offset agree modulo the alignment; alignments up to 1 always do."""
    return F.when(align > 1, (vaddr - offset) % align == 0).otherwise(True)


def relocation_family(name: Column) -> Column:
    upper = F.upper(name)
    return (
        F.when(upper.contains("IRELATIVE"), "ifunc")
        .when(upper.contains("RELATIVE"), "relative")
        .when(upper.endswith("_COPY"), "copy")
        .when(upper.contains("JUMP_SLOT") | upper.contains("JMP_SLOT"), "plt")
        .when(upper.rlike("TLS|TPOFF|DTPOFF|DTPMOD"), "tls")
        .when(name.isNotNull(), "other")
    )


def parse_integer(text: Column, default: int = -1) -> Column:
    """Decimal or 0x text as bigint, else ``default``, also for null."""
    low = F.lower(F.trim(text))
    hexadecimal = F.conv(F.when(low.rlike(r"^0x[0-9a-f]{1,15}$"), F.substring(low, 3, 15)), 16, 10).cast("bigint")
    return F.coalesce(hexadecimal, low.try_cast("bigint"), F.lit(default))


def unsigned(hex_text: Column) -> Column:
    """Hexadecimal text of up to 16 digits as decimal(20,0): all of the unsigned 64-bit range."""
    return F.conv(F.regexp_replace(hex_text, "^0[xX]", ""), 16, 10).cast("decimal(20,0)")


def failure(error: Column) -> Column:
    """The first known part that the text holds, else its first 160 characters."""
    known = F.coalesce(*[F.when(error.contains(part), part) for part in FAILURES])
    return F.coalesce(known, F.substring(error, 1, 160))


def dependency_names(field: Column) -> Column:
    """Names in a blank-separated dependency list, without constraints; conflicts (``!x``) are left out."""
    tokens = F.filter(F.split(F.trim(field), r"\s+"), lambda x: (x != "") & ~x.startswith("!"))
    return F.transform(tokens, lambda x: F.regexp_replace(x, "[<>=~].*$", ""))


def conflict_names(field: Column) -> Column:
    tokens = F.filter(F.split(F.trim(field), r"\s+"), lambda x: x.startswith("!"))
    return F.transform(tokens, lambda x: F.regexp_replace(F.substring(x, 2, 1 << 20), "[<>=~].*$", ""))


def package_name(directory: Column) -> Column:
    """``name-1.2-r3`` without version and release."""
    return F.regexp_replace(directory, r"-[^-]+-r\d+$", "")


def feature_list(text: Column) -> list[Column]:
    """(head, items) of ``head: a, b``."""
    items = F.transform(F.split(F.when(F.instr(text, ":") > 0, F.substring(text, F.instr(text, ":") + 1, F.length(text))).otherwise(""), ","), lambda x: F.trim(x))
    return [F.trim(F.substring_index(text, ":", 1)).alias("head"), F.filter(items, lambda x: x != "").alias("items")]


def enum_name(text: Column) -> Column:
    """The name in ``Name (0x3)``, in ``{"Name": ..., "Value": ...}`` or alone."""
    return F.coalesce(F.get_json_object(text, "$.Name"), F.substring_index(text, " (", 1))


def md5_draw(*parts: Column) -> Column:
    """Hex digits that order the rows of a sample, the same in every run."""
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


@F.pandas_udf(T.DoubleType())
def blake_draw(text: pd.Series) -> pd.Series:
    """The 64-bit BLAKE2b digest as a number in [0, 1); null for null."""
    score = lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") / 2.0**64
    return text.map(score, na_action="ignore").astype("float64")


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def archive_path(path: Column) -> Column:
    """An archive member's path without empty and ``.`` components; null where it is absolute, empty or has ``..``."""
    parts = _parts(path)
    return F.when(~path.startswith("/") & (F.size(parts) > 0) & ~F.array_contains(parts, ".."), F.array_join(parts, "/"))


def link_target(link: Column, target: Column) -> Column:
    """The target of a symbolic link as a path in its package, resolved against the link's folder; null where it leads out or is empty."""
    folder = F.slice(_parts(link), 1, F.greatest(F.size(_parts(link)) - 1, F.lit(0)))
    steps = F.when(target.startswith("/"), _parts(target)).otherwise(F.concat(folder, _parts(target)))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(True).alias("inside"))
    up = lambda acc: F.struct(F.slice(acc["path"], 1, F.greatest(F.size(acc["path"]) - 1, F.lit(0))).alias("path"), (acc["inside"] & (F.size(acc["path"]) > 0)).alias("inside"))
    down = lambda acc, x: F.struct(F.concat(acc["path"], F.array(x)).alias("path"), acc["inside"].alias("inside"))
    walked = F.aggregate(steps, start, lambda acc, x: F.when(x == "..", up(acc)).otherwise(down(acc, x)))
    return F.when((target != "") & walked["inside"], F.array_join(walked["path"], "/"))


def relative_path(folder: Column, target: Column) -> Column:
    """``target`` as seen from ``folder``: ``..`` for each level up, ``.`` for the folder itself."""
    a, b = _parts(folder), _parts(target)
    same = F.transform(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x)
    differs = F.array_position(same, False)
    common = F.when(differs > 0, differs - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")
    out = F.concat(F.array_repeat(F.lit(".."), F.size(a) - common), F.slice(b, common + 1, F.greatest(F.size(b) - common, F.lit(0))))
    return F.when(F.size(out) == 0, ".").otherwise(F.array_join(out, "/"))


def count_of(value: Column) -> Column:
    """A count given as a number or as an object with one, else 0."""
    return F.coalesce(value.try_cast("bigint"), F.get_json_object(value, "$.n").try_cast("bigint"), F.lit(0))
