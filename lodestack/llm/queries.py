"""Queries of the training-data problems, over whole tables with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import cooccurrence, leakage, mixing, reading, stable_sample, term_counts
from lodestack.llm.text import TAG_PATTERN
from lodestack.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.report_terms(spark, d).where("mark is not null").select("field", "term", "mark")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.report_terms(spark, d).select("field", "term", "occurrences", "records", "mark")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    files = stable_sample.known_files(table(spark, d, "program_reports"), table(spark, d, "elf_reports"))
    return stable_sample.poisson_sample(stable_sample.running_weights(files))


def _pairs(spark: SparkSession, d: str, least: int) -> DataFrame:
    return cooccurrence.pair_counts(cooccurrence.baskets(table(spark, d, "program_reports")), least)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.associated(_pairs(spark, d, 8)).select(F.col("item_a").alias("needed_a"), F.col("item_b").alias("needed_b"))


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, 1).drop("n")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.literal_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return leakage.reparameterised_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(p8_found(spark, d), table(spark, d, "eval_items"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    sizes = mixing.sized(table(spark, d, "documents"), targets)
    planned = mixing.plan(sizes, targets)
    return mixing.mixture(sizes, planned), planned


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """The mix with its texts."""
    return mixing.mixed_documents(table(spark, d, "documents"), _mix(spark, d)[1])


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mix(spark, d))


def _model(spark: SparkSession, d: str) -> reading.ReadingModel:
    return reading.fit(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.difficulty(table(spark, d, "documents").where("lang = 'en'"), _model(spark, d)).select("doc_id", "band")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.corpus_profile(table(spark, d, "documents"), _model(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_terms, p5_sample, p7_found, p7_pairs, p8_found, p8_reparameterised, p8_items, p9_mixture, p9_documents, p9_shares, p10_found, p10_profile,
    )
}

_PATH = "array_to_string(list_filter(string_split({0}, '/'), lambda x: x <> '' and x <> '.'), '/')"
_KEY = r"nullif(regexp_extract(trim({0}, E' \t\r\n'), '[^/]*$'), '')"
_TERM = r"nullif(regexp_replace(trim({0}, E' \t\r\n'), '[ \t\r\n]+', ' ', 'g'), '')"
_LIST = "list_filter(list_transform(coalesce({0}, []), lambda x: {1}), lambda y: y is not null)"


def _rows(name: str, column: str, one: str, from_: str) -> str:
    return f"select '{name}' as field, {_PATH.format('source.relative')} as p, lower(source.sha256) as sha, {_LIST.format(column, one)} as terms from {from_}"


_TERMS = f"""
    with rows_ as ({_rows("needed", "needed", _KEY.format("x"), "program_reports")}
        union all {_rows("p_type_name", "list_transform(program_headers, lambda h: h.p_type_name)", _TERM.format("x"), "elf_reports")}
        union all {_rows("normalized_findings", "normalized_findings", _TERM.format("x"), "elflint_reports")}),
    entries as (select field, p, sha, unnest(terms) as term from rows_),
    counted as (select field, term, count(*) as occurrences, count(distinct (p, sha)) as records from entries group by all),
    holders as (select field, count(distinct (p, sha)) as n from entries group by field),
    marked as (select counted.*, case when records < 3 then 'rare' when 2 * records > n then 'common' end as mark from counted join holders using (field))
"""
_PAIRS = f"""
    with own as (select distinct {_PATH.format('source.relative')} as p, lower(source.sha256) as sha, unnest({_LIST.format('needed', _KEY.format('x'))}) as k from program_reports),
    n as (select count(distinct (p, sha)) as n from own), one as (select k, count(*) as n from own group by k),
    pairs as (select a.k as item_a, b.k as item_b, count(*) as n_ab from own a join own b on a.p = b.p and a.sha = b.sha and a.k < b.k group by all),
    full_ as (select item_a, item_b, n_ab, x.n as n_a, y.n as n_b, n.n as n from pairs join one x on x.k = item_a join one y on y.k = item_b, n)
"""
# The entities that the posts hold; tags as in ``text``, without a look ahead.
_BARE = "regexp_replace(regexp_replace(text, '" + TAG_PATTERN.replace(r"(?=\n|$)", r"(?:\n|\z)").replace("'", "''") + "', ' ', 'gis'), '&(nbsp|#39|gt|lt|quot|amp);', ' ', 'g')"
_LEAKS = f"""
    with runs as (select 'doc' as what, doc_id as id, regexp_extract_all(lower({_BARE}), '[\\p{{L}}\\p{{N}}]+') as w from documents where text is not null
        union all select 'item', item_id, regexp_extract_all(lower({_BARE}), '[\\p{{L}}\\p{{N}}]+') from eval_items where text is not null),
    windows as (select distinct what, id, array_to_string(w[i:i + 11], ' ') as g from runs, unnest(range(1, len(w) - 10)) as u(i) where len(w) >= 12),
    leaks as (select distinct a.id as doc_id, b.id as item_id from windows a join windows b on a.g = b.g where a.what = 'doc' and b.what = 'item')
"""
SQL = {
    "p8_found": _LEAKS + "select doc_id, item_id from leaks",
    "p8_items": _LEAKS + "select item_id, suite, coalesce(n, 0)::bigint as documents from eval_items left join (select item_id, count(*) as n from leaks group by 1) using (item_id)",
    "p1_found": _TERMS + "select field, term, mark from marked where mark is not null",
    "p1_terms": _TERMS + "select field, term, occurrences, records, mark from marked",
    "p5_sample": f"""
        with files as (select {_PATH.format('source.relative')} as identifier, source.size as size from program_reports
            union all select {_PATH.format('source.relative')}, source.size from elf_reports),
        weights as (select identifier, max(greatest(1.0::double, coalesce(size, 0)::double / 65536)) as weight from files where identifier is not null group by 1)
        select identifier, weight, ('0x' || substr(md5('sample/' || identifier), 1, 13))::bigint / 4503599627370496.0::double as draw, least(1.0::double, weight * 0.02::double) as probability
        from weights where ('0x' || substr(md5('sample/' || identifier), 1, 13))::bigint / 4503599627370496.0::double < least(1.0::double, weight * 0.02::double)""",
    "p7_found": _PAIRS + "select item_a as needed_a, item_b as needed_b from full_ where n_ab >= 8 and n * n_ab >= 4 * n_a * n_b",
    "p7_pairs": _PAIRS + "select item_a, item_b, n_ab, n_a, n_b, n::double * n_ab / (n_a::double * n_b) as lift from full_",
}
