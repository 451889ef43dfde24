"""Sources mixed to target weights.

Tokens are summed per source, which gives each source a repetition rate; every document is
emitted floor(rate) times, and once more where a hash of its id, as a number in [0, 1), is below
the fraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.session import materialise

#: Targets are a table of a few sources that the driver computes rates for.
MOST_SOURCES = 10_000


def source_key(source: Column) -> Column:
    """Variant spellings of a source: case, blanks at the ends, blanks and hyphens for underscores."""
    return F.regexp_replace(F.lower(F.btrim(source, F.lit(" \t\r\n"))), r"[\s-]+", "_")


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return own


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_count(path: str):
    """A pandas UDF: tokens of each whole text; null texts have none."""

    @F.pandas_udf(T.LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = _tokenizer(path)
        for texts in parts:
            sizes = []
            for at in range(0, len(texts), 256):
                sizes += [len(x) for x in own.encode_batch(texts.iloc[at : at + 256].fillna("").tolist(), add_special_tokens=False)]
            yield pd.Series(sizes, index=texts.index, dtype="int64")

    return count


def rates(targets: list[tuple[str, float, int]], available: dict[str, int], total: int | None = None) -> dict[str, float]:
    """Repetitions per source: share * total / available, at most ``max_repeats``.

    ``total`` is by default what the named sources have altogether. What capped and absent sources
    can't give is spread over the others by weight, until all are capped or the total is reached;
    the others keep their shares relative to each other.
    """
    total = sum(available.get(s, 0) for s, _, _ in targets) if total is None else total
    out = {s: 0.0 for s, _, _ in targets}
    open_ = {s: (w, cap) for s, w, cap in targets if w > 0 and cap > 0 and available.get(s, 0) > 0}
    left = float(total)
    while open_:
        weight = sum(w for w, _ in open_.values())
        full = {s for s, (w, cap) in open_.items() if left * w / weight > cap * available[s]}
        if not full:
            out |= {s: left * w / weight / available[s] for s, (w, _) in open_.items()}
            break
        for s in full:
            out[s] = float(open_[s][1])
            left -= out[s] * available[s]
            del open_[s]
    return out


def sized(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of the posts of named sources, written once. Null and unnamed sources are left out.

    Spark decides by the size of ``targets`` whether they are broadcast.
    """
    named = targets.select(source_key(F.col("source")).alias("source")).where("source is not null").distinct()
    rows = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").join(named, "source", "left_semi")
    counted = rows.select("doc_id", "source", token_count(tokenizer or default_tokenizer())("text").alias("tokens"))
    return materialise(counted, "tokens")


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, rate), one row per source of ``targets``.

    Rows of one source in different spelling are one target: weights add up, the smallest
    ``max_repeats`` holds. Null or negative weights and repeats are 0.
    """
    spark = sizes.sparkSession
    clean = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    rows = (
        targets.select(source_key(F.col("source")).alias("source"), clean("weight").alias("weight"), clean("max_repeats").alias("max_repeats"))
        .where("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
        .limit(MOST_SOURCES + 1).collect()
    )
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the targets")
    available = {r.source: r.tokens for r in sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    found = rates([(r.source, r.weight, r.max_repeats) for r in rows], available, total)
    weights = sum(r.weight for r in rows) or 1.0
    out = [(r.source, r.weight / weights, int(r.max_repeats), int(available.get(r.source, 0)), found[r.source]) for r in rows]
    return spark.createDataFrame(out, "source string, target_share double, max_repeats int, available bigint, rate double").coalesce(1)


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the hash of seed and id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) / F.lit(float(1 << 53))


def copied(rows: DataFrame, planned: DataFrame, seed: int = 11) -> DataFrame:
    """``rows`` (doc_id, source, ...), each as often as the mix needs it, never above ``max_repeats``, with ``copy_no``.

    ``planned`` comes from ``plan`` and has at most MOST_SOURCES rows, hence the broadcast is bounded. A row with
    a null id is one more with the draw of the null id.
    """
    whole = F.floor("rate")
    copies = (whole + (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("int")).cast("int")
    rated = rows.join(F.broadcast(planned.select("source", "rate", "max_repeats")), "source")
    kept = rated.withColumn("copies", F.least(copies, F.col("max_repeats"))).where("copies > 0")
    return kept.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("rate", "max_repeats", "copies")


def mixture(sizes: DataFrame, planned: DataFrame, seed: int = 11) -> DataFrame:
    """(doc_id, source, copy_no, tokens): the mix by id."""
    return copied(sizes.select("doc_id", "source", "tokens"), planned, seed).select("doc_id", "source", "copy_no", "tokens")


def mixed_documents(documents: DataFrame, planned: DataFrame, seed: int = 11) -> DataFrame:
    """(doc_id, source, copy_no, text): the same mix with its texts, in one scan of the documents; the draw needs no join by id."""
    rows = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text")
    return copied(rows, planned, seed).select("doc_id", "source", "copy_no", "text")


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, available, rate, met): what came out of a mix.

    ``met`` is false where a target can't be reached: the source is absent or its repeats are used up.
    """
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # over the few rows of the plan
    met = (F.col("target_share") == 0) | ((F.col("available") > 0) & (F.col("rate") < F.col("max_repeats")))
    known = planned.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return known.select(
        "source", "target_share", (F.col("tokens") / F.nullif(whole, F.lit(0))).alias("actual_share"), "tokens", "available", "rate", met.alias("met")
    )
