"""Reading level of what the author of a post wrote, on the scale that graders gave examples of.

Two regularised multinomial models, one of words and one of character trigrams, give each sentence
a distribution over the levels. A post's sentences are averaged by their number of words, and a
calibration, fitted on posts that the sentence models had not seen, turns the averages into a band.

Both models are linear in counts, so a word has one vector of eight weights whatever its sentence:
fitting is one sum per (fold, model, bucket), and scoring adds up vectors. Neither shuffles a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.text import lower_words, own_text, sentences
from lodestack.session import materialise

#: Labelled posts that the models are fitted on; beyond it those with the smallest hash of their id.
MOST_LABELLED = 20_000
#: Hash buckets of either model's features.
FEATURES = 1 << 14
BANDS = (1, 2, 3, 4)
#: Occurrences that every feature of a model is taken to have besides its own.
SMOOTHING = 0.2
MODELS = ("words", "characters")
#: Words whose vectors a task keeps; one more and it starts afresh.
KEPT_WORDS = 200_000
#: The least probability of a level that a sentence is given.
LEAST = 1e-4

_COLUMNS = [f"{m}{b}" for m in MODELS for b in BANDS]


def own_words(text: str | None, author: str | None) -> list[list[str]]:
    """The lower-case words of each sentence that the author wrote; none for null and empty texts."""
    return [w for w in (lower_words(s) for s in sentences(own_text(text, author))) if w] if text else []


def buckets(word: str) -> tuple[int, list[int]]:
    """A word's bucket, and the buckets of its trigrams with its ends marked."""
    marked = f"^{word}$"
    of = lambda x: xxhash.xxh64_intdigest(x) % FEATURES
    return of(word), [of(marked[i : i + 3]) for i in range(len(marked) - 2)]


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, band, part): each distinct verdict's part of the post's weight.

    A grader weighs as much as they agree, after smoothing, with the other verdicts on the same
    posts. Repeated rows count once; null bands, ids and bands off the scale are no verdicts; a
    null grader is one more grader.
    """
    own = labels.select("doc_id", F.coalesce("grader", F.lit("")).alias("grader"), "band").where(
        F.col("doc_id").isNotNull() & F.col("band").isin(*BANDS)
    ).distinct()
    post = Window.partitionBy("doc_id")
    seen = own.withColumn("others", F.count("*").over(post) - 1).withColumn("alike", F.count("*").over(Window.partitionBy("doc_id", "band")) - 1)
    trust = seen.groupBy("grader").agg(((F.sum("alike") + 1) / (F.sum("others") + 2)).alias("trust"))
    odds = F.greatest(F.lit(0.05), F.col("trust")) / F.greatest(F.lit(0.05), 1 - F.col("trust"))
    votes = seen.join(trust, "grader").groupBy("doc_id", "band").agg(F.sum(odds).alias("odds"))
    return votes.select("doc_id", "band", (F.col("odds") / F.sum("odds").over(post)).alias("part"))


_SUMS = pa.schema([("fold", pa.int32()), ("model", pa.int32()), ("bucket", pa.int32()), *[(f"c{b}", pa.float64()) for b in BANDS]])


def _sums(folds: int):
    """Rows (text, author, fold, part per band) of graded posts into weighted feature counts, added up within the task.

    Model 2 has one bucket: the weight of the sentences themselves.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, 2 * FEATURES + 1, len(BANDS)))
        for batch in batches:
            for text, author, fold, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                for words in own_words(text, author):
                    weighted = np.log1p(len(words)) * np.array(parts)
                    at = [2 * FEATURES]
                    for own, grams in map(buckets, words):
                        at.append(own)
                        at += [FEATURES + g for g in grams]
                    found, n = np.unique(at, return_counts=True)
                    total[fold, found] += n[:, None] * weighted
        fold, at = np.nonzero(total.any(axis=2))
        model, bucket = np.divmod(at, FEATURES)
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((fold, model, bucket, *total[fold, at].T), _SUMS)], schema=_SUMS)

    return scan


def _weights(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features x 4, 2 x 4): logarithms of the smoothed probabilities of both models' features and of the levels."""
    prior = total[-1] + SMOOTHING
    prior = np.log(prior / prior.sum())
    parts = [total[m * FEATURES : (m + 1) * FEATURES] + SMOOTHING for m in range(len(MODELS))]
    return np.concatenate([np.log(p / p.sum(axis=0)) for p in parts]).astype(np.float32), np.tile(prior, (len(MODELS), 1))


class _Scorer:
    """Sums of weights for the words of sentences; the vectors of words already met are kept."""

    def __init__(self, weights: tuple[np.ndarray, np.ndarray]) -> None:
        self.features, self.prior = weights
        self.places: dict[str, int] = {}
        self.vectors = np.empty((1024, len(_COLUMNS)))

    def place(self, word: str) -> int:
        at = self.places[word] = len(self.places)
        if at == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
        own, grams = buckets(word)
        self.vectors[at, : len(BANDS)] = self.features[own]
        self.vectors[at, len(BANDS) :] = self.features[np.add(grams, FEATURES)].sum(axis=0)
        return at

    def posts(self, posts: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """(words, averages) of posts with at least one sentence: averages over sentences, by length, of the log probabilities."""
        if len(self.places) > KEPT_WORDS:
            self.places.clear()
        known = self.places
        at = [known[w] if w in known else self.place(w) for post in posts for words in post for w in words]
        n_words = np.array([len(words) for post in posts for words in post])
        starts = np.concatenate([[0], np.cumsum(n_words)[:-1]])
        raw = np.add.reduceat(self.vectors[at], starts).reshape(len(n_words), len(MODELS), len(BANDS)) + self.prior
        raw -= raw.max(axis=2, keepdims=True)
        p = np.exp(raw)
        logs = np.log(np.maximum(p / p.sum(axis=2, keepdims=True), LEAST)).reshape(len(n_words), -1)
        first = np.concatenate([[0], np.cumsum([len(post) for post in posts])[:-1]])
        own = np.add.reduceat(n_words, first)
        return own, np.add.reduceat(logs * n_words[:, None], first) / own[:, None]


def _averages(models: list[tuple[np.ndarray, np.ndarray]], fold: str | None = None):
    """For (text, author[, fold], ...): the other columns, ``own_words`` and ``x`` of each row; null without own words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [_Scorer(m) for m in models]
        for whole in batches:
            for start in range(0, whole.num_rows, 512):  # whole texts, a few at a time
                batch = whole.slice(start, 512)
                posts = [own_words(t, a) for t, a in zip(batch.column("text").to_pylist(), batch.column("author").to_pylist())]
                use = np.array(batch.column(fold).to_pylist()) if fold else np.zeros(len(posts), int)
                n, x = [0] * len(posts), [None] * len(posts)
                for f in range(len(models)):
                    rows = [i for i in np.flatnonzero(use == f).tolist() if posts[i]]
                    if rows:
                        for i, own, average in zip(rows, *scorers[f].posts([posts[i] for i in rows])):
                            n[i], x[i] = int(own), average
                kept = [c for c in batch.schema.names if c not in ("text", "author")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=[*kept, "own_words", "x"])

    return scan


def _profiles(rows: DataFrame, models: list[tuple[np.ndarray, np.ndarray]], fold: str | None = None) -> DataFrame:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("text", "author")]
    return rows.mapInArrow(_averages(models, fold), ", ".join([*kept, "own_words bigint, x array<double>"]))


@dataclass
class ReadingModel:
    """``weights`` of the sentence models; ``matrix`` and ``offset`` of the calibration, one row per band."""

    weights: tuple[np.ndarray, np.ndarray]
    matrix: np.ndarray
    offset: np.ndarray


def fit(documents: DataFrame, labels: DataFrame, folds: int = 3) -> ReadingModel:
    """Models from the posts that ``labels`` grades, at most MOST_LABELLED of them.

    The chosen ids are broadcast: MOST_LABELLED rows at most. What reaches the driver are sums per fold and bucket: at most folds * (2 * FEATURES + 1) rows.
    Raises ValueError where no graded post has a sentence of its own.
    """
    parts = [F.sum(F.when(F.col("band") == b, F.col("part")).otherwise(0.0)).alias(f"p{b}") for b in BANDS]
    chosen = graded(labels).groupBy("doc_id").agg(*parts).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int").alias("fold")
    names = [f"p{b}" for b in BANDS]
    posts = materialise(documents.select("doc_id", "text", "author").join(F.broadcast(chosen), "doc_id").select("text", "author", fold, *names), "graded")
    sums = posts.mapInArrow(_sums(folds), "fold int, model int, bucket int, " + ", ".join(f"c{b} double" for b in BANDS))
    found = sums.groupBy("fold", "model", "bucket").agg(*[F.sum(f"c{b}").alias(f"c{b}") for b in BANDS]).toPandas()
    if found.empty:
        raise ValueError("no graded post has a sentence of its own")
    total = np.zeros((folds, 2 * FEATURES + 1, len(BANDS)))
    total[found["fold"], found["model"] * FEATURES + found["bucket"]] = found[[f"c{b}" for b in BANDS]]
    whole = total.sum(axis=0)
    # a fold that holds all there is is scored with what it was fitted on
    unseen = [_weights(rest if (rest := whole - total[f])[-1].any() else whole) for f in range(folds)]
    classes = F.inline(F.array(*[F.struct(F.lit(float(b - 1)).alias("class"), F.col(f"p{b}").alias("part")) for b in BANDS]))
    profiles = _profiles(posts, unseen, "fold").where("own_words > 0").select(array_to_vector("x").alias("x"), classes).where("part > 0")
    fitted = LogisticRegression(featuresCol="x", labelCol="class", weightCol="part", regParam=0.02, maxIter=30, family="multinomial").fit(materialise(profiles, "profiles"))
    matrix, offset = np.zeros((len(BANDS), len(_COLUMNS))), np.full(len(BANDS), -np.inf)
    matrix[: fitted.numClasses], offset[: fitted.numClasses] = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    return ReadingModel(_weights(whole), matrix, offset)


def levels(rows: DataFrame, model: ReadingModel) -> DataFrame:
    """``rows`` without text and author, with (own_words, band, confidence, level) of each row; all null but ``own_words`` = 0 without own words."""

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _averages([model.weights])(batches):
            x, own = batch.column("x"), np.asarray(batch.column("own_words"))
            some = own > 0
            raw = np.array([v for v in x.to_pylist() if v is not None]).reshape(-1, len(_COLUMNS)) @ model.matrix.T + model.offset
            p = np.exp(raw - raw.max(axis=1, keepdims=True)) if len(raw) else raw
            p = p / p.sum(axis=1, keepdims=True)
            out = np.zeros((3, len(own)))
            out[:, some] = p.argmax(axis=1) + 1, p.max(axis=1) if len(p) else p.sum(axis=1), p @ np.array(BANDS)
            arrays = [pa.array(v, t, mask=~some) for v, t in zip((out[0].astype(int), out[1], out[2]), (pa.int32(), pa.float64(), pa.float64()))]
            kept = [c for c in batch.schema.names if c != "x"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], names=[*kept, "band", "confidence", "level"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("text", "author")]
    return rows.mapInArrow(calibrate, ", ".join([*kept, "own_words bigint, band int, confidence double, level double"]))


def difficulty(documents: DataFrame, model: ReadingModel, least_words: int = 40) -> DataFrame:
    """(doc_id, own_words, band, confidence, level), one row for each post with at least ``least_words`` own words.

    ``level`` is the mean of the bands under the calibrated distribution. Repeated rows and rows
    with a null id are posts of their own. No shuffle: one scan.
    """
    return levels(documents.select("doc_id", "text", "author"), model).where((F.col("own_words") >= least_words) & F.col("band").isNotNull())


def profile(scored: DataFrame) -> DataFrame:
    """(band, documents, own_words): how the corpus is spread over the bands."""
    return scored.groupBy("band").agg(F.count("*").alias("documents"), F.sum("own_words").alias("own_words"))


def corpus_profile(documents: DataFrame, model: ReadingModel, short: int = 40) -> DataFrame:
    """(lang, short, band, documents, own_words): how all rows of ``documents`` are spread over the bands.

    ``lang`` is trimmed and in lower case, null stays null. ``short`` marks posts with fewer than ``short``
    own words; those without any have a null band. Each row counts, copies and rows with a null id
    too, so ``documents`` adds up to the table.
    """
    rows = levels(documents.select(F.lower(F.btrim("lang")).alias("lang"), "text", "author"), model)
    return rows.groupBy("lang", (F.col("own_words") < short).alias("short"), "band").agg(F.count("*").alias("documents"), F.sum("own_words").alias("own_words"))


def agreement(documents: DataFrame, labels: DataFrame, least_words: int = 40, part: int = 3) -> DataFrame:
    """(band, posts, right, near): posts of each band that the fit left out, how many were given it, and how many it or a neighbour.

    The posts with ``hash % part`` = 0 are held out; their band is that of the heaviest verdict, ties to the lower one.
    """
    held = F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(part)) == 0
    model = fit(documents, labels.where(~held))
    best = graded(labels.where(held)).groupBy("doc_id").agg(F.max(F.struct("part", -F.col("band"))).alias("m")).select("doc_id", (-F.col("m.col2")).alias("graded"))
    scored = difficulty(documents.join(best.select("doc_id"), "doc_id", "left_semi"), model, least_words).join(best, "doc_id")
    off = F.abs(F.col("band") - F.col("graded"))
    return scored.groupBy(F.col("graded").alias("band")).agg(F.count("*").alias("posts"), F.count_if(off == 0).alias("right"), F.count_if(off <= 1).alias("near"))
