"""Evaluation passages that leak into training text.

Template canonicalisation: numbers, units and names become typed placeholders. Windows of the
templates are joined by hash; then the slots are compared: equal fillings are a literal copy, one
consistent renaming of the fillings along a run of windows is a re-parameterised one.

What is a name or a unit is learned from the items. Both lists, and the hashes of the items' windows,
reach the tasks as bitmaps of a fixed size whatever the number of items: a word or window that only
shares a bit with one of them is sorted out by the join and the comparison of the slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.text import cased_words, words_in_sentences
from lodestack.operators.skew import salted_lookup
from lodestack.session import materialise

#: Words of a window.
WINDOW = 12
#: Bits of the bitmap of each list of words (1 MB), and of the one of window hashes (4 MB).
WORD_BITS, WINDOW_BITS = 1 << 23, 1 << 25
#: A re-parameterised leak repeats the template of an item over a run of at least so many words ...
LEAST_RUN = 20
#: ... in windows of which at least so many words are no placeholders.
LEAST_PLAIN = 6

_ODD = np.uint64(0x9E3779B97F4A7C15)
_NAME, _UNIT, _LOWER = range(3)


def window_hashes(tokens: np.ndarray) -> np.ndarray:
    """Hash of each run of WINDOW token codes."""
    n = len(tokens) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        out = out * _ODD + tokens[k : k + n]
    return out


def bitmaps(rows: DataFrame, by: str, position: Column, bits: int) -> dict[int, bytes]:
    """One bitmap per value of ``by``, with a bit for each ``position``; at most bits / 32,768 rows of 4 KB each reach the driver."""
    at = rows.select(by, (position + 1).alias("at"))
    parts = at.groupBy(by, F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out: dict[int, bytearray] = {}
    for row in parts.collect():
        out.setdefault(row[by], bytearray(bits // 8))[(row.part - 1) * 4096 : row.part * 4096] = row.bits
    return {k: bytes(v) for k, v in out.items()}


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, lower, inside, after_number) for each word of each text: in lower case, capitalised inside a sentence, right after a number."""
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = [] if text is None else words_in_sentences(text)
            lower = [w.islower() for w, _ in words]
            inside = [not first and w[0].isupper() and w[1:].islower() for w, first in words]
            after = [False, *(w.isdecimal() for w, _ in words[:-1])][: len(words)]
            arrays = [pa.array([w.lower() for w, _ in words], pa.string()), *(pa.array(x, pa.bool_()) for x in (lower, inside, after))]
            yield pa.RecordBatch.from_arrays(arrays, names=["word", "lower", "inside", "after_number"])


def vocabulary(items: DataFrame) -> dict[int, bytes]:
    """Bitmaps of the items' names, units and words in lower case.

    Names are capitalised inside a sentence and never in lower case; units are words that follow a
    number at least twice and in at least half of their occurrences. Computed over all items.
    """
    uses = items.select("text").mapInArrow(_uses, "word string, lower boolean, inside boolean, after_number boolean")
    words = uses.groupBy("word").agg(F.count_if("lower").alias("lower"), F.count_if("inside").alias("inside"), F.count_if("after_number").alias("after"), F.count("*").alias("n"))
    is_name = (F.col("inside") > 0) & (F.col("lower") == 0)
    is_unit = (F.col("after") >= 2) & (F.col("after") * 2 >= F.col("n"))
    kinds = F.array_compact(F.array(F.when(is_name, _NAME), F.when(is_unit, _UNIT), F.when(F.col("lower") > 0, _LOWER)))
    rows = words.select("word", F.explode(kinds).alias("list"))
    return bitmaps(rows, "list", F.pmod(F.xxhash64("word"), F.lit(WORD_BITS)), WORD_BITS)


class _Templates:
    """Token codes of texts; those of words already met are kept."""

    def __init__(self, lists: dict[int, bytes]) -> None:
        self.lists = lists
        self.codes: dict[str, tuple[int, bool, bool]] = {}
        self.fixed = {kind: xxhash.xxh64_intdigest(kind) for kind in ("<number>", "<name>", "<unit>")}

    def _listed(self, which: int, at: int) -> bool:
        bits = self.lists.get(which)
        return bits is not None and bool(bits[at >> 3] >> (at & 7) & 1)

    def code(self, word: str) -> tuple[int, bool, bool]:
        """(code, is a placeholder, known in lower case) of a word in lower case: equal words have equal codes."""
        found = self.codes.get(word)
        if found is None:
            if len(self.codes) > 200_000:
                self.codes = {}
            at = xxhash.xxh64_intdigest(word, seed=42) % WORD_BITS  # as Spark's xxhash64
            kind = "<number>" if word.isdecimal() else "<name>" if self._listed(_NAME, at) else "<unit>" if self._listed(_UNIT, at) else None
            found = self.codes[word] = (self.fixed[kind] if kind else xxhash.xxh64_intdigest(word), kind is not None, self._listed(_LOWER, at))
        return found

    def windows(self, text: str, shapes: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Lower-case words, hashes of the windows, and with ``shapes`` how many words of each are no placeholders.

        With ``shapes``, too, a capitalised word that no item writes in lower case is a name as well.
        """
        cased = cased_words(text)
        words = [w.lower() for w in cased]
        known = self.codes
        codes = [known[w] if w in known else self.code(w) for w in words]
        if shapes:
            name = (self.fixed["<name>"], True, False)
            codes = [name if not c[1] and not c[2] and w[0].isupper() and w[1:].islower() else c for w, c in zip(cased, codes)]
        hashes = window_hashes(np.fromiter((c[0] for c in codes), np.uint64, len(codes)))
        if not shapes or not len(hashes):
            return words, hashes, np.full(len(hashes), WINDOW)
        upto = np.cumsum([0, *(not c[1] for c in codes)])
        return words, hashes, upto[WINDOW:] - upto[:-WINDOW]


_SCHEMA = pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("hash", pa.int64()), ("words", pa.string()), ("plain", pa.int32())])
_DDL = "id bigint, pos int, hash bigint, words string, plain int"


def _emit(lists: dict[int, bytes], wanted: bytes | None, shapes: bool, least_plain: int, least_windows: int):
    """Windows of each whole text with at least ``least_plain`` words that are no placeholders; with ``wanted`` only those whose bit is set.

    Texts with fewer than ``least_windows`` of these give none.
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * len(_SCHEMA), _SCHEMA)], schema=_SCHEMA)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = _Templates(lists)
        bits = None if wanted is None else np.frombuffer(wanted, np.uint8)
        for batch in batches:
            rows = []
            for own_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                words, hashes, plain = templates.windows(text.as_py(), shapes)
                keep = plain >= least_plain
                if bits is not None:
                    at = hashes & np.uint64(WINDOW_BITS - 1)
                    keep &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                if np.count_nonzero(keep) < least_windows:
                    continue
                for i in np.flatnonzero(keep).tolist():
                    rows.append((own_id, i, int(hashes[i].astype(np.int64)), " ".join(words[i : i + WINDOW]), int(plain[i])))
                    if len(rows) > 20_000:
                        yield batch_of(rows)
                        rows = []
            yield batch_of(rows)

    return scan


def written_windows(documents: DataFrame, items: DataFrame, shapes: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hash, doc_words, doc_id, doc_pos) and (hash, item_words, item_id, item_pos): windows of whole texts, written; of posts those that items may have.

    ``documents`` has doc_id and text, ``items`` item_id and text. Null and empty texts and those
    of fewer than WINDOW words have no window. With ``shapes``, names that the items don't know
    count as names in posts, and windows are left out that are mostly placeholders: any numbers
    would be a renaming of any others; texts with too few windows for any run have none. However
    many items share a window, it stays in.
    """
    lists = vocabulary(items)
    least = (LEAST_PLAIN, LEAST_RUN - WINDOW + 1) if shapes else (0, 1)
    theirs = items.select("item_id", "text").mapInArrow(_emit(lists, None, False, *least), _DDL)
    theirs = materialise(theirs.select("hash", F.col("words").alias("item_words"), F.col("id").alias("item_id"), F.col("pos").alias("item_pos")), "windows")
    wanted = bitmaps(theirs.select("hash", F.lit(0).alias("all")), "all", F.pmod("hash", F.lit(WINDOW_BITS)), WINDOW_BITS).get(0, bytes(WINDOW_BITS // 8))
    ours = documents.select("doc_id", "text").mapInArrow(_emit(lists, wanted, shapes, *least), _DDL)
    return materialise(ours.select("hash", F.col("words").alias("doc_words"), F.col("id").alias("doc_id"), F.col("pos").alias("doc_pos")), "matches"), theirs


def matched_windows(ours: DataFrame, theirs: DataFrame, shapes: bool = False) -> DataFrame:
    """(doc_id, doc_pos, item_id, item_pos, doc_words, item_words): written windows with the same template, in all items that have it.

    Without ``shapes`` the slots are filled alike, too: the words are part of the join's key.
    Spark decides by the size of the items' windows on disk whether they are broadcast; where not,
    windows that hold a large part of the posts' are spread.
    """
    key = F.xxhash64("hash", *([] if shapes else ["_words"])).alias("_key")
    mine, other = (x.withColumn("_words", F.col(w)).withColumn("_key", key) for x, w in ((ours, "doc_words"), (theirs, "item_words")))
    joined = salted_lookup(mine.drop("_words"), other.drop("_words").withColumnRenamed("hash", "_hash"), "_key").where("hash = _hash")
    columns = joined.select("doc_id", "doc_pos", "item_id", "item_pos", "doc_words", "item_words")
    return columns if shapes else columns.where("doc_words = item_words")


def literal_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): texts that share at least WINDOW consecutive words, all slots filled alike."""
    return matched_windows(*written_windows(documents, items)).select("doc_id", "item_id").distinct()


def reparameterised_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, changed): posts that repeat an item with other numbers, names or units.

    Windows of a post and an item at the same distance from each other are taken together. They
    count where they cover at least LEAST_RUN words, where something was changed, and where one renaming explains
    all of it: equal words became equal words, different ones different ones. ``changed`` is the
    number of words that were renamed, ``windows`` that of the windows, for the run with most windows.
    Pairs that also share a literal window stay in. A window is compared with all items that have it:
    rows without words count the windows of each run, and only runs that are long enough and no
    literal copy meet their words. The aggregate of one run is as long as the item at most.
    """
    ours, theirs = written_windows(documents, items, shapes=True)
    run = ["doc_id", "item_id", "shift"]
    matched = matched_windows(ours, theirs, shapes=True).select(
        "doc_id", "item_id", (F.col("doc_pos") - F.col("item_pos")).alias("shift"), (F.col("doc_words") != F.col("item_words")).alias("differs")
    )
    long = matched.groupBy(*run).agg(F.count("*").alias("windows"), F.count_if("differs").alias("differing"))
    long = long.where((F.col("windows") >= LEAST_RUN - WINDOW + 1) & (F.col("differing") > 0)).select(*run, "windows")
    mine, other = ours.withColumnRenamed("doc_id", "_doc"), theirs.withColumnsRenamed({"item_id": "_item", "hash": "_hash"})
    worded = long.join(mine, F.col("doc_id").eqNullSafe(F.col("_doc"))).join(
        other, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("item_pos") == F.col("doc_pos") - F.col("shift")) & (F.col("hash") == F.col("_hash"))
    )
    slots = F.array_distinct(F.arrays_zip(F.split("item_words", " ").alias("was"), F.split("doc_words", " ").alias("now")))
    runs = worded.select(*run, "windows", slots.alias("slots")).groupBy(*run, "windows").agg(F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    was, now = F.transform("slots", lambda s: s["was"]), F.transform("slots", lambda s: s["now"])
    n = F.size("slots")
    runs = runs.withColumn("changed", F.size(F.filter("slots", lambda s: s["was"] != s["now"])))
    kept = runs.where((n == F.size(F.array_distinct(was))) & (n == F.size(F.array_distinct(now))))
    best = F.max(F.struct("windows", "changed")).alias("best")
    return kept.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.windows", "best.changed")


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, documents): which items leaked into how many posts; items without a leak have 0."""
    counted = leaks.groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id", "suite").join(counted, "item_id", "left").select(
        "item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents")
    )
