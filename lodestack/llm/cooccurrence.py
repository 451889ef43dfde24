"""How many records hold both items of a pair, and how much more often than chance.

Blocked Gram matrix: baskets are the rows of a sparse binary matrix X. Each task takes blocks of
baskets, numbers the block's items in byte order and sums the upper triangle of the block's
transposed product; Spark adds the blocks up. The diagonal holds the items' own counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.records import keys_of, record_id
from lodestack.operators.skew import salted_lookup
from lodestack.session import materialise

#: Items of a record block; entries of a product that are held at a time.
BLOCK_ITEMS, BLOCK_ENTRIES = 400_000, 2_000_000
#: Counters of the support sketch: a bitmap of 128 KB.
SKETCH = 1 << 20


def baskets(reports: DataFrame) -> DataFrame:
    """(items): the distinct ``needed`` keys of each record with at least one, copies united."""
    entries = reports.select(*record_id(), F.explode(keys_of(F.col("needed"))).alias("item"))
    return entries.groupBy("rec_a", "rec_b").agg(F.collect_set("item").alias("items")).select("items")


def _triangle(codes: np.ndarray, counts: np.ndarray, n_items: int) -> Iterator[np.ndarray]:
    """Entries a * n_items + b, a <= b, of the product of one block, in pieces; baskets of one length go together."""
    starts = np.concatenate([[0], np.cumsum(counts)])
    for length in np.unique(counts[counts > 0]):
        rows = codes[starts[:-1][counts == length][:, None] + np.arange(length)]
        rows.sort(axis=1)
        step = max(1, BLOCK_ENTRIES // max(1, len(rows)))
        for i in range(length):  # item i of each basket with the items from i on, by item blocks
            for j in range(i, length, step):
                yield (rows[:, i, None] * n_items + rows[:, j : j + step]).ravel()


def gram_block(items: pa.ChunkedArray, counts: np.ndarray) -> pa.Table:
    """(item_a, item_b, n): the upper triangle of a block's Gram matrix, diagonal included."""
    names = pc.unique(items)
    names = names.take(pc.sort_indices(names))
    codes = pc.index_in(items, value_set=names).to_numpy().astype(np.int64)
    keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    held: list[np.ndarray] = []

    def reduce() -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.concatenate(held), return_counts=True)
        both, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
        return both, np.bincount(at, weights=np.concatenate([sums, n])).astype(np.int64)

    size = 0
    for entries in _triangle(codes, counts, len(names)):
        held.append(entries)
        size += len(entries)
        if size > BLOCK_ENTRIES:
            keys, sums = reduce()
            held, size = [], 0
    if held:
        keys, sums = reduce()
    a, b = np.divmod(keys, max(1, len(names)))
    return pa.table({"item_a": names.take(pa.array(a)), "item_b": names.take(pa.array(b)), "n": sums})


def _gram(frequent: bytes | None):
    """Products of record blocks; items whose sketch counter is too small are left out."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if frequent is None else np.unpackbits(np.frombuffer(frequent, np.uint8), bitorder="little")
        held: list[tuple[pa.Array, np.ndarray]] = []
        size = 0

        def product() -> list[pa.RecordBatch]:
            return gram_block(pa.chunked_array([x for x, _ in held]).combine_chunks(), np.concatenate([c for _, c in held])).to_batches(50_000)

        for batch in batches:
            lists = batch.column("items")
            items, counts = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
            if bits is not None:
                keep = bits[batch.column("slots").flatten().to_numpy()].astype(bool)
                owner = np.repeat(np.arange(len(counts)), counts)
                items, counts = items.filter(pa.array(keep)), np.bincount(owner[keep], minlength=len(counts))
            held.append((items, counts))
            size += len(items)
            if size > BLOCK_ITEMS:
                yield from product()
                held, size = [], 0
        if held:
            yield from product()

    return blocks


def pair_counts(own: DataFrame, least: int = 1) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift) of pairs of items that share at least ``least`` baskets, item_a < item_b.

    ``own`` holds one array of distinct non-null strings per basket (``items``), empty ones are
    ignored. ``n`` counts the baskets, ``lift`` is n * n_ab / (n_a * n_b). With ``least`` above 1, items that can't reach
    it are left out by a sketch that only ever overstates an item's count: 2**20 counters, however
    many items there are, so no pair is lost. No baskets give an empty table.
    """
    spark = own.sparkSession
    own = materialise(own.where(F.size("items") > 0), "baskets")
    total = own.count()
    slots = F.transform("items", lambda x: F.pmod(F.xxhash64(x), F.lit(SKETCH)).cast("int"))
    frequent = None
    if least > 1:
        counted = own.select(F.explode(slots).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        at = F.col("slot") + 1
        maps = counted.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        frequent = bytearray(SKETCH // 8)
        for row in maps.collect():  # at most 32 rows of 4 KB
            frequent[(row.part - 1) * 4096 : row.part * 4096] = row.bits
    parts = own.select("items", slots.alias("slots")).mapInArrow(_gram(frequent and bytes(frequent)), "item_a string, item_b string, n bigint")
    gram = parts.groupBy("item_a", "item_b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= least)
    gram = materialise(gram, "gram")
    diagonal = gram.where("item_a = item_b")
    a = diagonal.select("item_a", F.col("n_ab").alias("n_a"))
    b = diagonal.select("item_b", F.col("n_ab").alias("n_b"))
    lift = F.lit(float(total)) * F.col("n_ab") / (F.col("n_a").cast("double") * F.col("n_b"))
    first = materialise(salted_lookup(gram.where("item_a < item_b"), a, "item_a"), "margins")
    pairs = salted_lookup(first, b, "item_b")
    return pairs.select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(total).alias("n"), lift.alias("lift")
    )


def associated(pairs: DataFrame, times: int = 4) -> DataFrame:
    """Pairs with n * n_ab >= times * n_a * n_b, in exact arithmetic."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.where(wide("n") * wide("n_ab") >= wide("n_a") * wide("n_b") * F.lit(times).cast("decimal(5,0)"))
