"""A Bloom filter as a small table: 64-bit words in blocks of 1,024, four bits of one word per key.

Built by a map-side combined ``bit_or`` and probed by a broadcast join on the number of the block,
inside generated code. The number of words has a fixed upper bound, so the broadcast has a proven
one too: past it the filter lets more keys through, and the exact check that follows has more to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**22 words of 64 bits: 32 MB in 4,096 rows.
MOST_WORDS = 1 << 22
_BLOCK = 1 << 10


def words_for(keys: int) -> int:
    """A power of two with about 16 bits per key, between 2**10 and ``MOST_WORDS``."""
    return min(MOST_WORDS, max(_BLOCK, 1 << max(0, (max(1, keys) // 4 - 1)).bit_length()))


def _word(key: str, words: int):
    return F.expr(f"xxhash64({key}) & {words - 1}L")


def _mask(key: str):
    bit = lambda k: f"shiftleft(1L, cast((shiftright(xxhash64({key}, 7), {6 * k}) & 63) as int))"
    return F.expr(" | ".join(bit(k) for k in range(4)))


def build(keys: DataFrame, key: str, words: int) -> DataFrame:
    """(_block, _words): the filter over the non-null values of column ``key``; words without a key are 0."""
    own = keys.where(F.col(key).isNotNull()).select(_word(key, words).alias("_word"), _mask(key).alias("_mask"))
    every = keys.sparkSession.range(words).select(F.col("id").alias("_word"), F.lit(0).cast("bigint").alias("_mask"))
    filled = own.groupBy("_word").agg(F.bit_or("_mask").alias("_mask")).unionByName(every).groupBy("_word").agg(F.bit_or("_mask").alias("_mask"))
    ordered = F.sort_array(F.collect_list(F.struct("_word", "_mask")))
    blocks = filled.groupBy(F.shiftright("_word", 10).alias("_block")).agg(ordered.alias("_list"))
    return blocks.select("_block", F.transform("_list", lambda x: x["_mask"]).alias("_words"))


def probe(rows: DataFrame, key: str, bloom: DataFrame, words: int, flag: str = "maybe") -> DataFrame:
    """``rows`` with ``flag``: false where no key of the filter can equal ``key``; a null key is false."""
    asked = rows.withColumn("_word", _word(key, words)).withColumn("_block", F.shiftright("_word", 10))
    known = asked.join(F.broadcast(bloom), "_block", "left")
    bits, mask = F.get("_words", F.col("_word").bitwiseAND(F.lit(_BLOCK - 1)).cast("int")), _mask(key)
    hit = (bits.bitwiseAND(mask) == mask) & F.col(key).isNotNull()
    return known.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_word", "_block", "_words")
