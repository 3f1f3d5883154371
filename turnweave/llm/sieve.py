"""A bit table of fixed size that tells which rows can have a partner, before anything heavy is shuffled.

One bit for each of `BITS` classes of a 64-bit hash, as (word, mask) rows: at most
`BITS` / 64 rows of two numbers, whatever the input, so the table may be broadcast. A row
whose bit is not set has no partner; one whose bit is set goes to an exact join. With very
many hashes most bits are set, and everything goes to the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25
WORD, MASK = "__tw_word", "__tw_mask"


def _place(key: Column) -> Column:
    return F.pmod(key, F.lit(BITS))


def sieve(rows: DataFrame, key: str) -> DataFrame:
    """The bits of all `key` (long) of `rows`. A null key sets none."""
    place = _place(F.col(key))
    words = rows.where(F.col(key).isNotNull()).select(F.shiftright(place, 6).alias(WORD), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit"))
    return words.groupBy(WORD).agg(F.bit_or("bit").alias(MASK))


def marked(rows: DataFrame, key: str, bits: DataFrame, found: str = "__tw_met") -> DataFrame:
    """`rows` with the boolean `found`: whether the bit of `key` is set in the table `bits`."""
    word = F.shiftright(_place(F.col(key)), 6)
    joined = rows.join(F.broadcast(bits), word == F.col(WORD), "left")  # at most BITS / 64 rows
    bit = F.call_function("shiftright", F.col(MASK), (_place(F.col(key)) % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return joined.withColumn(found, F.coalesce(bit == 1, F.lit(False))).drop(WORD, MASK)


def sifted(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """The rows whose bit is set."""
    return marked(rows, key, bits).where("__tw_met").drop("__tw_met")
