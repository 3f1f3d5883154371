"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Row numbers 0..N-1 follow from the keys alone: rows fall into `BUCKETS` by a mix of their
id, size and CRC, buckets count their rows, and a row's number is its rank in its bucket plus the sizes
of the buckets before. An alternating Feistel network over Z_a x Z_b (a = ceil(sqrt N),
b = ceil(N / a)) permutes the numbers; numbers at or above N walk their cycle until they
fall below. A row of permuted number p lies in shard p mod S at slot p div S, so shard
counts differ by one at most and both are computable from the number.

Edge cases: ids may be of any type; a null id counts as the id "null" and null texts have
size 16 and the CRC of no bytes; rows equal in id, size and CRC are interchangeable; an empty table gives
an empty result; input columns named like an added one are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 40
BUCKETS = 4096
ROUND_KEYS = (1187962331, 402653189, 1950012817, 805306457, 1610612741, 100663319)  # any numbers below the modulus
MODULUS = 2147483647
MULTIPLIER = 1103515245
MAX_WALK = 64


def _spread(value: Column, key: Column) -> Column:
    """A fixed pseudo-random map of 0..2**31-1; every product stays below 2**62."""
    x = (value + key) % MODULUS * MULTIPLIER % MODULUS
    x = (x * x + key) % MODULUS
    return x * MULTIPLIER % MODULUS


def bucket_of(row_id: Column, ties: list[Column], buckets: int = BUCKETS) -> Column:
    """The bucket of a row by its id, of any type, and by what tells rows of one id apart: neither null ids nor repeated ones meet in one bucket."""
    key = F.concat_ws(":", F.coalesce(row_id.cast("string"), F.lit("null")), *[t.cast("string") for t in ties])
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def _feistel(number: Column, a: Column, b: Column) -> Column:
    keys = F.array(*[F.lit(k).cast("long") for k in ROUND_KEYS])

    def turn(state: Column, key: Column) -> Column:
        left = (state["l"] + _spread(state["r"], key)) % a
        return F.struct(left.alias("l"), ((state["r"] + _spread(left, key + 1)) % b).alias("r"))

    start = F.struct((number % a).alias("l"), F.floor(number / a).cast("long").alias("r"))
    return F.aggregate(keys, start, turn, lambda state: state["r"] * a + state["l"])


def permuted(number: Column, total: Column) -> Column:
    """The image of `number` under a fixed permutation of 0..total-1."""
    a = F.ceil(F.sqrt(total.cast("double"))).cast("long")
    b = F.floor((total + a - 1) / a).cast("long")
    once = _feistel(number, a, b)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_WALK)), once, lambda p, _: F.when(p < total, p).otherwise(_feistel(p, a, b)))
    return F.when(once < total, once).otherwise(F.when(walked < total, walked).otherwise(F.raise_error(F.lit("cycle walk did not end"))))


def permuted_number(number: int, total: int) -> int:
    """The same permutation for one number, to look up where a row went."""
    a = math.isqrt(total - 1) + 1 if total else 1
    b = -(-total // a)

    def spread(v: int, k: int) -> int:
        x = (v + k) % MODULUS * MULTIPLIER % MODULUS
        return (x * x + k) % MODULUS * MULTIPLIER % MODULUS

    p = number
    while True:
        left, right = p % a, p // a
        for key in ROUND_KEYS:
            left = (left + spread(right, key)) % a
            right = (right + spread(left, key + 1)) % b
        if (p := right * a + left) < total:
            return p


def numbered(rows: DataFrame, id_col: str, tie_cols: list[str], buckets: int = BUCKETS) -> DataFrame:
    """`rows` with `__tw_number` 0..N-1 and `__tw_total` N.

    The bucket offsets are one small row per bucket (at most `buckets`), hence the
    broadcast; rows are sorted within buckets only.
    """
    bucket = bucket_of(F.col(id_col), [F.col(c) for c in tie_cols], buckets)
    keyed = rows.withColumn("__tw_bucket", bucket)
    counts = rows.select(bucket.alias("__tw_bucket")).groupBy("__tw_bucket").agg(F.count("*").alias("__tw_n"))
    order = Window.orderBy("__tw_bucket")
    offsets = counts.select(
        "__tw_bucket",
        F.coalesce(F.sum("__tw_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__tw_offset"),
        F.sum("__tw_n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__tw_total"),
    )
    rank = F.row_number().over(Window.partitionBy("__tw_bucket").orderBy(id_col, *tie_cols)) - 1
    ranked = keyed.withColumn("__tw_rank", rank).join(F.broadcast(offsets), "__tw_bucket")
    return ranked.withColumn("__tw_number", (F.col("__tw_rank") + F.col("__tw_offset")).cast("long")).drop("__tw_bucket", "__tw_rank", "__tw_offset")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """`docs` with `size`, `text_crc32`, `shard` and `slot`."""
    added = ["size", "text_crc32", "shard", "slot"]
    text = docs[text_col]
    sized = docs.withColumns({"__tw_size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16, "__tw_crc": F.crc32(F.coalesce(text, F.lit("")).cast("binary"))})
    placed = numbered(sized, id_col, ["__tw_size", "__tw_crc"], buckets)
    placed = placed.withColumn("__tw_p", permuted(F.col("__tw_number"), F.col("__tw_total"))).drop(*added)
    return placed.withColumns({
        "size": F.col("__tw_size"),
        "text_crc32": F.col("__tw_crc"),
        "shard": (F.col("__tw_p") % shards).cast("int"),
        "slot": F.floor(F.col("__tw_p") / shards).cast("long"),
    }).drop("__tw_size", "__tw_crc", "__tw_number", "__tw_total", "__tw_p")
