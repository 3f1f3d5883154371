"""Mix sources to target weights by repeating documents.

Tokens are the words `[^\\x20\\x09-\\x0D]+`. Sources in code-point order, null last, take
the weights in turn and share `budget` times all tokens; a target stops at `ceiling` times
its source's tokens and the excess is shared again by weight until none is above. A source
of rate r = target / tokens emits each document floor(r) times plus one copy with a
probability of r - floor(r), drawn from a hash of seed, id and text.

Edge cases: null and blank texts have size 0 and follow their source's rate; a source with
no tokens has target 0 and rate 0; rows repeated with one id and text draw alike; a null id
draws as the id "null"; an empty table gives an empty result. Other columns are carried
unread. `assign_copies` replaces columns named like the ones it adds; `mix` adds none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.llm.storage import Workspace

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CEILING = 2
SEED = "mix-1"
TOKEN = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))), F.lit(0)).cast("long")


def source_rates(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, target, rate) from (source, size), as a table.

    Sources may be as many as hosts: they are numbered in code-point order by a range
    partitioning and the partitions' counts, and no task sees them all. The common level of
    target per weight rises as sources reach their ceiling; each pass is one row of sums,
    and the passes end when no further source reaches it.
    """
    space = Workspace(sizes.sparkSession, "mixing-rates")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = totals.withColumn("is_null", F.col("source").isNull()).repartitionByRange("is_null", "source").withColumn("part", F.spark_partition_id())
    placed = space.table(placed, "placed")  # the partitions' numbers stay as they are
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = placed.groupBy("part").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).select("part", "offset")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("is_null", "source")) - 1 + F.col("offset")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rated = placed.join(F.broadcast(offsets), "part").withColumn("weight", weight)  # a row a shuffle partition
    rated = space.table(rated.select("source", "source_size", "weight", (F.col("source_size") * F.lit(float(ceiling))).alias("cap")), "weighted")
    level, fixed = 0.0, -1
    while True:
        capped = F.col("cap") <= F.col("weight") * level if fixed >= 0 else F.lit(False)
        sums = [F.sum("source_size"), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight"))), F.count_if(capped)]
        total, held, free, now = rated.agg(*sums).first()
        if now == fixed or not free:
            break
        level, fixed = (total * budget - (held or 0.0)) / free, now
    target = F.least("cap", F.col("weight") * level) if free else F.col("cap")
    rated = rated.withColumn("target", target)
    return space.result(rated.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")))


def draw(id_col: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) by the id and the text alone, so that rows that share an id, or have none, draw apart."""
    seeded = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(seeded), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _copied(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, plan: dict) -> DataFrame:
    """`docs` with `__tw_size`, `__tw_source_size`, `__tw_target` and `__tw_copies`; its own columns are untouched."""
    rates = source_rates(docs.select(docs[source_col].alias("source"), size_of(docs[text_col]).alias("size")), **plan)
    # a table of known size: few sources are broadcast and the texts stay where they are; very many are joined by a shuffle
    rates = rates.withColumnsRenamed({c: f"__tw_{c}" for c in rates.columns})
    sized = docs.withColumn("__tw_size", size_of(docs[text_col]))
    joined = sized.join(rates, docs[source_col].eqNullSafe(rates["__tw_source"]), "left")
    whole = F.floor("__tw_rate")
    copies = (whole + (draw(docs[id_col], docs[text_col], seed) < F.col("__tw_rate") - whole).cast("int")).cast("int")
    return joined.withColumn("__tw_copies", copies).drop("__tw_source", "__tw_rate")


def assign_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **plan) -> DataFrame:
    """`docs` with `size`, `source_size`, `target` and `copies`."""
    added = ("size", "source_size", "target", "copies")
    kept = [f"`{c}`" for c in docs.columns if c not in added]
    return _copied(docs, id_col, text_col, source_col, seed, plan).select(*kept, *[F.col(f"__tw_{c}").alias(c) for c in added])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **plan) -> DataFrame:
    """The mixture: every document as often as its copies say, with the columns of `docs` as they are."""
    # array_repeat rather than sequence(1, n), which counts down for n = 0
    copied = _copied(docs, id_col, text_col, source_col, seed, plan)
    return copied.withColumn("__tw_copy", F.explode(F.array_repeat(F.lit(1), F.col("__tw_copies")))).select(*[f"`{c}`" for c in docs.columns])
