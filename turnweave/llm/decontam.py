"""Benchmark decontamination by n-gram windows, in DataFrame operations only.

A benchmark item's windows are its runs of `n` consecutive words; an item of fewer words,
but not none, is one window. A window's key is a hash of its length and four of its words,
the first and the last among them. The keys' hash set is broadcast as a bit table of fixed
size (`sieve`), so the plan is the same for any number of windows; the few document windows
that pass it meet the keys in an exact join, and each of these hits is verified by
comparing all its words with the window's. A word inside any verified hit is hit.

Edge cases: null and wordless texts have no windows and no hits; equal windows of several
items count for each; a null item id is dropped from item lists, and ids that repeat count
once; documents repeated with the same id and text each keep their row; an empty table, of
documents or of items, gives no hits; other columns are carried unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm.rowkeys import HASH, ID, with_key
from turnweave.llm.sieve import marked, sieve, sifted
from turnweave.llm.sqlwords import WORD, let, word_count, words
from turnweave.llm.storage import Workspace, materialise

N = 10


def _key(w: Column, start: Column, length: int) -> Column:
    """Hash of the run of `length` words from `start` (0-based) by its length and up to four of its words."""
    last = length - 1
    return F.xxhash64(F.lit(length), *[F.get(w, start + at) for at in sorted({0, last // 3, 2 * last // 3, last})])


def _runs(w: Column, length: int) -> Column:
    """Array of (pos, len, key) of every run of `length` words; none if there are fewer."""
    run = lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), _key(w, i, length).alias("key"))
    return F.when(F.size(w) >= length, F.transform(F.sequence(F.lit(0), F.size(w) - length), run)).otherwise(F.array().cast("array<struct<pos:int,len:int,key:bigint>>"))


def _whole(w: Column, pos: Column, length: Column) -> Column:
    return F.array_join(F.slice(w, pos + 1, length), " ")


def item_windows(items: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, window, len, items): the distinct windows with the ids of the items that hold them."""
    worded = items.select(items[id_col].cast("string").alias("item"), words(items[text_col]).alias("w"))
    of_size = F.when(F.size("w") >= n, _runs(F.col("w"), n))
    for k in range(1, n):
        of_size = of_size.when(F.size("w") == k, _runs(F.col("w"), k))
    every = worded.select("item", "w", F.explode(of_size).alias("x")).select("item", "x.key", "x.len", _whole(F.col("w"), F.col("x.pos"), F.col("x.len")).alias("window"))
    return every.groupBy("key", "window", "len").agg(F.sort_array(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, items: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key, `runs` (sorted pairs of first word and end) and `items` of every contaminated document."""
    space = Workspace(docs.sparkSession, "decontam-hits")
    windows = space.table(item_windows(items, n), "windows")
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect()) or [n]  # at most n rows
    probes = let(words(docs[text_col]), lambda w: F.concat(*[_runs(w, length) for length in lengths]) if len(lengths) > 1 else _runs(w, lengths[0]))
    probed = docs.select(*with_key(docs, id_col, text_col), F.inline(probes))
    met = sifted(probed, "key", space.table(sieve(windows, "key"), "keys")).join(windows, ["key", "len"])
    met = met.groupBy(ID, HASH).agg(F.collect_set(F.struct("pos", "len", "window", "items")).alias("met"))
    met = space.table(met.withColumnsRenamed({ID: "__tw_mid", HASH: "__tw_mhash"}), "met")
    texts = sifted(docs.select(*with_key(docs, id_col, text_col), docs[text_col].alias("__tw_text")), HASH, space.table(sieve(met, "__tw_mhash"), "met-texts"))
    texts = texts.join(met, (F.col(HASH) == F.col("__tw_mhash")) & F.col(ID).eqNullSafe(F.col("__tw_mid")))
    true = let(words(F.col("__tw_text")), lambda w: F.filter("met", lambda m: _whole(w, m["pos"], m["len"]) == m["window"]))
    found = texts.select(ID, HASH, true.alias("met")).where("size(met) > 0").select(
        ID, HASH,
        F.sort_array(F.array_distinct(F.transform("met", lambda m: F.struct(m["pos"].alias("pos"), (m["pos"] + m["len"]).alias("end"))))).alias("runs"),
        F.array_distinct(F.flatten(F.transform("met", lambda m: m["items"]))).alias("items"),
    ).dropDuplicates([ID, HASH])
    return space.result(found)


def covered(runs: Column) -> Column:
    """Number of words under sorted runs."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, r: F.struct(
        F.greatest(acc["end"], r["end"]).alias("end"),
        (acc["n"] + F.greatest(r["end"] - F.greatest(r["pos"], acc["end"]), F.lit(0))).alias("n"),
    )
    return F.aggregate(runs, zero, step, lambda acc: acc["n"])


def mark(docs: DataFrame, items: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `__tw_runs` and `__tw_items` (null where clean). Only texts that may have hits, by a bit table, enter the join."""
    found = hits(docs, items, n, id_col, text_col).withColumnsRenamed({ID: "__tw_fid", HASH: "__tw_fhash", "runs": "__tw_runs", "items": "__tw_items"})
    keyed = marked(docs.select("*", *with_key(docs, id_col, text_col)), HASH, materialise(sieve(found, "__tw_fhash"), "decontam-sieve"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("__tw_runs", "__tw_items")]
    clean = keyed.where("NOT __tw_met").select(*columns, *none)
    joined = keyed.where("__tw_met").join(found, (F.col(HASH) == F.col("__tw_fhash")) & F.col(ID).eqNullSafe(F.col("__tw_fid")), "left")
    return clean.unionByName(joined.select(*columns, "__tw_runs", "__tw_items"))


def report(docs: DataFrame, items: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: key, `n_words`, `runs`, `items`. Texts are counted where they are read and not shuffled."""
    found = hits(docs, items, n, id_col, text_col).withColumnsRenamed({ID: "__tw_fid", HASH: "__tw_fhash"})
    base = docs.select(*with_key(docs, id_col, text_col), word_count(docs[text_col]).alias("n_words"))
    joined = base.join(found, (base[HASH] == found["__tw_fhash"]) & base[ID].eqNullSafe(found["__tw_fid"]), "left")
    return joined.select(ID, HASH, "n_words", "runs", "items")


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """`docs` without contaminated documents, or (`remove="spans"`) without their hit words."""
    marked = mark(docs, items, text_col=text_col, **options)
    if remove == "documents":
        return marked.where("__tw_runs is null").select(*docs.columns)
    text = F.col(text_col)
    gaps, inner = F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    hit = F.array_distinct(F.flatten(F.transform("__tw_runs", lambda r: F.sequence(r["pos"], r["end"] - 1))))
    parts = F.struct(gaps.alias("gaps"), inner.alias("words"), hit.alias("hit"))

    def rebuilt(p: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(p["words"]) - 1), p["hit"])
        kept = F.transform(left, lambda i: F.concat(F.get(p["gaps"], i), F.get(p["words"], i)))
        return F.concat(F.array_join(kept, ""), F.element_at(p["gaps"], -1))

    cut = F.when(F.col("__tw_runs").isNull(), text).otherwise(let(parts, rebuilt))
    return marked.withColumn(text_col, cut).select(*docs.columns)
