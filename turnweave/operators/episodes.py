"""Episodes: overlapping windows of turns with the edges inside them, and their token bags.

An episode is one row with its turns and edges nested. Windows hold at most `width` turns,
so the nested arrays are small, and everything about one episode afterwards is an
expression over its row, without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.labels import clean_label, trusted
from turnweave.schema import LEAST_TURNS, MAX_WINDOWS, STRIDE, WIDTH, Library

BUCKET = 4096


def windows(lib: Library, width: int = WIDTH, stride: int = STRIDE, limit: int = MAX_WINDOWS, least: int = LEAST_TURNS) -> DataFrame:
    """(conv_id, corpus, corpus_ord, ordinal, start, stop) of every episode; conversations under `least` turns have none."""
    n = lib.turns.groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    starts = f"explode(CASE WHEN n >= {least} THEN slice(sequence(0, n - {least}, {stride}), 1, {limit}) ELSE cast(array() AS ARRAY<INT>) END)"
    rows = lib.conversations.join(n, "conv_id").select("conv_id", "corpus", "corpus_ord", "ordinal", "n", F.expr(starts).alias("start"))
    return rows.select("conv_id", "corpus", "corpus_ord", "ordinal", "start", F.expr(f"least(start + {width}, n)").alias("stop"))


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` with a dense `episode_id` from 1 by (corpus_ord, ordinal, start).

    Ranks within blocks of conversations plus the sizes of the blocks before; the only
    window over everything has one row per block.
    """
    block = F.expr(f"ordinal DIV {BUCKET}")
    counts = rows.groupBy("corpus_ord", block.alias("block")).agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("corpus_ord", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("corpus_ord", "block", before.alias("offset"))
    rank = F.row_number().over(Window.partitionBy("corpus_ord", "block").orderBy("ordinal", "start"))
    ranked = rows.withColumn("block", block).withColumn("rank", rank).join(offsets, ["corpus_ord", "block"])
    return ranked.withColumn("episode_id", (F.col("rank") + F.col("offset")).cast("long")).drop("block", "rank", "offset")


def with_content(episodes: DataFrame, lib: Library, width: int = WIDTH, stride: int = STRIDE) -> DataFrame:
    """`episodes` on the window grid with `turns`, `edges` (rebased) and `external_edges` (absolute) nested.

    A turn lies in the windows that start at the multiples of `stride` up to `width` before
    it, so turns and edges find their windows by an equi-join. An edge belongs to the
    windows of its source.
    """
    reach = f"filter(transform(sequence(0, {-(-width // stride)} - 1), k -> cast({{p}} DIV {stride} * {stride} - k * {stride} AS INT)), s -> s >= 0 AND s > {{p}} - {width})"
    keys = episodes.select("conv_id", "start", "stop")
    placed = lib.turns.select("*", F.explode(F.expr(reach.format(p="pos"))).alias("start")).join(keys, ["conv_id", "start"]).where("pos < stop")
    turn = F.expr("struct(pos - start AS i, pos, speaker, action, annotation, coalesce(text, '') AS text)")
    turns = placed.groupBy("conv_id", "start").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    tied = lib.edges.select("*", F.explode(F.expr(reach.format(p="source"))).alias("start")).join(keys, ["conv_id", "start"]).where("source < stop")
    inside = "target >= start AND target < stop"
    edges = tied.groupBy("conv_id", "start").agg(
        F.array_sort(F.collect_list(F.expr(f"CASE WHEN {inside} THEN struct(ord, source - start AS source, target - start AS target, type, provenance) END"))).alias("edges"),
        F.array_sort(F.collect_list(F.expr(f"CASE WHEN NOT ({inside}) THEN struct(ord, source, target, type, provenance) END"))).alias("external_edges"),
    )
    none = F.array().cast(EDGES)
    joined = episodes.join(turns, ["conv_id", "start"]).join(edges, ["conv_id", "start"], "left")
    joined = joined.withColumn("edges", F.coalesce("edges", none)).withColumn("external_edges", F.coalesce("external_edges", none))
    return canonical(joined).withColumn("trusted", F.expr(f"filter(edges, e -> {trusted('e.provenance')})"))


def canonical(episodes: DataFrame) -> DataFrame:
    """Speakers renamed S1, S2, ... by first appearance in the slice."""
    known = "array_distinct(transform(turns, x -> x.speaker))"
    renamed = "transform(turns, t -> struct(t.i, t.pos, concat('S', array_position(known, t.speaker)) AS speaker, t.action, t.annotation, t.text))"
    return episodes.withColumn("known", F.expr(known)).withColumn("turns", F.expr(renamed)).drop("known")


EDGES = "array<struct<ord:int,source:int,target:int,type:string,provenance:string>>"


def whole_conversations(lib: Library) -> DataFrame:
    """Every conversation as one episode row from its first turn to its last."""
    turns = lib.turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.expr("struct(pos AS i, pos, speaker, action, annotation, coalesce(text, '') AS text)"))).alias("turns"))
    edges = lib.edges.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.expr("struct(ord, source, target, type, provenance)"))).alias("edges"))
    rows = lib.conversations.select("conv_id", "corpus", "ordinal", F.lit(0).alias("start")).join(turns, "conv_id").join(edges, "conv_id", "left")
    rows = rows.withColumn("edges", F.coalesce("edges", F.array().cast(EDGES))).withColumn("stop", F.size("turns"))
    return canonical(rows).withColumn("trusted", F.expr(f"filter(edges, e -> {trusted('e.provenance')})"))


def slice_conversation(lib: Library, conv_id: str, start: int, stop: int, turns: DataFrame | None = None) -> DataFrame:
    """One episode row for any bounds of one conversation; `stop` is cut to its length.

    An empty or negative range is an error; a start past the end gives no row.
    """
    if not 0 <= start < stop:
        raise ValueError(f"no turns in {start}..{stop}")
    bounds = lib.conversations.where(F.col("conv_id") == conv_id).select("conv_id", "corpus", F.lit(start).alias("start"), F.lit(stop).alias("stop"))
    source = lib.turns if turns is None else turns
    t = source.where(F.col("conv_id") == conv_id).where(f"pos >= {start} AND pos < {stop}")
    e = lib.edges.where(F.col("conv_id") == conv_id).where(f"source >= {start} AND source < {stop}")
    turn = F.expr(f"struct(pos - {start} AS i, pos, speaker, action, annotation, coalesce(text, '') AS text)")
    inside = f"target >= {start} AND target < {stop}"
    turns_row = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    edges_row = e.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.expr(f"CASE WHEN {inside} THEN struct(ord, source - {start} AS source, target - {start} AS target, type, provenance) END"))).alias("edges"),
        F.array_sort(F.collect_list(F.expr(f"CASE WHEN NOT ({inside}) THEN struct(ord, source, target, type, provenance) END"))).alias("external_edges"),
    )
    none = F.array().cast(EDGES)
    joined = bounds.join(turns_row, "conv_id").join(edges_row, "conv_id", "left")
    joined = joined.withColumn("edges", F.coalesce("edges", none)).withColumn("external_edges", F.coalesce("external_edges", none))
    joined = joined.withColumn("stop", F.expr("start + size(turns)"))
    return canonical(joined).withColumn("trusted", F.expr(f"filter(edges, e -> {trusted('e.provenance')})"))


# --- Expressions over an episode row -----------------------------------------------------

SIGNATURE = "array_join(transform(turns, t -> t.action), ' → ')"
CLEANED = f"transform(turns, t -> {clean_label('t.action')})"
A_TOKENS = f"transform({CLEANED}, a -> concat('a_', a))"
B_TOKENS = "transform(slice(cleaned, 1, size(cleaned) - 1), (a, i) -> concat('b_', a, '_', cleaned[i + 1]))"
S_TOKENS = "transform(slice(turns, 1, size(turns) - 1), (t, i) -> CASE WHEN t.speaker = turns[i + 1].speaker THEN 's_same' ELSE 's_different' END)"
E_TOKENS = (
    f"transform(trusted, e -> concat('e_', {clean_label('e.type')}, CASE WHEN abs(e.source - e.target) = 1 THEN '_near' ELSE '_delayed' END, "
    "CASE WHEN turns[e.source].speaker = turns[e.target].speaker THEN '_same' ELSE '_different' END))"
)


def with_tokens(episodes: DataFrame) -> DataFrame:
    """`episodes` with `tokens`, the bag a, b, s, e in this order, duplicates kept."""
    return episodes.withColumn("cleaned", F.expr(CLEANED)).withColumn("tokens", F.expr(f"concat({A_TOKENS}, {B_TOKENS}, {S_TOKENS}, {E_TOKENS})")).drop("cleaned")
