"""Whole-conversation operators: statistics, titles, texts, filters, overlays, collection totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.functions.labels import trusted
from turnweave.schema import Library


def graph_stats(lib: Library) -> DataFrame:
    """(conv_id, turns, speakers, edges, nonadjacent, typed). Edges are summed before they meet the turns."""
    per_turns = lib.turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct("speaker").alias("speakers"))
    per_edges = (
        lib.edges.where(trusted("provenance"))
        .groupBy("conv_id")
        .agg(
            F.count("*").alias("edges"),
            F.expr("count_if(abs(source - target) > 1)").alias("nonadjacent"),
            F.expr("count_if(type NOT IN ('reply', 'temporal'))").alias("typed"),
        )
    )
    return per_turns.join(per_edges, "conv_id", "left").na.fill(0, ["edges", "nonadjacent", "typed"])


def brief(lib: Library) -> DataFrame:
    """One row per conversation: id, corpus, counts and title. The first 100 characters of turn 0 stand in for no title."""
    first = lib.turns.where("pos = 0").select("conv_id", F.expr("replace(substring(text, 1, 100), '\\n', ' ')").alias("opening"))
    joined = lib.conversations.join(graph_stats(lib), "conv_id").join(first, "conv_id", "left")
    return joined.select(
        F.col("conv_id").alias("id"),
        "corpus",
        F.col("turns").alias("nturns"),
        F.col("speakers").alias("nspeakers"),
        F.col("edges").alias("nedges"),
        "nonadjacent",
        F.expr("coalesce(nullif(title, ''), opening)").alias("title"),
    )


def conversation_text(lib: Library) -> DataFrame:
    """(conv_id, text): the turns' texts in order, one per line."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return lib.turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: F.coalesce(t["text"], F.lit(""))), "\n").alias("text"))


def corpus_stats(lib: Library, windows: DataFrame) -> DataFrame:
    """Per corpus: counts, eligible conversations, episodes, upper median and maximum of the lengths."""
    per = lib.conversations.select("conv_id", "corpus").join(graph_stats(lib), "conv_id")
    # the value below which half of the lengths lie, by counts of lengths instead of a list of all of them
    lengths = per.groupBy("corpus", "turns").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(F_window("corpus", "turns"))
    median = lengths.select("corpus", "turns", upto.alias("upto"))
    totals = per.groupBy("corpus").agg(
        F.count("*").alias("conversations"),
        F.sum("turns").alias("turns"),
        F.sum("edges").alias("edges"),
        F.sum("nonadjacent").alias("nonadjacent"),
        F.expr("count_if(speakers >= 3)").alias("multiparty"),
        F.expr("count_if(turns >= 4)").alias("eligible"),
        F.max("turns").alias("max_turns"),
    )
    median = median.withColumnRenamed("turns", "length").join(totals.select("corpus", "conversations"), "corpus")
    median = median.where("upto > conversations DIV 2").groupBy("corpus").agg(F.min("length").alias("median_turns"))
    episodes = windows.groupBy("corpus").agg(F.count("*").alias("episodes"))
    return totals.join(median, "corpus").join(episodes, "corpus", "left").na.fill(0, ["episodes"])


def F_window(partition: str, order: str):  # noqa: N802
    from pyspark.sql import Window

    return Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def examples(lib: Library, limit: int = 8) -> DataFrame:
    """(corpus, place, conv_id): the first conversations of each corpus with 4 turns, 2 distant answers and 3 speakers."""
    from pyspark.sql import Window

    good = lib.conversations.join(graph_stats(lib), "conv_id").where("turns >= 4 AND nonadjacent >= 2 AND speakers >= 3")
    place = F.row_number().over(Window.partitionBy("corpus").orderBy("ordinal"))
    return good.select("corpus", place.alias("place"), "conv_id").where(F.col("place") <= limit)


def collection_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(*[F.sum(c).alias(c) for c in ("conversations", "turns", "edges", "nonadjacent", "episodes")])


def matching(lib: Library, rows: DataFrame, corpus: str = "", motif: str = "", variant_corpora: tuple[str, ...] = (), clarify_corpora: tuple[str, ...] = ()) -> DataFrame:
    """Rows of `brief` under the facets of a search: a corpus and one of delayed, group, variants, clarify."""
    if corpus:
        rows = rows.where(F.col("corpus") == corpus)
    if motif == "delayed":
        rows = rows.where("nonadjacent > 0")
    elif motif == "group":
        rows = rows.where("nspeakers >= 3")
    elif motif == "variants":
        rows = rows.where(F.col("corpus").isin(*variant_corpora))
    elif motif == "clarify":
        asked = lib.edges.where("type = 'Clarification_question'").select(F.col("conv_id").alias("id"))
        rows = rows.where(F.col("corpus").isin(*clarify_corpora)).join(asked, "id", "left_semi")
    elif motif:
        raise ValueError(f"unknown motif {motif!r}")
    return rows


def overlay(turns: DataFrame, overrides: DataFrame) -> DataFrame:
    """`turns` with the actions of `overrides` (turn, action); the source stays as it is."""
    changed = overrides.select(F.col("turn").alias("o_turn"), F.col("action").alias("o_action"))
    joined = turns.join(changed, turns["pos"] == F.col("o_turn"), "left")
    return joined.withColumn("annotation", F.when(F.col("o_turn").isNotNull(), F.lit("user-overlay")).otherwise(F.col("annotation"))).withColumn(
        "action", F.coalesce("o_action", "action")
    ).drop("o_turn", "o_action")


def evidence(lib: Library, conv_id: str) -> DataFrame:
    """(badge): the distinct annotations and provenances of a conversation."""
    of = F.col("conv_id") == conv_id
    return lib.turns.where(of).select(F.col("annotation").alias("badge")).union(lib.edges.where(of).select("provenance")).distinct()


def valid_windows(requests: DataFrame, lib: Library, most: int = 24) -> DataFrame:
    """`requests` (conv_id, start, stop) with `valid`: 1 to `most` turns inside the conversation; an unknown one is invalid."""
    n = lib.turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    inside = F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("stop")) & (F.col("stop") <= F.col("n")) & (F.col("stop") - F.col("start") <= most), F.lit(False))
    return requests.join(n, "conv_id", "left").select("conv_id", "start", "stop", inside.alias("valid"))
