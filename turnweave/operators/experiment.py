"""The retrieval experiment end to end: known-answer motif queries, three rankings, metrics and controls.

Training conversations are the pool. A query is one motif of a test conversation, as an
episode of three turns; a training conversation is relevant if it holds the same motif.
`tfidf` ranks by text; `sequence` and `graph` align a shortlist by BM25 over motif tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.labels import trusted
from turnweave.operators import align, bm25, episodes, evaluate, motifs
from turnweave.operators.sinks import staged
from turnweave.schema import Library

METHODS = ("tfidf", "sequence", "graph")
METRICS = ("p5", "p10", "success10", "rr10")
SHORTLIST, DEPTH, QUERIES = 120, 10, 200
LEAST, MOST = 2, 100
WORD = r"[\p{L}\p{N}_]{2,}"


@dataclass(frozen=True)
class Experiment:
    split: DataFrame  # (conv_id, split, ordinal) of what families and exact copies leave
    queries: DataFrame  # (query, key, turns, edges, trusted, tokens)
    positives: DataFrame  # (query, doc)
    shortlist: DataFrame  # (query, doc, place)
    rankings: DataFrame  # (method, query, doc, rank, relevant)
    per_query: DataFrame  # (query, key, positives, candidates, candidate_hits, <method>_<metric>)


def given_split(lib: Library) -> DataFrame:
    """(conv_id, split, ordinal) of the conversations whose metadata name a training or a test split."""
    rows = lib.conversations.select("conv_id", F.col("meta")["split"].alias("split"), "ordinal")
    return rows.where("split IN ('train', 'test')")


def cleaned_split(lib: Library, split: DataFrame) -> DataFrame:
    """`split` with one conversation of each family, training first, and no test conversation that equals a training one."""
    turns = lib.turns.join(split.select("conv_id"), "conv_id", "left_semi")
    kept = split.join(motifs.family_filter(turns, split).where("kept").select("conv_id"), "conv_id", "left_semi")
    kept = staged(kept)
    apart = motifs.drop_exact_duplicates(turns, kept)
    return staged(kept.where("split = 'train'").unionByName(kept.join(apart, "conv_id", "left_semi").where("split = 'test'")))


def query_episodes(lib: Library, asked: DataFrame, found: DataFrame) -> DataFrame:
    """The motifs `asked` (conv_id, key) as episodes of three turns and two edges."""
    rows = asked.join(found, ["conv_id", "key"])
    place = "cast(array_position(nodes, {0}) - 1 AS INT)"
    turns = rows.join(lib.turns, "conv_id").where("array_contains(nodes, pos)").groupBy("conv_id")
    turn = f"struct({place.format('pos')} AS i, pos, speaker, action, annotation, coalesce(text, '') AS text)"
    turns = turns.agg(F.array_sort(F.collect_list(F.expr(turn))).alias("turns"))
    edges = rows.join(lib.edges, "conv_id").where("ord IN (at.a_ord, at.b_ord)").groupBy("conv_id")
    edge = f"struct(ord, {place.format('source')} AS source, {place.format('target')} AS target, type, provenance)"
    edges = edges.agg(F.array_sort(F.collect_list(F.expr(edge))).alias("edges"))
    whole = rows.select("conv_id", "key").join(turns, "conv_id").join(edges, "conv_id")
    whole = episodes.canonical(whole).withColumn("trusted", F.expr(f"filter(edges, e -> {trusted('e.provenance')})"))
    return episodes.with_tokens(whole).withColumnRenamed("conv_id", "query")


def _text_ranking(pool: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, doc, score, ordinal) by tf-idf; documents without a common term follow in their order."""
    words = F.regexp_extract_all(F.lower(F.array_join(F.transform("turns", lambda t: t["text"]), " ")), F.lit(WORD), F.lit(0)).alias("words")
    scored = bm25.tfidf(pool.select(F.col("doc").alias("id"), words), queries.select(F.col("query").alias("id"), words))
    scored = scored.join(pool.select("doc", "ordinal"), "doc")
    rest = pool.select("doc", "ordinal").orderBy("ordinal", "doc").limit(DEPTH)
    rest = queries.select("query").crossJoin(F.broadcast(rest))  # DEPTH rows
    rest = rest.join(scored.select("query", "doc"), ["query", "doc"], "left_anti").select("query", "doc", F.lit(0.0).alias("score"), "ordinal")
    return scored.select("query", "doc", "score", "ordinal").unionByName(rest)


def run(lib: Library, split: DataFrame | None = None, queries: int = QUERIES, shortlist: int = SHORTLIST, seed: int = motifs.SEED) -> Experiment:
    """The experiment over `lib`; `split` is (conv_id, split, ordinal) with train and test, or comes from the metadata."""
    split = cleaned_split(lib, given_split(lib) if split is None else split)
    train = split.where("split = 'train'").select(F.col("conv_id").alias("doc"), "ordinal")
    found = staged(motifs.motifs(Library(*(t.join(split.select("conv_id"), "conv_id", "left_semi") for t in (lib.conversations, lib.turns, lib.edges)))))
    held = found.join(train, found["conv_id"] == train["doc"], "left_semi").select("conv_id", "key")
    tested = found.join(train, found["conv_id"] == train["doc"], "left_anti")
    asked = motifs.motif_queries(tested, motifs.motif_index(held), LEAST, MOST, queries, seed)
    asked = staged(query_episodes(lib, asked, found))
    positives = staged(held.withColumnRenamed("conv_id", "doc").join(asked.select("query", "key"), "key").select("query", "doc"))

    whole = episodes.whole_conversations(lib).drop("ordinal").withColumnRenamed("conv_id", "doc").join(train, "doc")
    pool = staged(episodes.with_tokens(whole).select("doc", "ordinal", "turns", "trusted", "tokens"))
    terms = asked.select("query", F.explode(F.array_distinct("tokens")).alias("term"))
    near = bm25.score(pool, terms).join(pool.select("doc", "ordinal"), "doc")
    by_rank = Window.partitionBy("query").orderBy(F.desc(F.round("score", 6)), "ordinal", "doc")
    short = staged(near.withColumn("place", F.row_number().over(by_rank)).where(F.col("place") <= shortlist).select("query", "doc", "ordinal", "place"))

    left = asked.select("query", F.col("turns").alias("q_turns"), F.col("trusted").alias("q_trusted"))
    pairs = short.join(pool.select("doc", F.col("turns").alias("c_turns"), F.col("trusted").alias("c_trusted")), "doc").join(left, "query")
    scored = {m: align.aligned(pairs, m == "graph", ("query", "doc", "ordinal")).select("query", "doc", "score", "ordinal") for m in ("sequence", "graph")}
    scored["tfidf"] = _text_ranking(pool, asked)
    every = None
    for m in METHODS:
        rows = scored[m].select(F.lit(m).alias("method"), "query", "doc", F.round("score", 9).alias("score"), "ordinal")
        every = rows if every is None else every.unionByName(rows)
    order = Window.partitionBy("method", "query").orderBy(F.desc("score"), "ordinal", "doc")
    every = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DEPTH)
    right = positives.withColumn("relevant", F.lit(True))
    rankings = staged(every.join(right, ["query", "doc"], "left").select("method", "query", "doc", "rank", F.coalesce("relevant", F.lit(False)).alias("relevant")))

    out = asked.select("query", "key").join(positives.groupBy("query").agg(F.count("*").alias("positives")), "query", "left")
    hits = short.join(right, ["query", "doc"], "left").groupBy("query").agg(F.count("*").alias("candidates"), F.count("relevant").alias("candidate_hits"))
    out = out.join(hits, "query", "left")
    for m in METHODS:
        own = evaluate.ir_metrics(rankings.where(F.col("method") == m))
        out = out.join(own.withColumnsRenamed({x: f"{m}_{x}" for x in METRICS}), "query", "left")
    numbers = ["positives", "candidates", "candidate_hits", *[f"{m}_{x}" for m in METHODS for x in METRICS]]
    return Experiment(split, asked, positives, short, rankings, staged(out.na.fill(0, numbers)))


def report(experiment: Experiment, draws: int = 2000) -> DataFrame:
    """(name, mean, low, high): every method's metrics, the paired gain of graph over sequence, the shortlist's success and recall, and the ceiling."""
    rows = experiment.per_query.withColumn("id", F.col("query")).withColumns({
        "graph_minus_sequence_p5": F.col("graph_p5") - F.col("sequence_p5"),
        "shortlist_success": (F.col("candidate_hits") > 0).cast("double"),
        "shortlist_recall": F.col("candidate_hits") / F.col("positives"),
        "ceiling_p5": F.least(F.lit(5), F.col("positives")) / 5,
    })
    out = None
    for name in [*[f"{m}_{x}" for m in METHODS for x in METRICS], "graph_minus_sequence_p5", "shortlist_success", "shortlist_recall", "ceiling_p5"]:
        one = evaluate.bootstrap(rows, name, draws).select(F.lit(name).alias("name"), "mean", "low", "high")
        out = one if out is None else out.union(one)
    return out


def rewiring(rows: DataFrame) -> DataFrame:
    """(n, preferred, ties) of episodes or whole conversations against themselves with one edge re-routed: how often the graph score prefers the original, and the sequence score cannot tell."""
    moved = motifs.rewired(rows)
    left = moved.select("conv_id", "start", F.col("turns").alias("q_turns"), F.col("trusted").alias("q_trusted"), F.col("turns").alias("c_turns"), "trusted", "rewired")
    margins = None
    for graph in (True, False):
        own = align.aligned(left.withColumnRenamed("trusted", "c_trusted"), graph, ("conv_id", "start")).select("conv_id", "start", F.col("score").alias("own"))
        other = align.aligned(left.withColumnRenamed("rewired", "c_trusted"), graph, ("conv_id", "start")).select("conv_id", "start", F.col("score").alias("other"))
        margin = own.join(other, ["conv_id", "start"]).select("conv_id", "start", (F.col("own") - F.col("other")).alias("graph" if graph else "sequence"))
        margins = margin if margins is None else margins.join(margin, ["conv_id", "start"])
    return margins.agg(F.count("*").alias("n"), F.avg((F.col("graph") > 1e-9).cast("double")).alias("preferred"), F.avg((F.abs("sequence") < 1e-9).cast("double")).alias("ties"))
