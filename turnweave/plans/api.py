"""The service's routes as functions: each takes a `Collection` and returns a DataFrame, or raises.

ValueError stands for an invalid request and LookupError for a missing thing.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnweave.functions.labels import plain, terms
from turnweave.operators import align, atlas, bm25, conversations, describe, episodes
from turnweave.operators.sinks import staged
from turnweave.schema import FIELDS, MAX_WINDOWS, STRIDE, VERSION, WIDTH, Library

CANDIDATES = 120
MAX_SELECTED = 24
PLACES = 6  # of ranks, so that equal bags tie whatever the order of summation


@dataclass
class Collection:
    """A library with its derived tables, each built once on first use and staged."""

    library: Library
    variant_corpora: tuple[str, ...] = ("prism", "synthetic_variants")
    clarify_corpora: tuple[str, ...] = ("molweni", "synthetic")
    variants: DataFrame | None = None
    names: dict[str, str] = field(default_factory=dict)
    built: str = field(default_factory=lambda: datetime.now(UTC).isoformat(timespec="seconds"))

    @cached_property
    def episodes(self) -> DataFrame:
        rows = episodes.numbered(episodes.windows(self.library))
        return staged(episodes.with_tokens(episodes.with_content(rows, self.library)))

    @cached_property
    def described(self) -> DataFrame:
        return staged(describe.described(self.episodes).drop("turns", "edges", "external_edges", "trusted", "tokens"))

    @cached_property
    def atlas(self) -> tuple[DataFrame, atlas.Projection]:
        rows, projection = atlas.build(self.described)
        return staged(rows), projection

    @cached_property
    def brief(self) -> DataFrame:
        return staged(conversations.brief(self.library))

    @cached_property
    def text_index(self) -> tuple[DataFrame, DataFrame]:
        """Postings of the conversations' terms, sorted by term, and their totals."""
        text = conversations.conversation_text(self.library)
        docs = text.select(F.col("conv_id").alias("doc"), F.expr(terms("text")).alias("tokens"))
        return staged(bm25.sorted_postings(docs)), staged(bm25.collection(docs, "tokens"))

    @cached_property
    def motif_index(self) -> tuple[DataFrame, DataFrame]:
        """Postings of the episodes' tokens, sorted by token, and their totals."""
        docs = self.episodes.select(F.col("episode_id").alias("doc"), "tokens")
        return staged(bm25.sorted_postings(docs)), staged(bm25.collection(docs, "tokens"))


def _one(df: DataFrame, what: str) -> DataFrame:
    if not df.limit(1).count():
        raise LookupError(f"{what} not found")
    return df


def _asked(c: Collection, index: tuple[DataFrame, DataFrame], words: list[str]) -> DataFrame:
    """(doc, score): BM25 of one query over an index; the filter on its terms is pushed into the scan."""
    held, totals = index
    query = c.library.turns.sparkSession.createDataFrame([(0, w) for w in dict.fromkeys(words)], "query int, term string")
    return bm25.score_postings(held.where(F.col("token").isin(*words)), totals, query).select("doc", F.round("score", PLACES).alias("score"))


def stats(c: Collection) -> DataFrame:
    """Per corpus: counts, its name and the ids of up to eight conversations to open first."""
    counts = conversations.corpus_stats(c.library, c.episodes.select("corpus"))
    listed = F.array_sort(F.collect_list(F.struct("place", "conv_id")))  # eight a corpus
    first = conversations.examples(c.library).groupBy("corpus").agg(listed.alias("e")).select("corpus", F.transform("e", lambda x: x["conv_id"]).alias("example_ids"))
    named = counts.join(first, "corpus", "left").withColumn("example_ids", F.coalesce("example_ids", F.array().cast("array<string>")))
    names = F.create_map(*[F.lit(x) for kv in sorted(c.names.items()) for x in kv]) if c.names else F.create_map().cast("map<string,string>")
    return named.withColumn("name", F.coalesce(F.try_element_at(names, F.col("corpus")), "corpus"))


def build_record(c: Collection) -> DataFrame:
    """One row: how the collection's episodes were cut and under which version of the tables."""
    spark = c.library.turns.sparkSession
    return spark.range(1).select(F.lit(WIDTH).alias("window"), F.lit(STRIDE).alias("stride"), F.lit(MAX_WINDOWS).alias("max_windows"), F.lit(VERSION).alias("tables"), F.lit(c.built).alias("created"))


def search(c: Collection, q: str = "", corpus: str = "", motif: str = "", limit: int = 24) -> DataFrame:
    """Conversations by text rank, or without a query those of four turns and more, under facets."""
    if not 1 <= limit <= 60:
        raise ValueError("limit must be between 1 and 60")
    rows = conversations.matching(c.library, c.brief, corpus, motif, c.variant_corpora, c.clarify_corpora)
    words = [plain(t) for t in bm25.safe_terms(q)]
    if not words:
        return rows.where("nturns >= 4").orderBy("id").limit(limit)
    ranked = _asked(c, c.text_index, words).withColumnRenamed("doc", "id")
    return rows.join(ranked, "id").orderBy(F.desc("score"), "id").limit(limit)


def conversation(c: Collection, conv_id: str) -> DataFrame:
    """One row: the conversation with its metadata, turns, edges and reply variants nested in order."""
    mine = F.col("conv_id") == conv_id
    head = _one(c.library.conversations.where(mine), "conversation")

    def nested(rows: DataFrame, name: str, first: list[str]) -> DataFrame:
        columns = [*first, *[x for x in rows.columns if x not in (*first, "conv_id")]]
        return rows.where(mine).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))  # one conversation's rows

    out = head.crossJoin(nested(c.library.turns, "turns", ["pos"])).crossJoin(nested(c.library.edges, "edges", ["ord"]))
    if c.variants is not None:
        out = out.crossJoin(nested(c.variants, "variants", ["round", "at"]))
    return out.drop("corpus_ord")


def match(
    c: Collection, conv_id: str, start: int = 0, stop: int | None = None, corpus: str = "", graph: bool = True, overrides: dict[int, str] | None = None, limit: int = 8, mode: str = "exact"
) -> DataFrame:
    """Episodes of other conversations most like turns [start, stop) of one, one per conversation.

    The shortlist is the best 120 episodes by BM25 over motif tokens; only they are joined
    with their content and aligned. Each row holds the found episode's turns and edges as
    `episode`, the asked one as `query`, and how many `candidates` were aligned.
    """
    if not 1 <= limit <= 20:
        raise ValueError("limit must be between 1 and 20")
    overrides = overrides or {}
    if len(overrides) > 50 or any(not 1 <= len(a) <= 40 for a in overrides.values()):
        raise ValueError("at most 50 overrides of 1 to 40 characters")
    lib = c.library
    spark: SparkSession = lib.turns.sparkSession
    turns = lib.turns.where(F.col("conv_id") == conv_id)
    n = _one(turns, "conversation").count()
    stop = min(start + 12, n) if stop is None else stop
    if not 0 <= start < stop <= n or stop - start > MAX_SELECTED:
        raise ValueError(f"turns {start}..{stop} are not 1 to {MAX_SELECTED} turns of this conversation of {n}")
    if any(not 0 <= t < n for t in overrides):
        raise ValueError(f"an override names a turn that is not among the {n} of this conversation")
    if overrides:
        turns = conversations.overlay(turns, spark.createDataFrame(list(overrides.items()), "turn int, action string"))
    query = staged(episodes.with_tokens(episodes.slice_conversation(lib, conv_id, start, stop, turns)))
    tokens = query.select("tokens").first()["tokens"]  # of 24 turns at most
    if mode == "phrase":
        ranked = bm25.score_phrases(c.episodes.select(F.col("episode_id").alias("doc"), "tokens"), tokens).select("doc", F.round("score", PLACES).alias("score"))
    else:
        ranked = _asked(c, c.motif_index, list(dict.fromkeys(tokens)))
    keys = c.episodes.select(F.col("episode_id").alias("doc"), "conv_id", "corpus").where(F.col("conv_id") != conv_id)
    if corpus:
        keys = keys.where(F.col("corpus") == corpus)
    short = ranked.join(keys.select("doc"), "doc").orderBy(F.desc("score"), "doc").limit(CANDIDATES)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "doc"))  # 120 rows at most
    short = staged(short.select(F.col("doc").alias("episode_id"), place.alias("place")))
    content = staged(c.episodes.join(F.broadcast(short), "episode_id").drop("tokens"))  # 120 rows at most
    pairs = content.withColumnsRenamed({"turns": "c_turns", "trusted": "c_trusted"})
    pairs = pairs.crossJoin(F.broadcast(query.select(F.col("turns").alias("q_turns"), F.col("trusted").alias("q_trusted"))))
    scored = align.aligned(pairs, graph, ("episode_id", "conv_id", "corpus", "start", "stop", "place"))
    best = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "place"))
    found = scored.withColumn("best", best).where("best = 1").drop("best").orderBy(F.desc("score"), "place").limit(limit)
    payload = ("turns", "edges", "external_edges")
    shown = content.select("episode_id", F.struct(*payload).alias("episode"))
    echo = query.select(F.struct("conv_id", "start", "stop", *payload).alias("query")).crossJoin(short.agg(F.count("*").alias("candidates")))
    return found.join(shown, "episode_id").crossJoin(F.broadcast(echo)).orderBy(F.desc("score"), "place")  # one row


def atlas_summary(c: Collection) -> DataFrame:
    """One row: the fields, scaling, loadings, explained shares and coordinate bounds of the map, its counts, and each corpus's response pairs and example episode."""
    rows, p = c.atlas
    fit = [(list(FIELDS), p.mean, p.scale, p.loadings, p.explained)]
    head = rows.sparkSession.createDataFrame(fit, "features array<string>, mean array<double>, scale array<double>, loadings array<array<double>>, explained array<double>")
    ends = [F.array(*[f(x) for x in ("pc1", "pc2")]).alias(name) for f, name in ((F.min, "coordinate_min"), (F.max, "coordinate_max"))]
    counts = rows.agg(F.count("*").alias("episodes"), F.countDistinct("conv_id").alias("source_records"), F.array_sort(F.collect_set("corpus")).alias("corpora"), *ends)
    pair = F.struct("corpus", "place", "from_move", "to_move", "n")
    pairs = describe.pair_census(rows).agg(F.array_sort(F.collect_list(pair)).alias("pairs"))  # 169 a corpus at most
    first = describe.first_examples(rows).agg(F.array_sort(F.collect_list(F.struct("corpus", "episode_id"))).alias("example_episodes"))  # one a corpus
    made_up = F.expr("forall(corpora, x -> startswith(x, 'synthetic'))").alias("synthetic")
    return head.crossJoin(counts).select("*", made_up).crossJoin(pairs).crossJoin(first)


def atlas_points(c: Collection) -> DataFrame:
    return atlas.points(c.atlas[0])


def atlas_episode(c: Collection, episode_id: int) -> DataFrame:
    if episode_id < 1:
        raise ValueError("episode ids start at 1")
    return _one(c.atlas[0].where(F.col("episode_id") == episode_id), "episode")


def atlas_pair(c: Collection, corpus: str, from_move: str, to_move: str) -> DataFrame:
    if max(len(from_move), len(to_move)) > 40:
        raise ValueError("moves have at most 40 characters")
    return _one(describe.pair_episode(c.atlas[0], corpus, from_move, to_move), "pairing")


def health(c: Collection) -> dict[str, object]:
    return {"status": "ok", "collection_exists": bool(c.library.conversations.limit(1).count())}
