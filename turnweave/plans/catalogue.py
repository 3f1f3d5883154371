"""Every query of the engine by the name of its operator, over the test tables.

Queries run over whole tables. Those that compare with SQL round derived numbers to six
places, since sums of doubles depend on their order.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions import labels as L
from turnweave.operators import align, atlas, bm25, cohort, conversations, describe, episodes, evaluate, experiment, layout, motifs, sinks
from turnweave.plans import api
from turnweave.plans.oracles import ORACLES
from turnweave.schema import FIELDS, MOVES, Library
from turnweave.sources import adapters
from turnweave.sources.synthetic import chat, library, threads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__.removesuffix("_")] = f  # a trailing underscore avoids a module's name
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r6(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def _episodes(spark: SparkSession, sf_dir: str) -> tuple[Library, DataFrame]:
    lib = library(spark, sf_dir)
    return lib, episodes.with_content(episodes.numbered(episodes.windows(lib)), lib)


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.described(_episodes(spark, sf_dir)[1])


def _map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Described episodes with stand-in coordinates that SQL can repeat: two descriptors scaled to [0, 1]."""
    return _described(spark, sf_dir).withColumns({"x": F.col("mean_target_span"), "y": F.col("largest_speaker_share")})


# --- Sources -----------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")


def _name(spark: SparkSession, sf_dir: str) -> str:
    """A folder name that is the same for every run of this application over these tables."""
    return f"{spark.sparkContext.applicationId}-{zlib.crc32(sf_dir.encode()):08x}"


def _turns_out(lib: Library) -> DataFrame:
    return lib.turns.select(*adapters.TURN)


@query
def src_molweni(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated dialogues of six utterances, relation types by event."""
    e = _events(spark, sf_dir).selectExpr(
        "event_id DIV 6 AS id", "cast(event_id % 6 AS INT) AS i", "concat(event_type, ' ', props) AS text", "concat('u', user_id % 3) AS speaker",
        "CASE event_type WHEN 'click' THEN 'QAP' WHEN 'error' THEN 'Clarification_question' WHEN 'view' THEN 'Comment' WHEN 'signup' THEN 'Q-Elab' ELSE 'Other_Kind' END AS type",
    )
    rows = e.groupBy("id").agg(
        F.expr("transform(array_sort(collect_list(struct(i, text, speaker))), x -> struct(x.text, x.speaker)) AS edus"),
        F.expr("transform(array_sort(collect_list(struct(i, type)) FILTER (WHERE i > 0)), x -> struct(x.i - 1 AS x, x.i AS y, x.type AS type)) AS relations"),
    )
    return _turns_out(adapters.molweni(rows.selectExpr("'train' AS split", "id", "edus", "coalesce(relations, cast(array() AS ARRAY<STRUCT<x:INT,y:INT,type:STRING>>)) AS relations", "id AS ordinal")))


def _utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterance records of the file-per-utterance corpora, derived from the events."""
    return _events(spark, sf_dir).selectExpr(
        "cast(event_id AS STRING) AS id", "cast(event_id DIV 9 AS STRING) AS conversation_id", "cast(NULL AS STRING) AS root", "concat('p', user_id % 5) AS speaker",
        "cast(NULL AS STRING) AS user", "concat(event_type, ' ', props) AS text",
        "CASE WHEN event_id % 9 > 0 THEN cast(event_id - 1 - user_id % 3 AS STRING) END AS reply_to",
        """map('majority_type', CASE WHEN user_id % 4 = 0 THEN '' ELSE event_type END, 'majority_link', CASE WHEN user_id % 2 = 0 THEN 'none' ELSE cast(event_id - 2 AS STRING) END,
               'message_type', CASE WHEN event_type = 'view' THEN 'INITIAL' ELSE 'MESSAGE' END,
               'annotation_type', CASE WHEN user_id % 3 = 0 THEN 'Probing' WHEN user_id % 3 = 1 THEN 'Non-deliberation' ELSE 'unseen' END) AS meta""",
        "event_id AS ordinal",
    )


@query
def src_convokit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns_out(adapters.convokit(_utterances(spark, sf_dir), "chromium"))


@query
def src_reddit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = adapters.convokit(_utterances(spark, sf_dir), "reddit")
    return lib.edges.groupBy("conv_id", "source", "target", "type", "provenance").agg(F.count("*").alias("n"))


@query
def src_deli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns_out(adapters.convokit(_utterances(spark, sf_dir), "deli"))


@query
def src_reply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.convokit(_utterances(spark, sf_dir), "cmv").edges.select("conv_id", "source", "target", "type", "provenance")


@query
def j_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _utterances(spark, sf_dir).selectExpr("conversation_id AS cid", "cast(ordinal % 9 AS INT) AS pos", "id AS uid", "reply_to AS parent")
    return adapters.reply_edges(rows)


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    rows = c.groupBy("conv_id").agg(F.expr("transform(array_sort(collect_list(struct(turn, role, text))), x -> struct(x.role AS role, x.text AS content)) AS conversation"))
    every = rows.selectExpr("conv_id AS ordinal", "conversation", "CASE conv_id % 11 WHEN 3 THEN true WHEN 5 THEN true WHEN 4 THEN NULL ELSE false END AS toxic")
    return every.union(rows.where("conv_id % 3 = 0").selectExpr("conv_id + 1000000 AS ordinal", "conversation", "false AS toxic"))


@query
def src_wildchat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts after the toxicity flag and exact-copy rules, by role sequence and length (ids hash a JSON form)."""
    lib = adapters.wildchat(_chats(spark, sf_dir))
    return lib.turns.join(lib.conversations.select("conv_id", "ordinal"), "conv_id").select("ordinal", "pos", "speaker", "action", "annotation", "text")


def _alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    said = e.selectExpr("event_id DIV 12 AS c", "cast((event_id % 12) DIV 3 AS INT) AS turn", "cast(event_id % 3 AS INT) AS k", "event_type", "props", "user_id", "event_id")
    item = """struct(event_id, turn, CASE WHEN k = 0 THEN 'user' ELSE 'model' END AS role, concat(event_type, ' ', props) AS content, concat('m', user_id % 4) AS model_name,
                     cast(user_id % 100 AS DOUBLE) AS score, (k = 1 AND user_id % 7 <> 0) OR (k = 2 AND user_id % 13 = 0) AS if_chosen, concat('w', k) AS within_turn_id)"""
    rows = said.groupBy("c").agg(F.array_sort(F.collect_list(F.expr(item))).alias("conversation_history"))
    return rows.selectExpr("cast(c AS STRING) AS conversation_id", "conversation_history", "c AS ordinal")


@query
def src_prism(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.prism(_alternatives(spark, sf_dir))[0].turns.select("conv_id", "pos", "text", "speaker", "action")


@query
def variants_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.prism(_alternatives(spark, sf_dir))[1].select("conv_id", "round", "turn", "text", "model", "score", "chosen", "ambiguous")


@query
def src_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    pairs = F.expr("array_sort(collect_list(struct(turn, text)))")
    rows = c.groupBy("conv_id").agg(pairs.alias("p"))
    rows = rows.selectExpr("conv_id AS id", "transform(p, x -> x.text) AS utterances", "transform(p, x -> cast((conv_id + x.turn) % 5 AS INT)) AS acts", "conv_id AS ordinal")
    return _turns_out(adapters.daily(rows))


@query
def src_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns_out(adapters.demo(spark)[0])


@query
def src_acquire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and digest of a downloaded file, here the smallest table's."""
    return adapters.manifest(spark, f"{sf_dir}/region.parquet").select("bytes", "sha256")


@query
def src_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitelisted metadata of conversations, here of customers as (cid, key, value)."""
    meta = _table(spark, sf_dir, "customer").selectExpr("cast(c_custkey AS STRING) AS cid", "map('title', c_name, 'subreddit', c_mktsegment, 'secret_key', 'x') AS meta")
    return adapters.kept_metadata(meta)


@query
def scan_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's payload, one row a turn and an edge."""
    whole = api.conversation(api.Collection(library(spark, sf_dir)), "threads:7").select("conv_id", "corpus", F.col("meta")["split"].alias("split"), "turns", "edges")
    turns = whole.select("conv_id", "corpus", "split", F.lit("turn").alias("kind"), F.explode("turns").alias("x"))
    turns = turns.select("conv_id", "corpus", "split", "kind", F.col("x.pos").alias("at"), F.col("x.speaker").alias("who"), F.col("x.action").alias("label"), F.col("x.text").alias("text"), F.lit(None).cast("int").alias("target"))
    edges = whole.select("conv_id", "corpus", "split", F.lit("edge").alias("kind"), F.explode("edges").alias("x"))
    edges = edges.select("conv_id", "corpus", "split", "kind", F.col("x.source").alias("at"), F.col("x.provenance").alias("who"), F.col("x.type").alias("label"), F.lit(None).cast("string").alias("text"), F.col("x.target").alias("target"))
    return turns.unionByName(edges)


@query
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection's statistics as the service gives them, with names and first examples."""
    found = api.stats(api.Collection(library(spark, sf_dir), names={"long": "Long threads"}))
    return found.select("corpus", "name", "conversations", "episodes", F.array_join("example_ids", " ").alias("example_ids"))


@query
def atlas_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the map's summary says of counts, pairs and examples; the projection is tested on its own."""
    found = api.atlas_summary(api.Collection(library(spark, sf_dir)))
    top = F.transform(F.filter("pairs", lambda p: p["place"] <= 3), lambda p: F.concat_ws(":", p["corpus"], p["from_move"], p["to_move"], p["n"]))
    shown = F.transform("example_episodes", lambda e: F.concat_ws(":", e["corpus"], e["episode_id"]))
    return found.select("episodes", "source_records", F.array_join("corpora", " ").alias("corpora"), F.array_join(top, " ").alias("top_pairs"), F.array_join(shown, " ").alias("examples"), "synthetic")


@query
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = library(spark, sf_dir)
    return sinks.stats_json(conversations.corpus_stats(lib, episodes.windows(lib)))


@query
def scan_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, value) metadata of the collection."""
    totals = collection_totals(spark, sf_dir)
    return totals.select(F.explode(F.create_map(*[x for c in totals.columns for x in (F.lit(c), F.col(c))])).alias("key", "value"))


# --- Sinks -------------------------------------------------------------------------------


@query
def sink_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of an index after writing and reading it back."""
    lib = library(spark, sf_dir)
    eps = episodes.windows(lib)
    path = f"{sinks.shared_folder(spark)}/index-{_name(spark, sf_dir)}"
    sinks.write_index(lib, eps, conversations.corpus_stats(lib, eps), path)
    read, eps, stats = sinks.read_index(spark, path)
    parts = {"conversations": read.conversations, "turns": read.turns, "edges": read.edges, "episodes": eps, "stats": stats}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in parts.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


@query
def sink_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics' JSON after writing and reading it back."""
    lib = library(spark, sf_dir)
    path = f"{sinks.shared_folder(spark)}/stats-{_name(spark, sf_dir)}"
    sinks.write_stats(conversations.corpus_stats(lib, episodes.windows(lib)), path)
    return spark.read.schema("corpus string, json string").json(sinks.current(spark, path))


@query
def sink_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sinks.shared_folder(spark)}/atlas-{_name(spark, sf_dir)}"
    sinks.write_atlas(_map(spark, sf_dir).select("episode_id", "corpus", "turn_count", "flags"), path)
    return sinks.read_atlas(spark, path).groupBy("corpus").agg(F.count("*").alias("n"), F.sum("flags").alias("flags"))


@query
def sink_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = library(spark, sf_dir)
    changed = spark.createDataFrame([(1, "question")], "turn int, action string")
    return sinks.evidence_json(episodes.slice_conversation(lib, "threads:7", 0, 6), changed)


@query
def sink_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cohort's export beside the pinned cohort of the lens 2."""
    rows = _described(spark, sf_dir)
    picked, pinned = cohort.lens(rows, 5), cohort.lens(rows, 2)
    return sinks.cohort_json(picked, cohort.metrics(picked).select("n"), {"lens": "5"}, cohort.metrics(pinned).select("n"))


# --- Projections -------------------------------------------------------------------------


@query
def canon_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps = _episodes(spark, sf_dir)[1].select("conv_id", "start", F.explode("turns").alias("t"))
    return eps.selectExpr("conv_id", "start", "t.i AS i", "t.speaker AS speaker")


@query
def clean_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr("p_partkey", f"{L.clean_label('p_name')} AS name", f"{L.clean_label('p_type')} AS type", f"{L.clean_label('concat(p_brand, chr(32), chr(33))')} AS brand")


@query
def map_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _events(spark, sf_dir).selectExpr("event_id", "cast(user_id % 6 AS STRING) AS native")
    return labelled.selectExpr("event_id", f"{L.map_action('native')} AS action")


@query
def move_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = library(spark, sf_dir)
    return lib.turns.selectExpr("conv_id", "pos", f"{L.move_group('action')} AS move")


@query
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _episodes(spark, sf_dir)[1].selectExpr("episode_id", f"{episodes.SIGNATURE} AS signature")


@query
def title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.brief(library(spark, sf_dir)).select("id", "title")


@query
def conv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_text(library(spark, sf_dir))


@query
def brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.brief(library(spark, sf_dir))


@query
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = library(spark, sf_dir)
    changed = spark.createDataFrame([(1, "question"), (3, "answer")], "turn int, action string")
    return conversations.overlay(lib.turns, changed).select("conv_id", "pos", "action", "annotation")


@query
def jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.jittered(_map(spark, sf_dir)).select("episode_id", *_r6("jx", "jy"))


@query
def color_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(spark, sf_dir).selectExpr("episode_id", *[f"{L.color_bins(k)} AS {k}_bin" for k in ("speakers", "reach", "known")])


@query
def compact_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{L.compact_number('(o_orderkey * o_orderkey)')} AS shown")


# --- Filters -----------------------------------------------------------------------------


def _facet(spark: SparkSession, sf_dir: str, **facets: str) -> DataFrame:
    lib = library(spark, sf_dir)
    return conversations.matching(lib, conversations.brief(lib), **facets, variant_corpora=("chat",), clarify_corpora=("threads",)).select("id", "nturns", "nspeakers", "nonadjacent")


@query
def f_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facet(spark, sf_dir, corpus="threads")


@query
def f_delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facet(spark, sf_dir, motif="delayed")


@query
def f_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facet(spark, sf_dir, motif="group")


@query
def f_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facet(spark, sf_dir, motif="variants")


@query
def f_clarify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facet(spark, sf_dir, motif="clarify")


@query
def f_min_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facet(spark, sf_dir).where("nturns >= 4")


@query
def f_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the asked windows are valid requests."""
    asked = _events(spark, sf_dir).selectExpr("concat('threads:', event_id % 2000) AS conv_id", "cast(user_id % 12 - 2 AS INT) AS start", "cast(event_id % 11 AS INT) AS stop").distinct()
    return conversations.valid_windows(asked, library(spark, sf_dir))


@query
def f_trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library(spark, sf_dir).edges.where(L.trusted("provenance")).select("conv_id", "source", "target", "type")


@query
def f_not_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.windows(library(spark, sf_dir)).where("conv_id <> 'threads:7'").select("conv_id", "start", "stop")


@query
def f_lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.lens(_described(spark, sf_dir), 5).select("episode_id", "flags")


@query
def f_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.region(_map(spark, sf_dir), 0.25, 0.1, 0.2, 0.45).select("episode_id")


@query
def f_pair_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.struct(F.lit("clarify").alias("from_move"), F.lit("answer").alias("to_move"))
    return _described(spark, sf_dir).where(F.array_contains("pairs", pair)).select("episode_id")


# --- Joins -------------------------------------------------------------------------------


def _texts(lib: Library) -> DataFrame:
    return conversations.conversation_text(lib).select(F.col("conv_id").alias("doc"), F.expr(L.terms("text")).alias("tokens"))


def _asked(spark: SparkSession, *queries: str) -> DataFrame:
    rows = [(q, t.lower()) for q in queries for t in bm25.safe_terms(q)]
    return spark.createDataFrame(rows, "query string, term string")


TEXT_QUERIES = ("error 19 purchase", "the purchase", "view k 42")


@query
def j_fts_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = library(spark, sf_dir)
    hits = bm25.score(_texts(lib), _asked(spark, "error 19 purchase")).select(F.col("doc").alias("id"))
    return conversations.brief(lib).join(hits, "id").select("id", "corpus", "nturns")


def _motif_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Episodes with tokens, and their BM25 scores against episode [0, 6) of one thread."""
    lib, eps = _episodes(spark, sf_dir)
    eps = sinks.staged(episodes.with_tokens(eps).select("episode_id", "corpus", "tokens"))  # read for the postings and for the mean length
    asked = episodes.with_tokens(episodes.slice_conversation(lib, "threads:7", 0, 6))
    terms = asked.select(F.lit(0).alias("query"), F.explode(F.array_distinct("tokens")).alias("term"))
    return eps, bm25.score(eps.select(F.col("episode_id").alias("doc"), "tokens"), terms)


@query
def j_fts_ep(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps, scores = _motif_scores(spark, sf_dir)
    return eps.join(scores, F.col("episode_id") == F.col("doc")).select("episode_id", "corpus", *_r6("score"))


@query
def j_ep_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps = _episodes(spark, sf_dir)[1]
    return eps.selectExpr("episode_id", "size(turns) AS n_turns", "size(edges) AS n_edges", "size(external_edges) AS n_external")


@query
def j_edge_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = library(spark, sf_dir)
    side = lambda name: lib.turns.selectExpr("conv_id", f"pos AS {name}", f"action AS {name}_action", f"speaker AS {name}_speaker")
    return lib.edges.join(side("source"), ["conv_id", "source"]).join(side("target"), ["conv_id", "target"]).select("conv_id", "source", "target", "type", "source_action", "target_action", "source_speaker", "target_speaker")


@query
def j_range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps = _episodes(spark, sf_dir)[1]
    inside = eps.select("episode_id", F.lit(True).alias("internal"), F.inline("edges"))
    outside = eps.select("episode_id", F.lit(False).alias("internal"), F.inline("external_edges"))
    return inside.union(outside).select("episode_id", "internal", "source", "target", "type")


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of nine whose texts are coarse enough that some share most utterances."""
    e = _events(spark, sf_dir)
    return e.selectExpr("concat('f:', event_id DIV 9) AS conv_id", "cast(event_id % 9 AS INT) AS pos", "concat(CASE event_id % 4 WHEN 1 THEN '\\n\\t' WHEN 2 THEN '\u00a0' ELSE '' END, 'a turn', CASE WHEN event_id % 3 = 0 THEN ' \\n' ELSE ' ' END, 'about ', event_type, ' by ', (event_id DIV 9) % 97, ' at ', CASE WHEN user_id % 10 = 0 THEN user_id ELSE event_id % 9 END, CASE WHEN event_id % 5 = 0 THEN '\\r\\n' ELSE '' END) AS text")


@query
def j_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.utterances(_families(spark, sf_dir))


@query
def j_motif(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = motifs.motifs(library(spark, sf_dir))
    index = motifs.motif_index(found).where(F.col("conversations").between(2, 100))
    return found.join(index, "key").groupBy("conv_id").agg(F.count("*").alias("eligible"))


def _split(turns: DataFrame) -> DataFrame:
    heads = turns.select("conv_id").distinct()
    number = F.regexp_extract("conv_id", r"(\d+)$", 1).cast("long")
    return heads.select("conv_id", F.when(number % 5 == 0, "test").otherwise("train").alias("split"), number.alias("ordinal"))


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr("concat('d:', event_id DIV 2) AS conv_id", "cast(event_id % 2 AS INT) AS pos", "concat(CASE WHEN event_id % 3 = 0 THEN '\\n ' ELSE ' ' END, upper(event_type), user_id % 4, CASE WHEN event_id % 7 = 0 THEN cast(event_id AS STRING) ELSE '' END, CASE WHEN event_id % 2 = 0 THEN '\\t' ELSE '' END) AS text")


@query
def j_anti_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _repeated(spark, sf_dir)
    return motifs.drop_exact_duplicates(turns, _split(turns))


@query
def exact_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.digest(_repeated(spark, sf_dir))


@query
def j_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = library(spark, sf_dir)
    return lib.conversations.join(lib.edges.where("type = 'QAP'"), "conv_id", "left_semi").select("conv_id", "corpus")


# --- Aggregations ------------------------------------------------------------------------


@query
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.graph_stats(library(spark, sf_dir))


@query
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = library(spark, sf_dir)
    return conversations.corpus_stats(lib, episodes.windows(lib))


@query
def corpus_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.examples(library(spark, sf_dir))


@query
def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(spark, sf_dir).select("episode_id", *_r6(*FIELDS))


@query
def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(spark, sf_dir).select("episode_id", "turn_count", "speakers", "edge_count", "nonadjacent", "branch", "flags")


@query
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(spark, sf_dir).select("episode_id", *_r6("speaker_entropy", "action_entropy"))


@query
def pair_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.pair_census(_described(spark, sf_dir))


@query
def pathway_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    census = describe.pair_census(_described(spark, sf_dir))
    moves = spark.createDataFrame([(m,) for m in MOVES], "move string")
    return cohort.pathways(census, moves).select("from_move", "to_move", "n", *_r6("intensity"))


METRICS = ("mean_speakers", "group_share", "mean_reach", "nonadjacent_share", "mean_known", "target_share")


@query
def cohort_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.metrics(cohort.lens(_described(spark, sf_dir), 2)).select("n", *_r6(*METRICS))


@query
def cohort_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.composition(cohort.lens(_described(spark, sf_dir), 2)).select("corpus", "n")


@query
def cohort_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _described(spark, sf_dir)
    return cohort.compare(rows.where("corpus = 'threads'"), cohort.lens(rows, 4)).select(*_r6("group_points", "coverage_points"))


@query
def collection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.collection_totals(corpus_stats(spark, sf_dir))


@query
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _events(spark, sf_dir).groupBy((F.col("event_id") % 500).alias("id")).agg(F.avg("user_id").alias("v"))
    return evaluate.bootstrap(values, "v")


def _rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr("event_id DIV 10 AS query", "cast(event_id % 10 + 1 AS INT) AS rank", "user_id % 4 = 0 AS relevant")


@query
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ir_metrics(_rankings(spark, sf_dir)).select("query", "success10", *_r6("p5", "p10", "rr10"))


@query
def ir_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mean_metrics(evaluate.ir_metrics(_rankings(spark, sf_dir))).select("queries", *_r6("p5", "p10", "success10", "rr10"))


@query
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.quantiles(_table(spark, sf_dir, "events"), "value").select(*_r6("p50", "p95"))


@query
def pca_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every episode's place on the map."""
    return atlas.build(sinks.staged(_described(spark, sf_dir)))[0].select("episode_id", "corpus", "x", "y")


@query
def loading_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas.top_loadings(spark, atlas.fit(sinks.staged(_described(spark, sf_dir))))


# --- Sequences ---------------------------------------------------------------------------


@query
def episode_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.numbered(episodes.windows(library(spark, sf_dir))).select("episode_id", "conv_id", "corpus", "start", "stop")


@query
def slice_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _episodes(spark, sf_dir)[1].select("episode_id", F.inline("edges")).select("episode_id", "source", "target", "type", "provenance")


def _tokens_like(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    eps = episodes.with_tokens(_episodes(spark, sf_dir)[1])
    bag = eps.select("episode_id", F.explode("tokens").alias("token")).where(F.col("token").startswith(prefix))
    return bag.groupBy("episode_id", "token").agg(F.count("*").alias("tf"))


@query
def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens_like(spark, sf_dir, "b_")


@query
def same_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens_like(spark, sf_dir, "s_")


@query
def edge_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens_like(spark, sf_dir, "e_")


@query
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.with_tokens(_episodes(spark, sf_dir)[1]).select("episode_id", F.array_join("tokens", " ").alias("tokens"))


@query
def prefix_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.with_tokens(_episodes(spark, sf_dir)[1]).select("episode_id", F.size(F.array_distinct("tokens")).alias("distinct_tokens"), F.array_distinct("tokens")[0].alias("first_token"))


@query
def lane_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lanes(library(spark, sf_dir).turns)


@query
def helix_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.helix(library(spark, sf_dir)).select("conv_id", "pos", *_r6("theta"))


@query
def helix_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.helix(library(spark, sf_dir)).select("conv_id", "pos", *_r6("radius"))


@query
def bead_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.helix(library(spark, sf_dir)).select("conv_id", "pos", *_r6("bead"))


@query
def first_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.first_examples(_described(spark, sf_dir))


@query
def cohort_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.example(cohort.lens(_described(spark, sf_dir), 2))


# --- Ranking -----------------------------------------------------------------------------


@query
def bm25_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.score(_texts(library(spark, sf_dir)), _asked(spark, *TEXT_QUERIES)).select("query", "doc", *_r6("score"))


@query
def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps = episodes.with_tokens(_episodes(spark, sf_dir)[1]).select(F.col("episode_id").alias("doc"), "tokens")
    return bm25.score_phrases(eps, ["a_clarify", "b_clarify_comment", "e_comment_near"]).select("doc", *_r6("score"))


@query
def safe_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms of every part name with hostile characters around it."""
    text = "concat('^x AND \"', p_name, '*)_', p_type)"
    return _table(spark, sf_dir, "part").selectExpr("p_partkey", f"array_join(slice({L.terms(text)}, 1, {bm25.MAX_TERMS}), ' OR ') AS terms")


@query
def topk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ranked(bm25_(spark, sf_dir), k=24).select("query", "doc", "rank")


@query
def topk_motif(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scores = _motif_scores(spark, sf_dir)
    return scores.select("doc", *_r6("score")).orderBy(F.desc("score"), "doc").limit(api.CANDIDATES)


@query
def topk_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.pair_episode(_described(spark, sf_dir), "threads", "clarify", "answer").select("episode_id", "speakers", "turn_count")


@query
def eval_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ranked(bm25_(spark, sf_dir)).select("query", "doc", "rank")


@query
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    pointers = spark.createDataFrame([(1, 300.0, 250.0), (2, 120.0, 400.0), (3, -50.0, 10.0)], "pointer int, qx double, qy double")
    return cohort.nearest(_map(spark, sf_dir), pointers, 1000.0, 800.0).select("pointer", "episode_id", *_r6("distance"))


@query
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = library(spark, sf_dir)
    words = conversations.conversation_text(lib).selectExpr("conv_id AS id", "regexp_extract_all(lower(text), '[\\\\p{L}\\\\p{N}_]{2,}', 0) AS words")
    asked = spark.createDataFrame([(q, q.lower().split()) for q in ("error 19 purchase", "view click signup")], "id string, words array<string>")
    return bm25.tfidf(words, asked).select("query", "doc", *_r6("score"))


@query
def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors by cosine for every vector whose id is divisible by 50."""
    rows = _table(spark, sf_dir, "embeddings").selectExpr("vec_id", "cast(embedding AS ARRAY<DOUBLE>) AS v")
    unit = rows.selectExpr("vec_id", "transform(v, x -> x / sqrt(aggregate(v, 0D, (a, y) -> a + y * y))) AS v")
    asked = unit.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("qv"))
    scored = unit.crossJoin(asked).selectExpr("query", "vec_id AS doc", "round(aggregate(zip_with(qv, v, (a, b) -> a * b), 0D, (a, x) -> a + x), 6) AS score")
    return evaluate.ranked(scored).select("query", "doc", "score", "rank")


@query
def argsort_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir).where("rank <= 5").select("query", "doc", "rank")


# --- Alignment and matching --------------------------------------------------------------


def _aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every episode beside the query episode [0, 6) of one thread."""
    lib, eps = _episodes(spark, sf_dir)
    asked = episodes.slice_conversation(lib, "threads:7", 0, 6).select(F.col("turns").alias("q_turns"), F.col("trusted").alias("q_trusted"))
    return eps.select("episode_id", F.col("turns").alias("c_turns"), F.col("trusted").alias("c_trusted")).crossJoin(F.broadcast(asked))  # one episode


@query
def sw_best_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _aligned_pairs(spark, sf_dir).selectExpr("episode_id", "transform(q_turns, t -> t.action) AS q", "transform(c_turns, t -> t.action) AS c")
    return pairs.selectExpr("episode_id", f"{align.best_raw('q', 'c')} AS best")


@query
def sw_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw score of the traceback function's best alignment; the same figure as the expression's."""
    found = align.alignments(_aligned_pairs(spark, sf_dir), ("episode_id",))
    return found.where("rank = 1").select("episode_id", F.col("raw").alias("best"))


@query
def sw_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of distinct alignments and scores of the first and the last of up to twelve."""
    found = align.alignments(_aligned_pairs(spark, sf_dir), ("episode_id",))
    return found.groupBy("episode_id").agg(F.max("rank").alias("alignments"), F.max("raw").alias("best"), F.min("raw").alias("last"))


@query
def correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = align.aligned(_aligned_pairs(spark, sf_dir), True, ("episode_id",))
    return done.select("episode_id", *_r6("speaker", "edge_f1", "coverage"), "query_edges", "candidate_aligned_edges", F.size("matched_edges").alias("matched"))


@query
def align_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(_aligned_pairs(spark, sf_dir), True, ("episode_id",)).select("episode_id", *_r6("score"))


@query
def match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.match(api.Collection(library(spark, sf_dir)), "threads:7", 0, 6)
    return found.select("conv_id", "start", "stop", *_r6("score", "sequence", "speaker", "edge_f1", "coverage"))


@query
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.match(api.Collection(library(spark, sf_dir)), "threads:7", 0, 6, limit=20, overrides={1: "question"})
    return found.select("conv_id", "start", *_r6("score"))


@query
def distinct_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.match(api.Collection(library(spark, sf_dir)), "long:3", 6, 18, limit=20, corpus="long", mode="phrase")
    return found.select("conv_id", "start", *_r6("score"))


@query
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.search(api.Collection(library(spark, sf_dir)), "error 19 purchase", motif="group", limit=24)
    return found.select("id", "corpus", "nturns", *_r6("score"))


# --- Graphs ------------------------------------------------------------------------------


@query
def motif3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.motifs(library(spark, sf_dir)).select("conv_id", "key")


@query
def motif_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.motif_index(motifs.motifs(library(spark, sf_dir)))


@query
def motif_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = motifs.motifs(library(spark, sf_dir))
    return motifs.motif_queries(found, motifs.motif_index(found))


@query
def family_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _families(spark, sf_dir)
    return motifs.family_filter(turns, _split(turns))


@query
def rewire_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every episode with itself and with one edge re-routed, with and without edges."""
    return experiment.rewiring(_episodes(spark, sf_dir)[1])


@query
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of three rankings for known-answer motif queries; every fifth conversation is for testing."""
    return experiment.run(library(spark, sf_dir)).per_query


@query
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.report(experiment.run(library(spark, sf_dir)))


@query
def out_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library(spark, sf_dir).edges.where("source = 5").select("conv_id", "target", "type", "provenance")


@query
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.evidence(library(spark, sf_dir), "threads:7")


@query
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library(spark, sf_dir).conversations.groupBy("corpus", "corpus_ord").agg(F.count("*").alias("n"))


@query
def episode_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.windows(library(spark, sf_dir)).groupBy("corpus").agg(F.count("*").alias("episodes"), F.countDistinct("conv_id").alias("conversations"), F.sum(F.col("stop") - F.col("start")).alias("turns"))


@query
def atlas_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.atlas_points(api.Collection(library(spark, sf_dir)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural matching end to end."""
    return match(spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship", "chat", "threads"]
