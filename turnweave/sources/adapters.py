"""Adapters from corpus files to the dialogue tables.

Every adapter takes a DataFrame in the source's own shape (read it with `read_json`,
`read_jsonl` or spark.read.parquet) and returns a Library. Where order in the file has a
meaning, the rows carry an `ordinal` column; `read_jsonl` supplies it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnweave.functions.labels import map_action
from turnweave.schema import Library

TURN = ("conv_id", "pos", "text", "speaker", "action", "annotation", "native_label")
EDGE = ("conv_id", "ord", "source", "target", "type", "provenance")
CORPORA = ("molweni", "reddit", "cmv", "deli", "wildchat", "prism", "dailydialog", "chromium")  # the order of the collection


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array of records per file, with each record's place in the input as `ordinal` (see `read_jsonl`)."""
    return _placed(spark.read.schema(schema).json(path, multiLine=True))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line, with its place in the input as `ordinal`.

    Places order rows by (file name, place in the file), however files are cut into tasks;
    they are unique and increasing but not dense.
    """
    return _placed(spark.read.schema(schema).json(path))


def _placed(rows: DataFrame) -> DataFrame:
    """A row's place is its file's rank, its split's offset and its number in the split; a record takes a byte, so splits do not run into each other."""
    at = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")]
    numbered = rows.select("*", *at).withColumn("__number", F.monotonically_increasing_id())
    splits = numbered.groupBy("__file", "__start").agg(F.min("__number").alias("__first"))
    files = splits.select("__file").distinct().withColumn("__rank", F.row_number().over(Window.orderBy("__file")))  # one row a file
    splits = splits.join(files, "__file")
    placed = numbered.join(splits, ["__file", "__start"])
    return placed.select(*rows.columns, (F.col("__rank") * F.lit(1 << 44) + F.col("__start") + F.col("__number") - F.col("__first")).alias("ordinal"))


def _conversations(rows: DataFrame, corpus: str, title: str = "cast(NULL AS STRING)", /, **meta: str) -> DataFrame:
    """One row a conversation; `meta` holds the SQL of each entry, and entries that are null are left out."""
    order = CORPORA.index(corpus) if corpus in CORPORA else len(CORPORA)
    pairs = ", ".join(f"'{k}', cast({v} AS STRING)" for k, v in meta.items())
    held = f"map_filter(map({pairs}), (k, v) -> v IS NOT NULL)" if pairs else "map()"
    return rows.selectExpr(
        f"concat('{corpus}:', cid) AS conv_id", "cid AS source_id", f"'{corpus}' AS corpus", f"{order} AS corpus_ord", "ordinal", f"{title} AS title", f"cast({held} AS MAP<STRING, STRING>) AS meta"
    )


def _chain(turns: DataFrame) -> DataFrame:
    return turns.where("pos > 0").selectExpr("conv_id", "pos - 1 AS ord", "pos AS source", "pos - 1 AS target", "'temporal' AS type", "'chronological' AS provenance")


def molweni(rows: DataFrame) -> Library:
    """(split, id, edus: array<struct<text, speaker>>, relations: array<struct<x, y, type>>, ordinal).

    x is the parent and y the child; of several relations of a child the last names its action.
    """
    keyed = rows.withColumn("cid", F.concat_ws("-", "split", F.col("id").cast("string")))
    conv = F.concat(F.lit("molweni:"), "cid")
    edus = keyed.select(conv.alias("conv_id"), F.posexplode("edus").alias("pos", "u"))
    links = keyed.select(conv.alias("conv_id"), F.posexplode("relations").alias("ord", "r"))
    native = links.groupBy("conv_id", F.col("r.y").cast("int").alias("pos")).agg(F.max_by("r.type", "ord").alias("native_label"))
    turns = edus.join(native, ["conv_id", "pos"], "left").selectExpr(
        "conv_id", "pos", "coalesce(u.text, '') AS text", "cast(u.speaker AS STRING) AS speaker",
        f"CASE WHEN native_label IS NULL THEN 'unknown' ELSE {map_action('native_label', 'lower(native_label)')} END AS action",
        "CASE WHEN native_label IS NULL THEN 'unannotated' ELSE 'human-discourse' END AS annotation", "native_label",
    )
    edges = links.selectExpr("conv_id", "ord", "cast(r.y AS INT) AS source", "cast(r.x AS INT) AS target", "r.type AS type", "'human-discourse' AS provenance")
    return Library(_conversations(keyed, "molweni", split="split", source_dialogue_id="id", order="'source-utterance'"), turns, edges)


def reply_edges(rows: DataFrame) -> DataFrame:
    """(cid, source, target) from (cid, pos, uid, parent): the parent's last position, unless it is missing or the turn itself."""
    place = rows.groupBy("cid", F.col("uid").alias("parent")).agg(F.max("pos").alias("target"))
    return rows.where("parent IS NOT NULL").join(place, ["cid", "parent"]).where("target <> pos").select("cid", F.col("pos").alias("source"), "target")


def convokit(rows: DataFrame, corpus: str, metadata: DataFrame | None = None) -> Library:
    """(id, conversation_id, root, speaker, user, text, reply-to or reply_to, meta: map<string,string>, ordinal); corpus reddit, deli, cmv or chromium.

    `metadata` is (cid, meta: map<string,string>); its `META_KEYS` travel with the conversation
    and its title is the conversation's.
    """
    answered = [f"`{c}`" for c in ("reply-to", "reply_to") if c in rows.columns]
    base = rows.selectExpr(
        "coalesce(conversation_id, root) AS cid", "cast(id AS STRING) AS uid", "coalesce(speaker, user, 'unknown') AS speaker", "coalesce(text, '') AS text",
        f"coalesce({', '.join(answered)}) AS parent", "meta", "ordinal",
    )
    if corpus == "deli":
        base = base.where("meta['message_type'] = 'MESSAGE'")
    base = base.withColumn("pos", (F.row_number().over(Window.partitionBy("cid").orderBy("ordinal")) - 1).cast("int"))
    native, action, annotation = "cast(NULL AS STRING)", "'unknown'", "'unannotated'"
    if corpus == "reddit":
        native, annotation = "meta['majority_type']", "'human-majority'"
        action = f"coalesce(nullif({native}, ''), 'unknown')"
    elif corpus == "deli":
        native, annotation = "meta['annotation_type']", "'human-deliberation'"
        action = f"coalesce(nullif({map_action(native, native)}, ''), 'unknown')"
    turns = base.selectExpr(f"concat('{corpus}:', cid) AS conv_id", "pos", "text", "speaker", f"{action} AS action", f"{annotation} AS annotation", f"{native} AS native_label")
    kind, provenance = ("temporal", "chronological") if corpus == "deli" else ("reply", "platform-reply")
    edges = reply_edges(base).selectExpr("cid", "source * 2 AS ord", "source", "target", f"'{kind}' AS type", f"'{provenance}' AS provenance")
    if corpus == "reddit":
        linked = base.selectExpr("cid", "pos", "uid", "parent AS reply", "meta['majority_link'] AS parent").where("parent <> 'none' AND (reply IS NULL OR parent <> reply)")
        place = base.groupBy("cid", F.col("uid").alias("parent")).agg(F.max("pos").alias("target"))
        human = linked.join(place, ["cid", "parent"]).where("target <> pos")
        edges = edges.union(human.selectExpr("cid", "pos * 2 + 1 AS ord", "pos AS source", "target", "'discourse' AS type", "'human-link' AS provenance"))
    heads = base.groupBy("cid").agg(F.min("ordinal").alias("ordinal"))
    if metadata is None:
        convs = _conversations(heads, corpus, order="'source-file'")
    else:
        known = {k: f"meta['{k}']" for k in META_KEYS}
        convs = _conversations(heads.join(metadata, "cid", "left"), corpus, known["title"], order="'source-file'", **known)
    return Library(convs, turns, edges.selectExpr(f"concat('{corpus}:', cid) AS conv_id", *EDGE[1:]))


META_KEYS = ("split", "summary_meta", "pair_id", "has_removed_comment", "team_performance", "performance_change", "title", "subreddit")


def kept_metadata(metadata: DataFrame) -> DataFrame:
    """(cid, key, value) of the metadata keys that travel with a conversation."""
    return metadata.select("cid", F.explode("meta").alias("key", "value")).where(F.col("key").isin(*META_KEYS))


def wildchat(rows: DataFrame) -> Library:
    """(conversation: array<struct<role, content>>, toxic, ordinal): the first of equal transcripts, without those marked toxic.

    A null mark is no mark. Of the optional columns conversation_hash, model and language the
    first transcript's values are kept as metadata.
    """
    clean = rows.where("NOT coalesce(toxic, false) AND size(conversation) > 0")
    hashed = clean.withColumn("digest", F.sha2(F.to_json(F.transform("conversation", lambda t: F.array(t["role"], t["content"])), {"ignoreNullFields": "false"}), 256))
    known = {"source_hash": "conversation_hash", "model": "model", "language": "language"}
    known = {k: c for k, c in known.items() if c in rows.columns}
    first = hashed.groupBy("digest").agg(*[F.min_by(c, "ordinal").alias(c) for c in ("conversation", *known.values())], F.min("ordinal").alias("ordinal"))
    first = first.withColumn("cid", F.substring("digest", 1, 24))
    turns = first.select(F.concat(F.lit("wildchat:"), "cid").alias("conv_id"), F.posexplode("conversation").alias("pos", "t"))
    turns = turns.selectExpr("conv_id", "pos", "coalesce(t.content, '') AS text", "t.role AS speaker", "t.role AS action", "'source-role' AS annotation", "cast(NULL AS STRING) AS native_label")
    return Library(_conversations(first, "wildchat", order="'source-utterance'", **known), turns, _chain(turns))


def prism(rows: DataFrame) -> tuple[Library, DataFrame]:
    """(conversation_id, conversation_history: array<struct<turn, role, content, model_name, score, if_chosen, within_turn_id>>, ordinal).

    Returns the library of unique selected paths, and the variants (conv_id, round, turn,
    text, model, score, chosen, ambiguous): a path ends at the first round without exactly
    one chosen reply, whose user turn it still holds.
    """
    said = rows.select(F.col("conversation_id").alias("cid"), "ordinal", F.posexplode("conversation_history").alias("at", "t"))
    said = said.selectExpr("cid", "ordinal", "at", "t.turn AS round", "t.role AS role", "coalesce(t.content, '') AS content", "t.model_name AS model", "t.score AS score", "coalesce(t.if_chosen, false) AS chosen")
    rounds = said.groupBy("cid", "round").agg(
        F.expr("min_by(content, at) FILTER (WHERE role = 'user')").alias("asked"),
        F.expr("count_if(role = 'user')").alias("users"),
        F.expr("count_if(role <> 'user' AND chosen)").alias("n_chosen"),
        F.expr("min_by(content, at) FILTER (WHERE role <> 'user' AND chosen)").alias("answer"),
    )
    rounds = rounds.where("users > 0")
    by = Window.partitionBy("cid").orderBy("round")
    rounds = rounds.withColumn("bad", F.expr("cast(n_chosen <> 1 AS INT)"))
    rounds = rounds.withColumn("stopped", F.coalesce(F.max("bad").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("stopped = 0")
    rounds = rounds.withColumn("turn", ((F.row_number().over(by) - 1) * 2).cast("int"))
    conv = "concat('prism:', cid) AS conv_id"
    user = rounds.selectExpr(conv, "turn AS pos", "asked AS text", "'human' AS speaker", "'user' AS action", "'source-role' AS annotation", "cast(NULL AS STRING) AS native_label")
    model = rounds.where("bad = 0").selectExpr(conv, "turn + 1 AS pos", "answer AS text", "'model' AS speaker", "'assistant' AS action", "'source-role' AS annotation", "cast(NULL AS STRING) AS native_label")
    turns = user.union(model)
    asks = user.where("pos > 0").selectExpr("conv_id", "pos - 1 AS ord", "pos AS source", "pos - 1 AS target", "'temporal' AS type", "'chronological' AS provenance")
    answers = model.selectExpr("conv_id", "pos - 1 AS ord", "pos AS source", "pos - 1 AS target", "'prompt-response' AS type", "'observed-alternative' AS provenance")
    replies = said.where("role <> 'user'").join(rounds.select("cid", "round", "turn", (F.col("bad") == 1).alias("ambiguous")), ["cid", "round"])
    variants = replies.selectExpr(conv, "round", "turn", "content AS text", "model", "score", "chosen", "ambiguous", "at")
    heads = rounds.groupBy("cid").agg(F.expr("min(round) FILTER (WHERE bad = 1)").alias("ambiguous")).join(rows.select(F.col("conversation_id").alias("cid"), "ordinal"), "cid")
    convs = _conversations(heads, "prism", ambiguous_round="ambiguous", order="'unique-selected-path-until-ambiguity'")
    return Library(convs, turns, asks.union(answers)), variants


def daily(rows: DataFrame) -> Library:
    """(id, utterances: array<string>, acts: array<int>, ordinal): two alternating speakers."""
    keyed = rows.withColumn("cid", F.col("id").cast("string"))
    pairs = keyed.select(F.concat(F.lit("dailydialog:"), "cid").alias("conv_id"), F.posexplode(F.arrays_zip("utterances", "acts")).alias("pos", "u"))
    pairs = pairs.where("u.utterances IS NOT NULL AND u.acts IS NOT NULL")
    turns = pairs.selectExpr(
        "conv_id", "pos", "u.utterances AS text", "concat('S', pos % 2 + 1) AS speaker", f"{map_action('cast(u.acts AS STRING)')} AS action", "'human-dialogue-act' AS annotation", "cast(u.acts AS STRING) AS native_label"
    )
    return Library(_conversations(keyed, "dailydialog", split="'train'", speaker_assignment="'alternation-assumption'", order="'source-utterance'"), turns, _chain(turns))


def demo(spark: SparkSession) -> tuple[Library, DataFrame]:
    """Five small made-up conversations: four discussions of six turns and one with two replies to choose from."""
    steps = [
        ("S1", "question", None), ("S2", "clarify", (0, "Clarification_question")), ("S3", "comment", (0, "Comment")),
        ("S1", "answer", (1, "QAP")), ("S2", "propose", (3, "Comment")), ("S1", "acknowledge", (4, "Acknowledgement")),
    ]
    topics = ["a garden path", "a bus route", "a reading room", "a bread recipe"]
    lines = ["How should we plan {}?", "Which part of {} do you mean?", "I once saw {} done well.", "The first part of {}.", "Then let us sketch {} together.", "Good, that settles {}."]
    turns, edges, convs = [], [], []
    for k, topic in enumerate(topics, 1):
        cid = f"synthetic:example-{k}"
        convs.append((cid, f"example-{k}", "synthetic", len(CORPORA), k, f"Planning {topic}", {"order": "made-up"}))
        for pos, ((who, action, answers), line) in enumerate(zip(steps, lines, strict=True)):
            turns.append((cid, pos, line.format(topic), who, action, "synthetic-example", None))
            if answers:
                edges.append((cid, pos - 1, pos, *answers, "synthetic-example"))
    cid = "synthetic_variants:example-1"
    convs.append((cid, "example-1", "synthetic_variants", len(CORPORA) + 1, 5, "Two replies", {"order": "made-up"}))
    for pos, text in enumerate(("Suggest a title.", "A Walk in Spring", "Something shorter?", "Spring")):
        turns.append((cid, pos, text, "human" if pos % 2 == 0 else "model", "user" if pos % 2 == 0 else "assistant", "synthetic-example", None))
        if pos:
            edges.append((cid, pos - 1, pos, pos - 1, "temporal", "chronological"))
    variants = [(cid, 0, 0, "A Walk in Spring", "model-a", 0.8, True, False, 1), (cid, 0, 0, "Green Paths", "model-b", 0.4, False, False, 2)]
    lib = Library(
        spark.createDataFrame(convs, "conv_id string, source_id string, corpus string, corpus_ord int, ordinal long, title string, meta map<string, string>"),
        spark.createDataFrame(turns, "conv_id string, pos int, text string, speaker string, action string, annotation string, native_label string"),
        spark.createDataFrame(edges, "conv_id string, ord int, source int, target int, type string, provenance string"),
    )
    return lib, spark.createDataFrame(variants, "conv_id string, round int, turn int, text string, model string, score double, chosen boolean, ambiguous boolean, at int")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of downloaded files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
