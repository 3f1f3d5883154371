"""Invariants of representation, alignment, descriptors and routes on small hand-made conversations."""

import itertools
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnweave.functions import labels as L
from turnweave.operators import align, atlas, bm25, cohort, conversations, describe, episodes, evaluate, graphs, motifs, sinks
from turnweave.plans import api
from turnweave.schema import TRUSTED, Library
from turnweave.sources import adapters

TURNS = "conv_id string, pos int, text string, speaker string, action string, annotation string, native_label string"
EDGES = "conv_id string, ord int, source int, target int, type string, provenance string"
CONVS = "conv_id string, source_id string, corpus string, corpus_ord int, ordinal long, title string"


def lib(spark, turns, edges, corpus="c", cid="c:1"):
    t = [(cid, i, text, who, action, "human-discourse", None) for i, (who, action, text) in enumerate(turns)]
    e = [(cid, k, s, d, kind, prov) for k, (s, d, kind, prov) in enumerate(edges)]
    return Library(spark.createDataFrame([(cid, "1", corpus, 0, 1, None)], CONVS), spark.createDataFrame(t, TURNS), spark.createDataFrame(e, EDGES))


F1_TURNS = [("A", "question", "0"), ("B", "clarify", "1"), ("C", "comment", "2"), ("B", "answer", "3")]
F1_EDGES = [(1, 0, "clarify"), (3, 1, "answer")]
ACTIONS, SPEAKERS = [a for _, a, _ in F1_TURNS], [s for s, _, _ in F1_TURNS]


def align_rows(rows, graph=True):
    """Alignments of ((actions, speakers, edges), (actions, speakers, edges)) rows."""
    edge = pa.struct([("source", pa.int32()), ("target", pa.int32()), ("type", pa.string())])
    kinds = {"action": pa.list_(pa.string()), "speaker": pa.list_(pa.string()), "trusted": pa.list_(edge)}
    columns = {}
    for i, side in enumerate("qc"):
        for k, name in enumerate(kinds):
            held = [[dict(zip(("source", "target", "type"), e, strict=True)) for e in r[i][2]] if name == "trusted" else r[i][k] for r in rows]
            columns[f"{side}_{name}"] = pa.array(held, kinds[name])
    batch = pa.RecordBatch.from_pydict(columns)
    names = ("score", "sequence", "speaker", "edge_f1", "coverage", "matched", "query_edges", "candidate_edges", "pairs")
    return pa.RecordBatch.from_arrays(align.best_alignments(batch, graph), names).to_pylist()


def raw_alignments(a, b, top=12):
    q, c, _, unknown = align._sides(pa.RecordBatch.from_pydict({"q_action": pa.array([a], pa.list_(pa.string())), "c_action": pa.array([b], pa.list_(pa.string()))}), False)
    _, raw, paths = align.all_alignments(align.fits(q, c, unknown), top)
    return [(r, tuple((i, int(j)) for i, j in enumerate(p) if j >= 0)) for r, p in zip(raw.tolist(), paths, strict=True)]


def score(speakers=SPEAKERS, edges=F1_EDGES, graph=True):
    return align_rows([((ACTIONS, SPEAKERS, F1_EDGES), (ACTIONS, speakers, edges))], graph)[0]


def test_alignment_of_equal_episodes_is_one():
    a = score()
    assert (a["score"], a["sequence"], a["speaker"], a["edge_f1"]) == (1.0, 1.0, 1.0, 1.0)


def test_renamed_speakers_change_nothing():
    assert score(speakers=["X", "Y", "Z", "Y"])["score"] == score()["score"]


def test_moved_target_lowers_only_the_graph_score():
    moved = [(1, 0, "clarify"), (3, 0, "answer")]
    assert math.isclose(score(edges=moved)["score"], 0.825)
    assert score(edges=moved)["edge_f1"] == 0.5
    assert score(edges=moved, graph=False)["score"] == score(graph=False)["score"]


def test_no_trusted_edges_give_no_edge_agreement():
    (a,) = align_rows([((ACTIONS, SPEAKERS, []), (ACTIONS, SPEAKERS, []))])
    assert a["edge_f1"] is None and math.isclose(a["score"], 1.0)


def test_unknown_actions_score_a_quarter():
    assert raw_alignments(["unknown"], ["unknown"])[0] == (0.25, ((0, 0),))
    assert raw_alignments(["a"], ["b"]) == [(0.0, ())]
    assert raw_alignments([], ["b"]) == [(0.0, ())]


def chains(a, b):
    """Every way to pair turns in order, with its score: fits less the turns skipped between pairs."""
    fit = lambda x, y: 0.25 if "unknown" in (x, y) else 2.0 if x == y else -1.0
    for k in range(min(len(a), len(b)) + 1):
        for i in itertools.combinations(range(len(a)), k):
            for j in itertools.combinations(range(len(b)), k):
                skipped = i[-1] - i[0] + j[-1] - j[0] - 2 * (k - 1) if k else 0
                yield sum(fit(a[x], b[y]) for x, y in zip(i, j, strict=True)) - skipped, tuple(zip(i, j, strict=True))


def agreement_by_hand(q, c, pairs):
    """Speaker agreement, edge f1, coverage, candidate edges of an alignment, by loops over the definitions."""
    to = dict(pairs)
    matched = [e for e in q[2] if e[0] in to and e[1] in to and (to[e[0]], to[e[1]], e[2]) in c[2]]
    inner = [e for e in c[2] if e[0] in to.values() and e[1] in to.values()]
    same = [(q[1][i] == q[1][k]) == (c[1][to[i]] == c[1][to[k]]) for i, k in itertools.combinations(sorted(to), 2)]
    f1 = 2 * len(matched) / (len(q[2]) + len(inner)) if q[2] or inner else None
    return sum(same) / len(same) if same else 0.0, f1, len(to) / max(1, len(q[0])), len(inner), matched


def test_alignments_equal_enumeration(spark):
    rng = random.Random(41)
    rows = []
    for _ in range(120):
        sides = []
        for _ in range(2):
            n = rng.randint(0, 5)
            edges = [(s, rng.randrange(s), rng.choice("xy")) for s in range(1, n) for _ in range(rng.choice((0, 1, 1, 2)))]
            sides.append(([rng.choice(("a", "b", "c", "unknown", None)) for _ in range(n)], [rng.choice("AB") for _ in range(n)], edges))
        rows.append(tuple(sides))
    for graph in (True, False):
        for (q, c), found in zip(rows, align_rows(rows, graph), strict=True):
            known = dict((p, s) for s, p in chains(q[0], c[0]))
            raws = raw_alignments(q[0], c[0])
            assert math.isclose(raws[0][0], max(known.values())) and all(math.isclose(known[p], s) for s, p in raws)
            assert [s for s, _ in raws] == sorted((s for s, _ in raws), reverse=True) and len({p for _, p in raws}) == len(raws) <= 12
            ranked = []
            for raw, pairs in raws:
                speaker, f1, coverage, inner, matched = agreement_by_hand(q, c, pairs)
                sequence = min(1.0, raw / (2 * max(1, len(q[0]))))
                plain = 0.5 * sequence + 0.15 * speaker
                ranked.append((plain / 0.65 if not graph or f1 is None else plain + 0.35 * f1, coverage, sequence, speaker, f1, inner, len(matched), pairs))
            best = max(ranked, key=lambda r: r[:2])
            got = (found["score"], found["coverage"], found["sequence"], found["speaker"])
            assert all(math.isclose(x, y) for x, y in zip(got, best[:4], strict=True))
            assert (found["edge_f1"], found["candidate_edges"], len(found["matched"]), found["query_edges"]) == (best[4], best[5], best[6], len(q[2]))
            assert tuple((p["q"], p["c"]) for p in found["pairs"]) == best[7]


def test_every_cell_ends_an_alignment():
    """All distinct alignments of small episodes: the best one of each cell that ends one."""
    rng = random.Random(5)
    for _ in range(30):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(1, 4))] for _ in range(2))
        found = {p for _, p in raw_alignments(a, b, 1000)}
        best = {}
        for s, p in chains(a, b):
            if p and s > 0:
                best[p[-1]] = max(s, best.get(p[-1], 0))
        known = dict((p, s) for s, p in chains(a, b))
        assert {p[-1] for p in found if p} <= best.keys()
        for p in found:
            assert not p or math.isclose(known[p], best[p[-1]])


def test_best_raw_expression_equals_the_traceback(spark):
    pairs = [(["a", "b", "c", "unknown"], ["a", "c", "b", "b", "unknown"]), (["a"], ["b"]), (["a", "b", "a"], ["a", "x", "b", "a"]), ([], ["a"])]
    df = spark.createDataFrame(pairs, "q array<string>, c array<string>").selectExpr("q", "c", f"{align.best_raw('q', 'c')} AS best")
    for r in df.collect():
        assert r["best"] == raw_alignments(r["q"], r["c"])[0][0]


def test_slice_keeps_inner_and_external_edges(spark):
    x = lib(spark, F1_TURNS, [(*e, "human-discourse") for e in F1_EDGES])
    row = episodes.slice_conversation(x, "c:1", 1, 4).first()
    assert [(e["source"], e["target"]) for e in row["edges"]] == [(2, 0)]
    assert [(e["source"], e["target"]) for e in row["external_edges"]] == [(1, 0)]
    assert [t["speaker"] for t in row["turns"]] == ["S1", "S2", "S1"]


def test_features_of_a_small_episode(spark):
    x = lib(spark, F1_TURNS, [(*e, "human-discourse") for e in F1_EDGES])
    row = episodes.with_tokens(episodes.slice_conversation(x, "c:1", 0, 4)).first()
    assert row["tokens"] == (
        "a_question a_clarify a_comment a_answer b_question_clarify b_clarify_comment b_comment_answer s_different s_different s_different "
        "e_clarify_near_different e_answer_delayed_same"
    ).split()


@pytest.mark.parametrize(("n", "expected"), [(3, []), (4, [(0, 4)]), (10, [(0, 10), (6, 10)]), (13, [(0, 12), (6, 13)])])
def test_windows(spark, n, expected):
    x = lib(spark, [("A", "a", "t")] * n, [])
    assert [(r["start"], r["stop"]) for r in episodes.windows(x).orderBy("start").collect()] == expected


def test_windows_of_a_long_conversation(spark):
    x = lib(spark, [("A", "a", "t")] * 500, [])
    rows = episodes.windows(x).agg(F.count("*").alias("n"), F.max("start").alias("last")).first()
    assert (rows["n"], rows["last"]) == (64, 378)


def test_roles_are_unknown_moves(spark):
    x = lib(spark, [("u", "user", "How are you?"), ("a", "assistant", "I am well.")], [(1, 0, "temporal", "chronological")])
    r = describe.described(episodes.slice_conversation(x, "c:1", 0, 2).withColumn("ordinal", F.lit(1))).first()
    assert r["known"] == 0 and r["reach"] is None and r["edge_count"] == 0 and r["pairs"] == [] and r["speaker_switching"] == 1
    assert math.isclose(r["log_turns"], math.log(3)) and r["speaker_entropy"] == 1 and str(r["action_entropy"]) == "0.0"
    assert math.isclose(r["mean_log_word_count"], math.log(4)) and r["lexical_recurrence"] == 0


def test_pair_direction_and_flags(spark):
    x = lib(spark, [("1", "clarify", "a"), ("2", "comment", "b"), ("3", "answer", "c")], [(2, 0, "QAP", "human-discourse")])
    whole = describe.described(episodes.slice_conversation(x, "c:1", 0, 3)).first()
    assert [(p["from_move"], p["to_move"]) for p in whole["pairs"]] == [("clarify", "answer")]
    assert (whole["reach"], whole["nonadjacent"], whole["flags"], whole["mean_target_span"]) == (2, 1, 23, 1)
    part = describe.described(episodes.slice_conversation(x, "c:1", 1, 3)).first()
    assert part["edge_count"] == 0 and part["reach"] is None and part["pairs"] == []


def test_search_terms_are_literal():
    assert bm25.safe_terms('^x AND NOT "(dog)*') == ["x", "AND", "NOT", "dog"]
    assert len(bm25.safe_terms(" ".join(map(str, range(40))))) == 16


def test_null_texts_and_empty_tables(spark):
    x = lib(spark, [("A", "a", None), ("B", "b", ""), ("A", "a", "x y"), ("B", "b", "x")], [])
    r = describe.described(episodes.with_content(episodes.numbered(episodes.windows(x)), x)).first()
    assert r["turn_count"] == 4 and r["edge_count"] == 0
    none = lib(spark, [("A", "a", "t")], [])
    none = Library(none.conversations.limit(0), none.turns.limit(0), none.edges.limit(0))
    assert conversations.graph_stats(none).count() == 0
    assert describe.described(episodes.with_content(episodes.numbered(episodes.windows(none)), none)).count() == 0
    assert graphs.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_labels(spark):
    r = spark.range(1).selectExpr(f"{L.clean_label(repr('--Not a Label!'))} AS a", f"{L.clean_label(repr('***'))} AS b", f"{L.map_action(repr('QAP'))} AS c", f"{L.move_group(repr('commissive'))} AS d", f"{L.compact_number('1250000')} AS e").first()
    assert tuple(r) == ("not_a_label", "unknown", "answer", "other", "1.3M")


@pytest.fixture(scope="module")
def demo(spark):
    made_up, variants = adapters.demo(spark)
    return api.Collection(made_up, variants=variants, names={"synthetic": "Made-up discussions"})


def test_demo_matches(demo):
    rows = api.match(demo, "synthetic:example-1", 0, 6, corpus="synthetic").collect()
    assert len(rows) == 3 and all(math.isclose(r["score"], 1.0) for r in rows)


def test_demo_override_changes_the_query_only(demo):
    rows = api.match(demo, "synthetic:example-1", 0, 6, corpus="synthetic", overrides={1: "question"}).collect()
    assert all(r["score"] < 1 for r in rows)
    assert api.conversation(demo, "synthetic:example-1").first()["turns"][1]["action"] == "clarify"


def test_demo_map_and_pairs(demo):
    assert api.atlas_points(demo).count() == 5
    assert api.atlas_pair(demo, "synthetic", "clarify", "answer").count() == 1
    with pytest.raises(LookupError):
        api.atlas_pair(demo, "synthetic_variants", "user", "assistant")
    row = demo.described.where("corpus = 'synthetic'").first()
    assert (row["edge_count"], row["nonadjacent"], row["branch"], row["flags"]) == (5, 2, 1, 31)


def test_request_limits(demo):
    for bad in (lambda: api.search(demo, limit=61), lambda: api.match(demo, "synthetic:example-1", 0, 50), lambda: api.match(demo, "synthetic:example-1", 0, 6, overrides={60: "x"})):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(LookupError):
        api.conversation(demo, "nothing")


def test_hostile_search_is_literal(demo):
    assert api.search(demo, 'garden") OR corpus:* --').count() >= 1
    assert api.search(demo, "", motif="clarify").count() == 4
    assert api.search(demo, "", motif="variants").count() == 1
    assert api.health(demo)["status"] == "ok"


def test_rewired_control_prefers_the_original(spark, demo):
    eps = motifs.rewired(demo.episodes.where("corpus = 'synthetic'"))
    for r in eps.collect():
        turns = [x["action"] for x in r["turns"]], [x["speaker"] for x in r["turns"]]
        own, other = ((*turns, [(e["source"], e["target"], e["type"]) for e in r[c]]) for c in ("trusted", "rewired"))
        same, moved = align_rows([(own, own), (own, other)])
        assert same["score"] > moved["score"]


def test_projection_is_standard(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 3))
    df = spark.createDataFrame([(int(i), *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    p = atlas.fit(df, ("a", "b", "c"))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    assert np.allclose(p.explained, values[::-1][:2] / values.sum())
    assert np.allclose(np.abs(p.loadings), np.abs(vectors[:, ::-1][:, :2].T))


def test_bootstrap_covers_the_mean(spark):
    values = spark.range(200).selectExpr("id", "cast(id % 7 AS DOUBLE) AS v")
    r = evaluate.bootstrap(values, "v").first()
    assert r["low"] < r["mean"] < r["high"] and r["high"] - r["low"] < 1


def test_streamed_turns(spark, tmp_path):
    from turnweave.streaming import ingest

    rows = [("c:1", i, "t", "A" if i % 2 else "B", "a", "x", None) for i in range(6)]
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(str(tmp_path / "in"))
    q = ingest.start(ingest.running_counts(ingest.turn_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "out")).orderBy(F.desc("batch")).first()
    assert (last["turns"], last["last_pos"], last["speakers"]) == (6, 5, 2)


def test_reach_is_strict(spark):
    rows = spark.createDataFrame([(1, 0.5, 0.5)], "episode_id long, x double, y double")
    jx, jy = cohort.jittered(rows).select("jx", "jy").first()
    pointers = spark.createDataFrame([(1, jx * 1024 + 10.0, jy * 512), (2, jx * 1024 + 9.5, jy * 512)], "pointer int, qx double, qy double")
    assert [r["pointer"] for r in cohort.nearest(rows, pointers, 1024.0, 512.0).collect()] == [2]


def test_marks_are_folded_in_both_modes(spark):
    docs = spark.createDataFrame([(1, ["a_caf\u00e9"]), (2, ["a_cafe"]), (3, ["a_other"])], "doc int, tokens array<string>")
    assert {r["doc"] for r in bm25.score_phrases(docs, ["CAF\u00c9"]).collect()} == {1, 2}
    x = lib(spark, [("A", "a", "Un caf\u00e9 noir")] * 4, [])
    assert api.search(api.Collection(x), "CAFE").count() == 1 and api.search(api.Collection(x), "caf\u00c9s").count() == 0
    assert L.plain("\u1ec7\u00df\u00d1") == "\u1ec7\u00dfn"  # a letter under two marks stays


def test_payloads_are_whole(demo):
    found = api.match(demo, "synthetic:example-1", 0, 6, corpus="synthetic").collect()
    assert all(len(r["episode"]["turns"]) == 6 and len(r["episode"]["edges"]) == 5 for r in found)
    assert all(r["candidates"] == 3 and r["query"]["conv_id"] == "synthetic:example-1" and len(r["query"]["turns"]) == 6 for r in found)
    row = api.conversation(demo, "synthetic_variants:example-1").first()
    assert [v["text"] for v in row["variants"]] == ["A Walk in Spring", "Green Paths"] and len(row["edges"]) == 3 and row["meta"] == {"order": "made-up"}
    stats = {r["corpus"]: r for r in api.stats(demo).collect()}
    assert stats["synthetic"]["name"] == "Made-up discussions" and len(stats["synthetic"]["example_ids"]) == 4 and stats["synthetic_variants"]["example_ids"] == []
    assert api.build_record(demo).first()["stride"] == 6
    summary = api.atlas_summary(demo).first()
    assert summary["synthetic"] and summary["episodes"] == 5 and len(summary["coordinate_min"]) == 2 and summary["pairs"][0]["corpus"] == "synthetic"
    assert api.atlas_episode(demo, 1).first()["episode_id"] == 1


def test_slices_refuse_empty_ranges(spark):
    x = lib(spark, F1_TURNS, [])
    for bad in ((-1, 2), (2, 2), (3, 1)):
        with pytest.raises(ValueError):
            episodes.slice_conversation(x, "c:1", *bad)


def test_exports_carry_comparisons(spark, demo):
    import json

    found = api.match(demo, "synthetic:example-1", 0, 6, corpus="synthetic", limit=1).select("conv_id", "start", "stop", "score")
    text = sinks.evidence_json(episodes.slice_conversation(demo.library, "synthetic:example-1", 0, 6), None, found).first()["json"]
    assert json.loads(text)["comparison"]["score"] == 1.0
    picked = demo.described.where("corpus = 'synthetic'")
    lines = [json.loads(r["json"]) for r in sinks.cohort_json(picked, cohort.metrics(picked), {"a": "b"}, cohort.metrics(demo.described)).collect()]
    assert len(lines) == 4 and all(x["metrics"]["n"] == 4 and x["pinned"]["n"] == 5 for x in lines)


def test_map_equals_a_plain_projection(spark, sf_dir):
    import numpy as np

    from turnweave.schema import FIELDS
    from turnweave.sources.synthetic import library

    c = api.Collection(library(spark, sf_dir))
    rows, p = c.atlas
    held = rows.orderBy("episode_id").collect()
    x = np.array([[r[f] for f in FIELDS] for r in held])
    scale = np.where(x.std(axis=0) < 1e-12, 1, x.std(axis=0))
    z = (x - x.mean(axis=0)) / scale
    _, s, axes = np.linalg.svd(z, full_matrices=False)
    for k in (0, 1):
        axis = axes[k] * np.sign(axes[k][np.abs(axes[k]).argmax()])
        assert np.allclose(axis, p.loadings[k], atol=1e-6)
        place = z @ axis
        place = (place - place.min()) / (place.max() - place.min())
        assert np.allclose(place, [r["xy"[k]] for r in held], atol=2e-6)
    assert np.allclose((s**2 / (s**2).sum())[:2], p.explained)
    top = atlas.top_loadings(spark, p).where("component = 1").orderBy("place").collect()
    order = np.argsort(-np.abs(p.loadings[0]), kind="stable")[:5]
    assert [r["field"] for r in top] == [FIELDS[i] for i in order]
    drawn = {r["episode_id"]: r for r in api.atlas_points(c).collect()}
    corpora = sorted({r["corpus"] for r in held})
    assert all((drawn[r["episode_id"]]["pc1"], drawn[r["episode_id"]]["corpus_index"], drawn[r["episode_id"]]["motif_flags"]) == (r["x"], corpora.index(r["corpus"]), r["flags"]) for r in held)


def test_match_equals_plain_python(spark, sf_dir):
    """Shortlist, alignment and choice of one episode a conversation, by hand."""
    from turnweave.sources.synthetic import library

    c = api.Collection(library(spark, sf_dir))
    for conv_id, start, stop, corpus, changed in (("threads:7", 0, 6, "", {}), ("threads:7", 0, 6, "threads", {1: "question"}), ("long:3", 6, 18, "long", {})):
        found = api.match(c, conv_id, start, stop, corpus=corpus, limit=20, overrides=changed).collect()
        asked = found[0]["query"]
        rows = {r["episode_id"]: r for r in c.episodes.collect()}
        turns = [(changed.get(t["pos"], t["action"]), t["speaker"]) for t in asked["turns"]]
        assert [t["action"] for t in asked["turns"]] == [a for a, _ in turns]
        own = ([a for a, _ in turns], [s for _, s in turns], [(e["source"], e["target"], e["type"]) for e in asked["edges"] if e["provenance"] in TRUSTED])
        terms = set(episodes.with_tokens(episodes.slice_conversation(c.library, conv_id, start, stop, conversations.overlay(c.library.turns.where(F.col("conv_id") == conv_id), spark.createDataFrame(list(changed.items()) or [(-1, "x")], "turn int, action string")))).first()["tokens"])
        bags = {i: r["tokens"] for i, r in rows.items()}
        mean = sum(map(len, bags.values())) / len(bags)
        df = {t: sum(t in set(b) for b in bags.values()) for t in terms}
        weight = {t: max(math.log((len(bags) - k + 0.5) / (k + 0.5)), 1e-6) if math.log((len(bags) - k + 0.5) / (k + 0.5)) > 0 else 1e-6 for t, k in df.items() if k}
        score = {i: sum(w * b.count(t) * 2.2 / (b.count(t) + 1.2 * (0.25 + 0.75 * len(b) / mean)) for t, w in weight.items()) for i, b in bags.items()}
        pool = [i for i, b in bags.items() if terms & set(b) and rows[i]["conv_id"] != conv_id and (not corpus or rows[i]["corpus"] == corpus)]
        short = sorted(pool, key=lambda i: (-round(score[i], 6), i))[:120]
        sides = [([t["action"] for t in rows[i]["turns"]], [t["speaker"] for t in rows[i]["turns"]], [(e["source"], e["target"], e["type"]) for e in rows[i]["trusted"]]) for i in short]
        best = {}
        for i, a in sorted(zip(short, align_rows([(own, s) for s in sides]), strict=True), key=lambda x: -x[1]["score"]):
            best.setdefault(rows[i]["conv_id"], (a["score"], i))
        assert [r["episode_id"] for r in found] == [i for _, i in sorted(best.values(), key=lambda x: (-x[0], short.index(x[1])))[:20]]
        assert all(r["candidates"] == len(short) and [t["pos"] for t in r["episode"]["turns"]] == [t["pos"] for t in rows[r["episode_id"]]["turns"]] for r in found)
