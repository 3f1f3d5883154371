"""The retrieval experiment against plain Python over the same small collection."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from tests.test_semantics import align_rows
from turnweave.schema import TRUSTED
from turnweave.operators import episodes, evaluate, experiment, motifs
from turnweave.schema import Library
from turnweave.sources.synthetic import threads


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    lib = threads(events.select("event_id", "user_id", "event_type", "props"), 9, "threads", 1)
    return lib, experiment.run(lib, queries=12, shortlist=15)


def plain_motifs(turns, edges):
    """{key: turn positions} of two edges on three turns, first occurrence by edge order."""
    out = {}
    for i, a in enumerate(edges):
        for b in edges[i + 1 :]:
            nodes = sorted({a["source"], a["target"], b["source"], b["target"]})
            if len(nodes) == 3:
                names = {}
                for n in nodes:
                    names.setdefault(turns[n]["speaker"], f"S{len(names) + 1}")
                shape = sorted(f"{nodes.index(e['source'])}>{nodes.index(e['target'])}:{e['type']}" for e in (a, b))
                key = "|".join([",".join(turns[n]["action"] for n in nodes), ",".join(names[turns[n]["speaker"]] for n in nodes), ",".join(shape)])
                out.setdefault(key, (nodes, (a, b)))
    return out


def plain_tokens(actions, speakers, edges):
    out = [f"a_{a}" for a in actions] + [f"b_{a}_{b}" for a, b in zip(actions, actions[1:], strict=False)]
    out += ["s_same" if a == b else "s_different" for a, b in zip(speakers, speakers[1:], strict=False)]
    for s, t, kind in edges:
        out.append(f"e_{kind.lower()}_{'near' if abs(s - t) == 1 else 'delayed'}_{'same' if speakers[s] == speakers[t] else 'different'}")
    return out


def test_rankings_equal_plain_python(small):
    lib, found = small
    turns, edges = collections.defaultdict(dict), collections.defaultdict(list)
    for r in lib.turns.collect():
        turns[r["conv_id"]][r["pos"]] = r
    for r in sorted(lib.edges.collect(), key=lambda r: r["ord"]):
        edges[r["conv_id"]].append(r)
    split = {r["conv_id"]: (r["split"], r["ordinal"]) for r in found.split.collect()}
    train = sorted((c for c, (s, _) in split.items() if s == "train"), key=lambda c: split[c][1])
    of = {c: plain_motifs(turns[c], edges[c]) for c in split}
    holders = collections.defaultdict(set)
    for c in train:
        for k in of[c]:
            holders[k].add(c)
    bags = {}
    for c in train:
        t = [turns[c][i] for i in range(len(turns[c]))]
        bags[c] = collections.Counter(plain_tokens([x["action"] for x in t], [x["speaker"] for x in t], [(e["source"], e["target"], e["type"]) for e in edges[c]]))
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    rows = found.per_query.collect()
    assert 5 <= len(rows) <= 12
    ranks = collections.defaultdict(list)
    for r in sorted(found.rankings.collect(), key=lambda r: r["rank"]):
        ranks[r["method"], r["query"]].append(r["doc"])
    short = collections.defaultdict(list)
    for r in sorted(found.shortlist.collect(), key=lambda r: r["place"]):
        short[r["query"]].append(r["doc"])
    for r in rows:
        q = r["query"]
        assert split[q][0] == "test" and 2 <= len(holders[r["key"]]) <= 100 and r["positives"] == len(holders[r["key"]])
        nodes, pair = of[q][r["key"]]
        side = ([turns[q][n]["action"] for n in nodes], [turns[q][n]["speaker"] for n in nodes], [(nodes.index(e["source"]), nodes.index(e["target"]), e["type"]) for e in pair if e["provenance"] in TRUSTED])
        score = dict.fromkeys(train, 0.0)
        for token in set(plain_tokens(*side)):
            df = sum(token in b for b in bags.values())
            idf = math.log((len(train) - df + 0.5) / (df + 0.5)) if df else 0
            for c in train:
                if k := bags[c][token]:
                    score[c] += (idf if idf > 0 else 1e-6) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * sum(bags[c].values()) / mean))
        held = [c for c in train if set(bags[c]) & set(plain_tokens(*side))]
        expected = sorted(held, key=lambda c: (-round(score[c], 6), split[c][1]))[:15]
        assert short[q] == expected and r["candidates"] == len(expected) and r["candidate_hits"] == len(holders[r["key"]] & set(expected))
        for method in ("sequence", "graph"):
            whole = [([turns[c][i]["action"] for i in range(len(turns[c]))], [turns[c][i]["speaker"] for i in range(len(turns[c]))], [(e["source"], e["target"], e["type"]) for e in edges[c]]) for c in expected]
            got = align_rows([(side, w) for w in whole], method == "graph")
            best = sorted(zip(expected, got, strict=True), key=lambda x: (-round(x[1]["score"], 9), split[x[0]][1]))[:10]
            assert ranks[method, q] == [c for c, _ in best]
        for method in experiment.METHODS:
            right = [c in holders[r["key"]] for c in ranks[method, q]]
            assert len(right) == 10
            assert math.isclose(r[f"{method}_p5"], sum(right[:5]) / 5) and math.isclose(r[f"{method}_p10"], sum(right) / 10)
            assert r[f"{method}_success10"] == int(any(right)) and math.isclose(r[f"{method}_rr10"], next((1 / (i + 1) for i, x in enumerate(right) if x), 0))


def test_report_and_interval(spark, small):
    import numpy as np

    rows = {r["name"]: r for r in experiment.report(small[1], draws=400).collect()}
    own = [r["graph_p5"] - r["sequence_p5"] for r in small[1].per_query.collect()]
    assert math.isclose(rows["graph_minus_sequence_p5"]["mean"], sum(own) / len(own), abs_tol=1e-12)
    assert rows["ceiling_p5"]["mean"] >= rows["graph_p5"]["mean"]
    x = np.random.default_rng(3).normal(10, 4, 300)
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, v double")
    got = evaluate.bootstrap(values, "v", 2000).first()
    draws = np.random.default_rng(4).choice(x, (4000, 300)).mean(axis=1)
    low, high = np.quantile(draws, [0.025, 0.975])
    assert abs(got["low"] - low) < 0.1 and abs(got["high"] - high) < 0.1 and math.isclose(got["mean"], x.mean())


def test_families_and_copies_leave_the_split(spark):
    texts = {f"c:{i}": [f"utterance number {k} of kind {i // 2} in full" for k in range(5)] for i in range(6)}
    texts["c:6"], texts["c:7"] = ["short", "same"], ["\n short ", "SAME"]
    turns = [(c, p, t, "A", "a", "x", None) for c, ts in texts.items() for p, t in enumerate(ts)]
    schema = "conv_id string, pos int, text string, speaker string, action string, annotation string, native_label string"
    split = spark.createDataFrame([(f"c:{i}", "train" if i in (1, 2, 3, 6) else "test", i) for i in range(8)], "conv_id string, split string, ordinal long")
    lib = Library(None, spark.createDataFrame(turns, schema), None)
    left = {r["conv_id"]: r["split"] for r in experiment.cleaned_split(lib, split).collect()}
    assert left == {"c:1": "train", "c:2": "train", "c:6": "train", "c:4": "test"}  # 0 is of 1's family, 3 of 2's, 5 of 4's; 7 equals 6


def test_rewiring_moves_the_first_edge_that_can(spark, small):
    rows = episodes.whole_conversations(small[0]).limit(30)
    for r in motifs.rewired(rows).collect():
        before, after = [(e["source"], e["target"]) for e in r["edges"]], [(e["source"], e["target"]) for e in r["rewired"]]
        changed = [i for i, (a, b) in enumerate(zip(before, after, strict=True)) if a != b]
        able = [i for i, (s, t) in enumerate(before) if [k for k in range(s) if k != t]]
        assert changed == able[:1] and after[able[0]][1] < after[able[0]][0]
    n, preferred, ties = experiment.rewiring(rows).first()
    assert n == motifs.rewired(rows).count() and preferred > 0.9 and ties == 1.0
    assert rows.select(F.max(F.size("turns"))).first()[0] == 9
