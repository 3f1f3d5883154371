"""The pipeline's stages against plain Python over the same rows."""

import collections
import hashlib
import itertools
import re

import pytest

import corpus_pipeline
from turnweave.llm import mixing, sharding, toxicity


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows after every stage, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"start": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        path = tmp_path_factory.mktemp("stage").as_uri() + "/t"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]


def test_toxic_documents_go_and_others_stay(spark, sf_dir, stages):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored_ids(docs, model).collect()}
    assert ids(stages["toxicity"]) == sorted(i for i, s in scores.items() if s < toxicity.THRESHOLD)


def test_one_of_each_group_stays(stages):
    bags = {}
    for r in stages["toxicity"]:
        w = words(r["text"])
        bags[r["doc_id"]] = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()
    parent = {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(bags), 2):
        both = sum((bags[a] & bags[b]).values())
        if both and both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert ids(stages["near_dedup"]) == sorted(i for i in bags if root(i) == i)


def test_leaks_go_and_clean_documents_stay(spark, sf_dir, stages):
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} - {()}
    sizes = {len(g) for g in windows}

    def leaks(t):
        w = words(t)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert ids(stages["decontamination"]) == sorted(r["doc_id"] for r in stages["near_dedup"] if not leaks(r["text"]))


def test_mixture(stages):
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in stages["decontamination"]}
    total = collections.Counter()
    for r in stages["decontamination"]:
        total[r["source"]] += size[r["doc_id"]]
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    fixed = set()
    while True:
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in fixed)) / sum(weight[s] for s in order if s not in fixed)
        over = {s for s in order if s not in fixed and weight[s] * level > 2 * total[s]}
        if not over:
            break
        fixed |= over
    expected = collections.Counter()
    for r in stages["decontamination"]:
        rate = 2.0 if r["source"] in fixed else weight[r["source"]] * level / total[r["source"]]
        u = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}:{hashlib.md5((r['text'] or '').encode()).hexdigest()}".encode()).hexdigest()[:8], 16) / 2**32
        if n := int(rate) + (u < rate - int(rate)):
            expected[r["doc_id"]] = n
    assert collections.Counter(r["doc_id"] for r in stages["mixing"]) == expected


def test_shards(stages):
    rows = stages["sharding"]
    assert ids(rows) == ids(stages["mixing"])
    counts = collections.Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == sharding.SHARDS
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)


def test_columns(stages):
    names = stages["start"][0].asDict().keys()
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert list(stages[name][0].asDict()) == list(names)


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
