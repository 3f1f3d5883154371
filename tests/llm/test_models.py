"""Scores of the two models against plain Python, one text at a time."""

import math
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnweave.llm import quality, toxicity
from turnweave.llm.labelled import id_remainder

ALL = (1 << 64) - 1
SPACE = b" \t\n\x0b\x0c\r"
ODD = ["", "one", "one two", "\n\n\n", "É é É\nÉ é É\n", "a" * 300, "!!! ... ???", "Same line\nsame line\n\nSAME LINE", "数字 数字 x1 x1 x1"]


def byte_words(raw):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    return [m.group() for m in re.finditer(rb"[0-9a-z\x80-\xff]+", low)], low


def plain_statistics(text):
    raw = (text or "").encode()
    words, low = byte_words(raw)
    of = lambda chars: sum(b in chars for b in raw)
    size, n = max(1, len(raw)), len(words)
    some = max(1, n)
    widths = [len(w) for w in words]
    mean = sum(widths) / some
    lines = [x for x in low.split(b"\n") if x]
    pairs = list(zip(words, words[1:], strict=False)) or [(w,) for w in words]
    marks = of(b".,;:'\"-()?")
    symbols = sum(not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 or b in SPACE) for b in raw) - marks
    return [
        math.log1p(n), mean, math.sqrt(max(0.0, sum(w * w for w in widths) / some - mean * mean)), of(bytes(range(65, 91))) / size, of(b"0123456789") / size, of(SPACE) / size, symbols / size, marks / size,
        len(lines), len(raw) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / some,
        1 - len(set(pairs)) / max(1, len(pairs)), symbols / some, n / max(1, of(b".!?")), max((words.count(w) for w in set(words)), default=0) / some,
    ]


def plain_hash(raw):
    value = sum((b + 1) * pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k, b in enumerate(raw)) & ALL ^ (len(raw) << 40) & ALL
    value ^= value >> 30
    value = value * 0xBF58476D1CE4E5B9 & ALL
    value ^= value >> 27
    value = value * 0x94D049BB133111EB & ALL
    return value ^ (value >> 31)


def plain_toxicity(text, model):
    words, _ = byte_words((text or "").encode())
    odds = []
    for w in words:
        held = [1 + plain_hash(w) % (toxicity.BUCKETS - 1)]
        held += [1 + (plain_hash(w[:k]) ^ (k * 0x9E3779B97F4A7C15 & ALL)) % (toxicity.BUCKETS - 1) for k in toxicity.PREFIXES if len(w) > k]
        odds.append(math.exp(max(-30, min(30, model.bias + sum(model.weights[f] for f in held)))))
    move = [[math.exp(model.moves[a][b]) for b in (0, 1)] for a in (0, 1)]
    p = []
    for at in range(0, len(odds), toxicity.CHAIN):
        chain = odds[at : at + toxicity.CHAIN]
        forward, back = [], [(1.0, 1.0)]
        for t, o in enumerate(chain):
            a, b = (1.0, 1.0) if t == 0 else (sum(forward[-1][i] * move[i][j] for i in (0, 1)) for j in (0, 1))
            forward.append((a / (a + b * o), b * o / (a + b * o)))
        for o in reversed(chain[1:]):
            a, b = (move[i][0] * back[-1][0] + move[i][1] * o * back[-1][1] for i in (0, 1))
            back.append((a / (a + b), b / (a + b)))
        p += [f[1] * g[1] / (f[0] * g[0] + f[1] * g[1]) for f, g in zip(forward, reversed(back), strict=True)]
    total = sum(x for x in p if x >= 0.2)
    x = [1.0, math.log1p(total), max(p, default=0.0), total / max(1, len(words)), min(total, 3.0)]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.last, strict=True))))))


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([*ODD, None])], "doc_id long, text string")
    return docs.union(odd), spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_quality_equals_plain_python(tables):
    docs, labels = tables
    forest = quality.train_model(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.scored_ids(docs, forest).collect()}
    assert len(forest.leaf) and len(got) == docs.count()
    for r in docs.collect():
        x, margin = plain_statistics(r["text"]), forest.base
        assert np.allclose(quality.statistics(quality.Words([(r["text"] or "").encode()]))[0], x, atol=1e-9)
        for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[feature[node]] > cut[node])
            margin += leaf[node - len(feature)]
        assert math.isclose(got[r["doc_id"]], 1 / (1 + math.exp(-margin)), abs_tol=1e-6)


def test_toxicity_equals_plain_python(spark, tables):
    docs, _ = tables
    model = toxicity.train_model(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")))  # the smallest table has too few labels
    assert np.abs(model.weights).sum() > 0
    got = {r["doc_id"]: r["score"] for r in toxicity.scored_ids(docs, model).collect()}
    short = [r for r in docs.collect() if len(r["text"] or "") < 4000]
    assert len(short) > 150
    for r in short:
        assert math.isclose(got[r["doc_id"]], plain_toxicity(r["text"], model), abs_tol=1e-6)


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_labels_change_nothing(tables, module, label):
    docs, labels = tables
    modulus, held = module.HOLD_OUT
    flipped = labels.withColumn(label, F.when(id_remainder(F.col("doc_id"), modulus) == held, 1 - F.col(label)).otherwise(F.col(label)))
    one, two = (module.train_model(docs, x) for x in (labels, flipped))
    assert all(np.array_equal(vars(one)[k], vars(two)[k]) for k in vars(one))


def test_fit_holds_little_memory_and_slices_change_nothing(monkeypatch):
    draw = random.Random(3)
    kinds = [f"word{i}" for i in range(3000)]
    texts = [" ".join(draw.choices(kinds, k=1000)) + (" vile slurry" if i % 4 == 0 else "") for i in range(400)]
    train = pd.DataFrame({"text": texts, "y": [int(i % 4 == 0) for i in range(400)]})
    tracemalloc.start()
    model = toxicity.fit(train, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.weights.any()
    assert peak / 400_000 < 150, "bytes a word: the driver holds a whole sample's arrays at once"
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 1)  # a text a slice
    other = toxicity.fit(train, rounds=2)
    assert (model.weights == other.weights).all() and model.bias == other.bias and (model.moves == other.moves).all() and (model.last == other.last).all()
