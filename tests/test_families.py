"""Families of near-duplicate conversations: equal to all pairs, without making them."""

import itertools
import random

import pytest

from turnweave.operators import motifs


def by_all_pairs(sets, shared=4, part=0.8):
    family = {c: c for c in sets}

    def root(c):
        while family[c] != c:
            c = family[c]
        return c

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common >= shared and common >= part * min(len(sets[a]), len(sets[b])):
            low, high = sorted((root(a), root(b)))
            family[high] = low
    return {c: root(c) for c in sets}


def turns_of(spark, sets):
    rows = [(c, p, t) for c, s in sets.items() for p, t in enumerate([*sorted(s), "short"])]
    return spark.createDataFrame(rows, "conv_id string, pos int, text string")


def changed(r, sets, pool):
    """One of `sets` with up to three utterances lost or added, or with many more."""
    found = set(r.choice(list(sets.values())))
    for _ in range(r.randint(0, 3)):
        if found and r.random() < 0.6:
            found.discard(r.choice(sorted(found)))
        if r.random() < 0.5:
            found.add(r.choice(pool))
    return found | set(r.sample(pool, r.randint(1, 8))) if r.random() < 0.1 else found


@pytest.mark.parametrize("seed, utterances, most", [(1, 16, 9), (2, 20, 12), (3, 30, 22), (4, 160, 90)])
def test_families_equal_all_pairs(spark, seed, utterances, most):
    r = random.Random(seed)
    pool = [f"this is utterance number {i} of all" for i in range(utterances)]
    sets = {}
    for i in range(120):
        fresh = not sets or r.random() < 0.6
        sets[f"c:{i:03d}"] = set(r.sample(pool, min(r.randint(0, most), utterances))) if fresh else changed(r, sets, pool)
    sizes = {len(s) for s in sets.values()}
    assert len(sizes) > 6 and (max(sizes) > 64) == (most == 90)
    found = {x["conv_id"]: x["family"] for x in motifs.families(turns_of(spark, sets)).collect()}
    assert found == by_all_pairs(sets)
    assert 1 < len(set(found.values())) < len(found)


def shuffled_records(spark, run):
    """Records that `run` writes to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        gateway = spark.sparkContext._gateway
        found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    run()
    return sum(n for stage, n in stages().items() if stage not in before)


def test_frequent_utterances_make_no_pairs(spark):
    """Every utterance is in a fifth of all conversations, and few conversations are similar."""
    r = random.Random(5)
    sets = {f"c:{i:04d}": {f"an utterance at place {p} of kind {r.randrange(5)}" for p in range(9)} for i in range(1500)}
    sets["c:1500"], sets["c:1501"] = set(sorted(sets["c:0003"])[:8]), set(sorted(sets["c:0007"])[2:])
    turns = turns_of(spark, sets).localCheckpoint()
    found = {}
    records = shuffled_records(spark, lambda: found.update({x["conv_id"]: x["family"] for x in motifs.families(turns).collect()}))
    assert found == by_all_pairs(sets)
    assert records < 60 * len(sets)


def shuffled_bytes(spark, run):
    """Bytes that `run` writes to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        gateway = spark.sparkContext._gateway
        found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = stages()
    run()
    return sum(n for stage, n in stages().items() if stage not in before)


def test_sets_without_partners_are_shuffled_once(spark):
    """Only the making of the sets moves their utterances; subsets that one set holds are counted by a few bytes."""
    r = random.Random(7)
    sets = {f"c:{i:05d}": {f"an utterance at place {p} of kind {r.randrange(40)}" for p in range(9)} for i in range(6000)}
    sets["c:06000"], sets["c:06001"], sets["c:06002"] = set(sorted(sets["c:00003"])[1:]), sets["c:00005"], set(sorted(sets["c:00007"])[3:])
    turns = turns_of(spark, sets).localCheckpoint()
    found = {}
    moved = shuffled_bytes(spark, lambda: found.update({x["conv_id"]: x["family"] for x in motifs.families(turns).collect()}))
    assert {c: f for c, f in found.items() if c != f} == {"c:06000": "c:00003", "c:06001": "c:00005", "c:06002": "c:00007"}
    assert len(found) == len(sets)
    assert moved < 230 * len(sets)  # measured: 150


@pytest.mark.parametrize("broadcast, short", [(0, 40), (200_000, 4)])
def test_families_by_other_paths(spark, monkeypatch, broadcast, short):
    """Nothing broadcast and no subset counted first, or so few bits that subsets clash: the same families."""
    monkeypatch.setattr(motifs, "BROADCAST", broadcast)
    monkeypatch.setattr(motifs, "SHORT", short, raising=False)
    r = random.Random(11)
    pool = [f"this is utterance number {i} of all" for i in range(24)]
    sets = {}
    for i in range(120):
        fresh = not sets or r.random() < 0.5
        sets[f"c:{i:03d}"] = set(r.sample(pool, r.randint(0, 12))) if fresh else changed(r, sets, pool)
    sets |= {f"c:{i + 120:03d}": sets[f"c:{i:03d}"] for i in range(0, 120, 3)}
    found = {x["conv_id"]: x["family"] for x in motifs.families(turns_of(spark, sets)).collect()}
    assert found == by_all_pairs(sets)
