"""Adapters over files in the sources' own formats, and the written index."""

import json

import pytest

from turnweave.operators import conversations, episodes, sinks
from turnweave.sources import adapters


def test_molweni_file(spark, tmp_path):
    record = {"id": 7, "edus": [{"text": "hi", "speaker": "a"}, {"text": None, "speaker": "b"}, {"text": "yes", "speaker": "a"}], "relations": [{"x": 0, "y": 1, "type": "QAP"}, {"x": 0, "y": 1, "type": "Comment"}, {"x": 1, "y": 2, "type": "New_Kind"}]}
    (tmp_path / "train.json").write_text(json.dumps([record]))
    rows = adapters.read_json(spark, str(tmp_path / "train.json"), "id long, edus array<struct<text:string,speaker:string>>, relations array<struct<x:int,y:int,type:string>>")
    lib = adapters.molweni(rows.selectExpr("'train' AS split", "*"))
    turns = {r["pos"]: r for r in lib.turns.collect()}
    assert [turns[i]["action"] for i in range(3)] == ["unknown", "comment", "new_kind"]  # the last relation of a turn names its action
    assert turns[0]["annotation"] == "unannotated" and turns[1]["text"] == "" and turns[1]["native_label"] == "Comment"
    assert lib.edges.count() == 3 and lib.conversations.first()["conv_id"] == "molweni:train-7"


UTTERANCE = "id string, conversation_id string, root string, speaker string, user string, text string, reply_to string, meta map<string,string>"


def test_utterance_file_keeps_its_order(spark, tmp_path):
    lines = [
        {"id": "u1", "root": "c", "user": "x", "text": "first", "meta": {"majority_type": "question", "majority_link": "none"}},
        {"id": "u2", "root": "c", "user": "y", "text": "second", "reply_to": "u1", "meta": {"majority_type": "", "majority_link": "u1"}},
        {"id": "u3", "root": "c", "user": "x", "text": "third", "reply_to": "u3", "meta": {"majority_link": "u1"}},
        {"id": "u4", "root": "c", "text": "fourth", "reply_to": "missing", "meta": {}},
        {"id": "u2", "root": "c", "user": "y", "text": "again", "reply_to": "u2", "meta": {}},
    ]
    (tmp_path / "utterances.jsonl").write_text("\n".join(map(json.dumps, lines)))
    lib = adapters.convokit(adapters.read_jsonl(spark, str(tmp_path / "utterances.jsonl"), UTTERANCE), "reddit")
    turns = sorted(lib.turns.collect(), key=lambda r: r["pos"])
    assert [t["text"] for t in turns] == ["first", "second", "third", "fourth", "again"]
    assert [t["action"] for t in turns] == ["question", "unknown", "unknown", "unknown", "unknown"] and turns[3]["speaker"] == "unknown"
    found = {(e["source"], e["target"], e["provenance"]) for e in lib.edges.collect()}
    assert found == {(1, 0, "platform-reply"), (2, 0, "human-link")}  # self replies, unknown parents and repeated links are dropped


def test_prism_stops_at_ambiguity(spark):
    history = "conversation_id string, conversation_history array<struct<turn:int,role:string,content:string,model_name:string,score:double,if_chosen:boolean,within_turn_id:string>>, ordinal long"
    said = [(0, "user", "q0", None, None, None, None), (0, "model", "a0", "m", 1.0, True, "w0"), (0, "model", "b0", "n", 0.5, False, "w1"), (1, "user", "q1", None, None, None, None), (1, "model", "a1", "m", 1.0, True, "w0"), (1, "model", "b1", "n", 1.0, True, "w1"), (2, "user", "q2", None, None, None, None)]
    lib, variants = adapters.prism(spark.createDataFrame([("p", said, 1)], history))
    assert [r["text"] for r in lib.turns.orderBy("pos").collect()] == ["q0", "a0", "q1"]
    assert {(r["round"], r["ambiguous"]) for r in variants.collect()} == {(0, False), (1, True)}
    assert lib.edges.where("provenance = 'observed-alternative'").count() == 1


def test_manifest(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    row = adapters.manifest(spark, str(tmp_path / "a.bin")).first()
    assert row["bytes"] == 3 and row["sha256"].startswith("ba7816bf")


def test_index_round_trip_prunes_by_corpus(spark, tmp_path):
    lib, _ = adapters.demo(spark)
    eps = episodes.windows(lib)
    path = (tmp_path / "index").as_uri()
    for _ in range(2):  # the second write replaces the first
        sinks.write_index(lib, eps, conversations.corpus_stats(lib, eps), path)
    read, again, stats = sinks.read_index(spark, path)
    assert read.turns.count() == lib.turns.count() and again.count() == eps.count() and stats.count() == 2
    plan = read.conversations.where("corpus = 'synthetic'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(corpus" in plan


def test_reply_key_with_a_dash_and_metadata(spark, tmp_path):
    lines = [{"id": "u1", "conversation_id": "c", "speaker": "x", "text": "first"}, {"id": "u2", "conversation_id": "c", "speaker": "y", "text": "second", "reply-to": "u1"}]
    (tmp_path / "utterances.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = adapters.read_jsonl(spark, str(tmp_path / "utterances.jsonl"), UTTERANCE.replace("reply_to", "`reply-to`"))
    known = spark.createDataFrame([("c", {"title": "A title", "split": "test", "secret": "x"})], "cid string, meta map<string,string>")
    lib = adapters.convokit(rows, "cmv", known)
    assert [(e["source"], e["target"]) for e in lib.edges.collect()] == [(1, 0)]
    head = lib.conversations.first()
    assert head["title"] == "A title" and head["meta"] == {"title": "A title", "split": "test", "order": "source-file"}
    assert adapters.convokit(rows, "cmv").conversations.first()["meta"] == {"order": "source-file"}


def test_places_follow_file_names_and_lines(spark, tmp_path):
    for name, start in (("b", 300), ("a", 0)):  # the later name is the larger file, which readers take first
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"n": start + i, "pad": "x" * (i % 40 + start)}) + "\n" for i in range(300)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        found = adapters.read_jsonl(spark, str(tmp_path), "n long").orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["n"] for r in found] == list(range(600)) and len({r["ordinal"] for r in found}) == 600


def test_a_null_mark_is_no_mark(spark):
    said = "conversation array<struct<role:string,content:string>>, toxic boolean, ordinal long, model string"
    rows = [([("user", "a"), ("assistant", "b")], None, 1, "m1"), ([("user", "c")], True, 2, "m2"), ([("user", "a"), ("assistant", "b")], False, 3, "m3")]
    lib = adapters.wildchat(spark.createDataFrame(rows, said))
    (head,) = lib.conversations.collect()
    assert head["ordinal"] == 1 and head["meta"] == {"model": "m1", "order": "source-utterance"} and lib.turns.count() == 2


def test_a_broken_write_leaves_the_installed_index(spark, tmp_path, monkeypatch):
    lib, _ = adapters.demo(spark)
    eps, path = episodes.windows(lib), (tmp_path / "index").as_uri()
    sinks.write_index(lib, eps, conversations.corpus_stats(lib, eps), path)
    installed = sinks.current(spark, path)
    monkeypatch.setattr(sinks, "_install", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sinks.write_index(lib, eps, conversations.corpus_stats(lib, eps), path)
    assert sinks.current(spark, path) == installed and sinks.read_index(spark, path)[0].turns.count() == 28
    sinks.prune(spark, path)
    assert len(list((tmp_path / "index" / "versions").iterdir())) == 1
    with pytest.raises(LookupError):
        sinks.read_index(spark, (tmp_path / "nothing").as_uri())
