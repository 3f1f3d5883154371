"""What the planner makes of the queries: pushed filters, pruned columns, Python last, no all-pairs joins."""

import re

from turnweave.operators import conversations, episodes, sinks
from turnweave.plans import api, catalogue
from turnweave.sources import adapters
from turnweave.sources.synthetic import library


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    lib, _ = adapters.demo(spark)
    eps = episodes.windows(lib)
    path = (tmp_path / "index").as_uri()
    sinks.write_index(lib, eps, conversations.corpus_stats(lib, eps), path)
    turns = sinks.read_index(spark, path)[0].turns.where("conv_id = 'synthetic:example-1'").select("pos", "action")
    shown = plan(turns)
    assert "EqualTo(conv_id,synthetic:example-1)" in shown
    assert re.search(r"ReadSchema: struct<conv_id:string,pos:int,action:string>", shown)


def test_alignment_runs_after_the_shortlist(spark, sf_dir):
    c = api.Collection(library(spark, sf_dir))
    found = api.match(c, "threads:7", 0, 6)
    shown = plan(found)
    assert shown.count("MapInArrow") == 1 and "TakeOrderedAndProject" in shown and "CartesianProduct" not in shown
    assert all(r["candidates"] == api.CANDIDATES for r in found.collect())  # what the staged shortlist holds


def test_queries_read_their_postings_only(spark, sf_dir):
    shown = plan(api.search(api.Collection(library(spark, sf_dir)), "error purchase"))
    assert "In(token, [error,purchase])" in shown


def test_only_alignment_uses_python(spark, sf_dir):
    for name in ("features", "descriptors", "pair_census", "bm25", "motif3", "sw_best_raw", "corpus_stats", "tfidf"):
        shown = plan(catalogue.QUERIES[name](spark, sf_dir))
        assert not re.search("InPandas|InArrow|ArrowEval|BatchEval|CartesianProduct", shown), name


def test_episodes_need_no_range_join(spark, sf_dir):
    lib = library(spark, sf_dir)
    shown = plan(episodes.with_content(episodes.windows(lib), lib))
    assert "BroadcastNestedLoopJoin" not in shown and "CartesianProduct" not in shown
