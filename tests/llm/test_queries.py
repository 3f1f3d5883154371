import pytest

from tests.oracle import assert_same, connection
from turnweave.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert_same(QUERIES[name](spark, sf_dir), con, ORACLES[name])


@pytest.mark.parametrize("name", ["op6_toxicity", "op10_quality"])
def test_scores_are_complete_and_reproducible(spark, sf_dir, name):
    first = {r["doc_id"]: r for r in QUERIES[name](spark, sf_dir).collect()}
    again = {r["doc_id"]: r for r in QUERIES[name](spark, sf_dir).collect()}
    assert len(first) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 for r in first.values())
    assert first == again


@pytest.mark.parametrize(("name", "label", "least"), [("op6_toxicity", "toxic", 0.85), ("op10_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    """Area under the curve over rows that training never saw."""
    sf_dir = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [(r["score"], truth[r["doc_id"]]) for r in QUERIES[name](spark, sf_dir).where("held_out").collect() if r["doc_id"] in truth]
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) >= least
