"""BM25 over token bags, in two modes.

`exact` compares tokens; `phrase` splits tokens and query terms at underscores and matches
runs of parts, also inside longer tokens, as a full-text engine whose tokenizer separates
at underscores does. Postings are (doc, token, tf, length) rows; a query keeps its own terms only. Sorted by token
they are an index: a filter on terms reads the row groups that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions.labels import plain, plain_column

K1, B = 1.2, 0.75
MAX_TERMS = 16


def safe_terms(query: str) -> list[str]:
    """The first sixteen runs of letters and digits; what else the text holds has no meaning."""
    import re

    return re.findall(r"[^\W_]+", query)[:MAX_TERMS]


def postings(docs: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """(doc, token, tf, length)."""
    rows = docs.select(F.col(id_col).alias("doc"), F.size(tokens_col).alias("length"), F.explode(tokens_col).alias("token"))
    return rows.groupBy("doc", "token", "length").agg(F.count("*").alias("tf"))


def sorted_postings(docs: DataFrame, id_col: str = "doc", tokens_col: str = "tokens") -> DataFrame:
    """Postings in the order of their tokens, to be written."""
    return postings(docs, id_col, tokens_col).repartitionByRange("token", "doc").sortWithinPartitions("token", "doc")


def collection(docs: DataFrame, tokens_col: str) -> DataFrame:
    """One row: number of documents and mean length."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(tokens_col)).alias("mean_length"))


def _weigh(tf: Column, length: Column, df: Column, n: Column, mean: Column) -> Column:
    idf = F.ln((n - df + 0.5) / (df + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def score(docs: DataFrame, terms: DataFrame, id_col: str = "doc", tokens_col: str = "tokens") -> DataFrame:
    """(query, doc, score) of every document that holds a term of (query, term); terms count once a query."""
    return score_postings(postings(docs, id_col, tokens_col), collection(docs, tokens_col), terms)


def score_postings(index: DataFrame, totals: DataFrame, terms: DataFrame) -> DataFrame:
    """`score` over postings and collection totals, computed at once or read from a table.

    Document frequencies are counted for the asked terms over all documents; the terms of
    the queries are the small side and the planner broadcasts them by their size.
    """
    terms = terms.select("query", F.col("term").alias("token")).distinct()
    held = index.join(terms.select("token").distinct(), "token", "left_semi")
    df = held.groupBy("token").agg(F.count("*").alias("df"))
    weighed = held.join(df, "token").crossJoin(F.broadcast(totals))  # one row
    weighed = weighed.select("doc", "token", _weigh(F.col("tf"), F.col("length"), F.col("df"), F.col("n_docs"), F.col("mean_length")).alias("w"))
    return weighed.join(terms, "token").groupBy("query", "doc").agg(F.sum("w").alias("score"))


def phrase_tf(parts: Column, phrase: list[str]) -> Column:
    """Number of places of `phrase` in an array of parts."""
    m = len(phrase)
    wanted = F.array(*[F.lit(p) for p in phrase])

    def places(p: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(p) - (m - 1)), lambda i: F.slice(p, i, F.lit(m)) == wanted)
        return F.when(F.size(p) >= m, F.size(at)).otherwise(F.lit(0))

    # bound by a lambda, so that `parts` is evaluated once and not for every place
    return F.element_at(F.transform(F.array(parts), places), 1)


def score_phrases(docs: DataFrame, terms: list[str], id_col: str = "doc", tokens_col: str = "tokens") -> DataFrame:
    """(doc, score) in the phrase mode, for the distinct terms of one query."""
    spark = SparkSession.getActiveSession()
    phrases = [p for p in dict.fromkeys(tuple(x for x in plain(t).split("_") if x) for t in terms) if p]
    if not phrases:
        return spark.createDataFrame([], f"doc {docs.schema[id_col].dataType.simpleString()}, score double")
    parts = F.flatten(F.transform(tokens_col, lambda t: F.filter(F.split(plain_column(t), "_"), lambda x: x != "")))
    rows = docs.select(F.col(id_col).alias("doc"), parts.alias("parts"))
    rows = rows.select("doc", F.size("parts").alias("length"), *[phrase_tf(F.col("parts"), list(p)).alias(f"t{i}") for i, p in enumerate(phrases)])
    sums = rows.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"), *[F.sum((F.col(f"t{i}") > 0).cast("int")).alias(f"d{i}") for i in range(len(phrases))])
    joined = rows.crossJoin(F.broadcast(sums))  # one row
    total = F.lit(0.0)
    for i in range(len(phrases)):
        total = total + F.when(F.col(f"t{i}") > 0, _weigh(F.col(f"t{i}"), F.col("length"), F.col(f"d{i}"), F.col("n_docs"), F.col("mean_length"))).otherwise(0.0)
    some = F.lit(False)
    for i in range(len(phrases)):
        some = some | (F.col(f"t{i}") > 0)
    return joined.where(some).select("doc", total.alias("score"))


def tfidf(docs: DataFrame, queries: DataFrame, max_features: int = 60000, min_df: int = 2) -> DataFrame:
    """(query, doc, score): cosine of sublinear tf-idf vectors over words and word pairs.

    `docs` and `queries` have (id, words). The vocabulary is the `max_features` most frequent
    terms of at least `min_df` documents, ties by term.
    """
    def grams(rows: DataFrame) -> DataFrame:
        two = F.expr("transform(slice(words, 1, greatest(size(words) - 1, 0)), (w, i) -> concat(w, ' ', words[i + 1]))")
        return rows.select("id", F.explode(F.concat("words", two)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))

    n = docs.agg(F.count("*").alias("n_docs"))
    held = grams(docs)
    vocabulary = held.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    vocabulary = vocabulary.orderBy(F.desc("total"), "term").limit(max_features)
    idf = vocabulary.crossJoin(F.broadcast(n)).select("term", (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))

    def vectors(rows: DataFrame) -> DataFrame:
        w = rows.join(idf, "term").select("id", "term", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
        norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return w.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))

    left, right = vectors(grams(queries)).withColumnsRenamed({"id": "query", "w": "qw"}), vectors(held).withColumnRenamed("id", "doc")
    return left.join(right, "term").groupBy("query", "doc").agg(F.sum(F.col("qw") * F.col("w")).alias("score"))
