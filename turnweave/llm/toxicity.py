"""Toxic spans and document scores from a linear-chain conditional random field.

Tags are 0 (clean) and 1 (toxic) over the words of a text; a chain is a run of up to
`CHAIN` consecutive words of one document. Features of a word are its hash and the hashes
of its leading bytes, so that inflected and compounded forms share weights. Labels exist
for documents only, so a word of a toxic training document is labelled 1 if one of its
features occurs in toxic documents far more often than in clean ones. The field is fitted
by gradient ascent on the conditional likelihood; the forward-backward marginals give each
word's probability, and a logistic model over their sum, maximum and mean gives the score.

Edge cases: null and wordless texts get the score of no evidence; texts of any length are
scored whole, in chains; a sample with one class only gives a constant score, its rate of
toxic documents; repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnweave.llm.bytewords import Words, chunks, times, with_columns
from turnweave.llm.labelled import id_remainder, sample

CHAIN = 64
PREFIXES = (4, 5, 6, 7, 8, 9, 10)
BUCKETS = 1 << 20
THRESHOLD = 0.7
HOLD_OUT = (3, 1)  # rows with crc32(doc_id) mod 3 = 1 are never learnt from
MIN_DOCS, MIN_SHARE = 3, 0.6
ROUNDS = 40
SLICE_BYTES = 1 << 18  # of training texts whose features are held at once


@dataclass
class Model:
    weights: np.ndarray  # (BUCKETS,) log odds of tag 1 by feature bucket
    bias: float
    moves: np.ndarray  # (2, 2) transition scores
    last: np.ndarray  # logistic weights over _summary
    prior: float


@dataclass
class _Places:
    """Of all training words: their document and each document's number of words."""

    doc: np.ndarray
    count: np.ndarray
    n_docs: int


def _featured(texts: pd.Series) -> Iterator[tuple[int, Words, np.ndarray]]:
    """(first document, words, features) slice by slice; all features at once would be eight numbers a word."""
    for start, _, held in chunks(texts, SLICE_BYTES):
        words = Words(held)
        yield start, words, features(words)


def features(words: Words) -> np.ndarray:
    """(words, 1 + len(PREFIXES)) feature buckets; bucket 0 stands for "word shorter than the prefix"."""
    length = words.end - words.start
    out = np.zeros((len(length), 1 + len(PREFIXES)), np.int32)
    out[:, 0] = 1 + (words.hashes() % np.uint64(BUCKETS - 1)).astype(np.int32)
    for c, k in enumerate(PREFIXES):
        has = length > k
        h = words.span_hash(words.start[has], words.start[has] + k) ^ times(k, 0x9E3779B97F4A7C15)
        out[has, 1 + c] = 1 + (h % np.uint64(BUCKETS - 1)).astype(np.int32)
    return out


def _chains(words: Words | _Places, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per-word values as a (chains, CHAIN) matrix, the mask of real words, and each word's flat place."""
    first = np.concatenate([[0], np.cumsum(words.count)])[:-1]
    place = np.arange(len(values)) - first[words.doc]
    per_doc = -(-words.count // CHAIN)
    chain = np.concatenate([[0], np.cumsum(per_doc)])[:-1][words.doc] + place // CHAIN
    flat = chain * CHAIN + place % CHAIN
    n = int(per_doc.sum())
    matrix, mask = np.zeros(n * CHAIN), np.zeros(n * CHAIN, bool)
    matrix[flat], mask[flat] = values, True
    return matrix.reshape(n, CHAIN), mask.reshape(n, CHAIN), flat


def marginals(emit: np.ndarray, mask: np.ndarray, moves: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """`_marginals` over blocks of chains, which stay in the cache."""
    p, counts = np.zeros(emit.shape), np.zeros((2, 2))
    for i in range(0, len(emit), block):
        p[i : i + block], c = _marginals(emit[i : i + block], mask[i : i + block], moves)
        counts += c
    return p, counts


def _marginals(emit: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: P(tag = 1) of each word and the expected transition counts (2, 2).

    `emit` is the score of tag 1 against tag 0. Padding stands at the end of a chain, where
    the backward message is flat.
    """
    n, width = emit.shape
    trans = np.exp(moves - moves.max())
    odds = np.exp(np.clip(emit, -30, 30))
    fwd, back = np.empty((width, n, 2)), np.ones((width, n, 2))
    state = np.ones((n, 2))
    for t in range(width):
        if t:
            state = state @ trans
        state[:, 1] *= odds[:, t]
        state /= state.sum(axis=1, keepdims=True)
        fwd[t] = state
    state = np.ones((n, 2))
    for t in range(width - 2, -1, -1):
        ahead = state.copy()
        ahead[:, 1] *= odds[:, t + 1]
        state = ahead @ trans.T
        state /= state.sum(axis=1, keepdims=True)
        state = np.where(mask[:, t + 1, None], state, 0.5)
        back[t] = state
    both = fwd * back
    p = (both[:, :, 1] / both.sum(axis=2)).T * mask
    counts = np.zeros((2, 2))
    for t in range(width - 1):
        real = mask[:, t + 1]
        if not real.any():
            break
        right = back[t + 1, real].copy()
        right[:, 1] *= odds[real, t + 1]
        joint = fwd[t, real][:, :, None] * trans[None] * right[:, None, :]
        counts += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p, counts


def _telling(texts: pd.Series, toxic: np.ndarray) -> np.ndarray:
    """(BUCKETS,) whether a feature is far more common in toxic documents."""
    n_toxic, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for start, words, feats in _featured(texts):  # a document lies in one slice
        for column in feats.T:  # one kind of feature at a time keeps the pairs of (document, feature) small
            pairs = np.unique(words.doc * BUCKETS + column)
            bucket = pairs % BUCKETS
            np.add.at(n_toxic, bucket, toxic[pairs // BUCKETS + start])
            np.add.at(n, bucket, 1)
    seen = np.flatnonzero(n)
    n_toxic, n = n_toxic[seen], n[seen]
    share, prior = n_toxic / n, toxic.mean()
    # Chernoff's bound on such a share by chance, for as many features as were seen
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = n * (share * np.log(share / prior) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - prior)), 0))
    telling = np.zeros(BUCKETS, bool)
    telling[seen] = (n_toxic >= MIN_DOCS) & (share >= MIN_SHARE) & (np.nan_to_num(surprise) >= np.log(len(seen) + 1))
    telling[0] = False
    return telling


def _induced(texts: pd.Series, toxic: np.ndarray) -> tuple[_Places, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and labels of all words, the buckets of all features of words of label 1, and where these occur.

    A word of a toxic document has label 1 where a feature of it is telling. Occurrences are
    (word, index of the bucket); of all other features nothing is kept.
    """
    telling, known = _telling(texts, toxic), np.zeros(BUCKETS, bool)
    doc, count, y = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for start, words, feats in _featured(texts):
        hot = telling[feats].any(axis=1) & (toxic[words.doc + start] == 1)
        known[feats[hot]] = True
        doc.append((words.doc + start).astype(np.int32)), count.append(words.count), y.append(hot)
    known[0] = False
    places = _Places(np.concatenate(doc), np.concatenate(count), len(texts))
    bucket = np.flatnonzero(known)
    word_i, bucket_i, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for _, words, feats in _featured(texts):
        word, kind = np.nonzero(known[feats])
        word_i.append(word + before), bucket_i.append(np.searchsorted(bucket, feats[word, kind]))
        before += len(feats)
    return places, np.concatenate(y), bucket, np.concatenate(word_i), np.concatenate(bucket_i)


def _summary(words: Words | _Places, p: np.ndarray) -> np.ndarray:
    n = words.n_docs
    total = np.bincount(words.doc, weights=np.where(p >= 0.2, p, 0), minlength=n)  # the background of long texts does not add up
    top = np.zeros(n)
    np.maximum.at(top, words.doc, p)
    return np.stack([np.ones(n), np.log1p(total), top, total / np.maximum(words.count, 1), np.minimum(total, 3)], axis=1)


def word_probabilities(words: Words, model: Model) -> np.ndarray:
    if not len(words.start):
        return np.zeros(0)
    emit, mask, flat = _chains(words, model.bias + model.weights[features(words)].sum(axis=1))
    return marginals(emit, mask, model.moves)[0].reshape(-1)[flat]


def scores(words: Words, p: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_summary(words, p) @ model.last, -30, 30)))


def fit(train: pd.DataFrame, rounds: int = ROUNDS) -> Model:
    """Fit field and document model to (text, y)."""
    toxic = train["y"].to_numpy(dtype=float) if len(train) else np.zeros(0)
    prior = float(toxic.mean()) if len(toxic) else 0.0
    model = Model(np.zeros(BUCKETS, np.float64), -4.0, np.zeros((2, 2)), np.array([np.log((prior + 1e-4) / (1 - prior + 1e-4)), 0, 0, 0, 0.0]), prior)
    if prior in (0.0, 1.0) or not len(toxic):
        return model
    words, y, bucket, word_i, bucket_i = _induced(train["text"], toxic)
    y_m, mask, flat = _chains(words, y)
    pairs = np.zeros((2, 2))
    real = mask[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            pairs[a, b] = ((y_m[:, :-1] == a) & (y_m[:, 1:] == b) & real).sum()
    emit, weights = y_m, np.zeros(len(bucket))  # other features keep weight 0
    count = np.maximum(np.bincount(bucket_i, minlength=len(bucket)), 1)
    step_w, step_b, step_m = np.zeros(len(bucket)), 0.0, np.zeros((2, 2))
    for left in range(rounds, -1, -1):
        held = model.bias + np.bincount(word_i, weights=weights[bucket_i], minlength=len(y))
        emit.reshape(-1)[flat] = held
        del held  # of arrays with a number a word, only those in use are held
        p, expected = marginals(emit, mask, model.moves)
        p = p.reshape(-1)[flat]
        if not left:
            break
        error = np.subtract(y, p, out=p)
        step_w = 0.7 * step_w + np.bincount(bucket_i, weights=error[word_i], minlength=len(bucket)) / count - 0.002 * weights
        step_b = 0.7 * step_b + error.mean() * 4
        step_m = 0.7 * step_m + (pairs - expected) / len(y) * 4
        del error, p
        weights += step_w
        model.bias += step_b
        model.moves += step_m
    model.weights[bucket] = weights
    x = _summary(words, p)
    model.last = _logistic(x, toxic)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method with step halving."""
    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * ridge * (w @ w))

    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - q) - ridge * w
        hess = (x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step, now, size = np.linalg.solve(hess, grad), loss(w), 1.0
        while loss(w + size * step) > now and size > 1e-6:
            size /= 2
        w = w + size * step
        if size * np.abs(step).max() < 1e-6:
            break
    return w


def train_model(docs: DataFrame, labels: DataFrame, **bounds) -> Model:
    """Fit on a bounded sample of labelled documents outside the hold-out."""
    modulus, held = HOLD_OUT
    return fit(sample(docs, labels, "toxic", id_remainder(F.col("doc_id"), modulus) != held, **bounds))


def score(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = False) -> DataFrame:
    """`docs` with `__tw_score`, and with `spans` also `toxic_spans`: array of (start, end, p).

    Spans are code-point offsets of words with a marginal of 0.5 or more, adjacent words merged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # BUCKETS doubles: fixed size

    def make(texts: list[bytes]) -> list[pa.Array]:
        words, m = Words(texts), Model(**shared.value)
        p = word_probabilities(words, m)
        out = [pa.array(scores(words, p, m))]
        if spans:
            found: list[list[dict]] = [[] for _ in texts]
            for doc, start, end, q in _spans(words, p):
                found[doc].append({"start": start, "end": end, "p": q})
            out.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))))
        return out

    base = docs.drop("__tw_score", "toxic_spans") if spans else docs.drop("__tw_score")
    added = [T.StructField("__tw_score", T.DoubleType())]
    if spans:
        span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])
        added.append(T.StructField("toxic_spans", T.ArrayType(span)))
    return with_columns(base, text_col, added, make)


def _spans(words: Words, p: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    hot = np.flatnonzero(p >= 0.5)
    if not len(hot):
        return
    points = np.concatenate([[0], np.cumsum((words.original & 0xC0) != 0x80)])  # code points before each byte
    cut = np.flatnonzero((np.diff(hot) > 1) | (np.diff(words.doc[hot]) > 0)) + 1
    for run in np.split(hot, cut):
        doc = int(words.doc[run[0]])
        base = points[words.offsets[doc]]
        yield doc, int(points[words.start[run[0]]] - base), int(points[words.end[run[-1]]] - base), float(p[run].max())


def scored_ids(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) with only ids and texts going through Python."""
    return score(docs.select("doc_id", "text"), model).select("doc_id", F.col("__tw_score").alias("score"))
