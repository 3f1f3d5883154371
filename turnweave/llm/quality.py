"""Quality scores from histogram gradient-boosted trees over document statistics.

Statistics come from whole texts with numpy. Trees are grown on binned statistics by
second-order gain, depth by depth, and flattened into arrays (feature, cut, leaf value)
in heap order, so scoring walks all documents through a tree with `DEPTH` vector steps.

Edge cases: null and empty texts have all statistics 0 and a score like any other; a
sample of one class gives a constant score; repeated rows score alike; statistics are
finite for any text; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnweave.llm.bytewords import WORD_BYTE, Words, chunks, with_columns
from turnweave.llm.labelled import id_remainder, sample

TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15
LEAST_LEAF, RIDGE = 10, 1.0
THRESHOLD = 0.3
HOLD_OUT = (5, 0)  # rows with crc32(doc_id) mod 5 = 0 are never learnt from
STATISTICS = (
    "log_words", "mean_word_bytes", "sd_word_bytes", "upper_share", "digit_share", "space_share", "symbol_share", "mark_share",
    "line_count", "mean_line_bytes", "repeated_line_share", "distinct_word_share", "repeated_pair_share", "symbols_per_word", "words_per_stop", "top_word_share",
)


def statistics(words: Words) -> np.ndarray:
    """(texts, statistics)."""
    n, raw = words.n_docs, words.original
    doc_of = np.repeat(np.arange(n), words.lengths + 1)[: len(raw)]
    body = np.ones(len(raw), bool)
    body[(words.offsets + words.lengths)[:-1]] = False  # the byte that joins two texts
    size = np.maximum(words.lengths, 1).astype(float)
    count = lambda of: np.bincount(doc_of[of & body], minlength=n)
    upper, digit = count((raw >= 65) & (raw <= 90)), count((raw >= 48) & (raw <= 57))
    space = count((raw == 32) | ((raw >= 9) & (raw <= 13)))
    stop = count((raw == 46) | (raw == 33) | (raw == 63))
    mark = count(np.isin(raw, np.frombuffer(b".,;:'\"-()?", np.uint8)))
    symbol = count(~WORD_BYTE[raw] & ~((raw == 32) | ((raw >= 9) & (raw <= 13)))) - mark
    n_words = words.count.astype(float)
    some = np.maximum(n_words, 1)
    width = (words.end - words.start).astype(float)
    mean = np.bincount(words.doc, weights=width, minlength=n) / some
    spread = np.sqrt(np.maximum(np.bincount(words.doc, weights=width * width, minlength=n) / some - mean * mean, 0))

    edge = np.flatnonzero((raw == 10) | ~body)
    start, stop_at = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(raw)]])
    full = stop_at > start
    start, stop_at = start[full], stop_at[full]
    line_doc = np.searchsorted(words.offsets, start, side="right") - 1
    lines = np.bincount(line_doc, minlength=n) if n else np.zeros(0, int)
    hashes = words.hashes()
    pairs = words.shingles(2)

    def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of each text and the number of its most frequent one."""
        order = np.lexsort((h, doc))
        d, v = doc[order], h[order]
        head = np.ones(len(d), bool)
        head[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
        at = np.flatnonzero(head)
        top = np.zeros(n)
        np.maximum.at(top, d[at], np.diff(np.append(at, len(d))))
        return np.bincount(d[at], minlength=n), top

    line_kinds, _ = distinct(line_doc, words.span_hash(start, stop_at)) if len(start) else (np.zeros(n), None)
    word_kinds, top_word = distinct(words.doc, hashes) if len(hashes) else (np.zeros(n), np.zeros(n))
    pair_kinds, _ = distinct(*pairs) if len(pairs[0]) else (np.zeros(n), None)
    n_pairs = np.maximum(np.bincount(pairs[0], minlength=n), 1)
    return np.stack([
        np.log1p(n_words), mean, spread, upper / size, digit / size, space / size, symbol / size, mark / size,
        lines, words.lengths / np.maximum(lines, 1), 1 - line_kinds / np.maximum(lines, 1), word_kinds / some,
        1 - pair_kinds / n_pairs, symbol / some, n_words / np.maximum(stop, 1), top_word / some,
    ], axis=1).astype(float)


@dataclass
class Forest:
    """Trees as arrays: inner nodes 0..2**DEPTH-2 in heap order, then leaves."""

    feature: np.ndarray  # (trees, 2**DEPTH - 1)
    cut: np.ndarray  # (trees, 2**DEPTH - 1): go right if the value is greater
    leaf: np.ndarray  # (trees, 2**DEPTH)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1 if len(self.leaf) else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (len(leaf) - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Fit a forest to 0/1 labels by histogram gradient boosting on the logistic loss."""
    rate = float(y.mean()) if len(y) else 0.5
    base = float(np.log((rate + 1e-4) / (1 - rate + 1e-4)))
    inner = 2**depth - 1
    if rate in (0.0, 1.0) or not len(y):
        return Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    width = bins + 1
    margin, out = np.full(len(y), base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(y), int)
        for level in range(depth):
            first, k = 2**level - 1, 2**level
            local = node - first
            best = np.full(k, 1e-6)
            for f, e in enumerate(edges):
                cell = local * width + binned[:, f]
                g = np.bincount(cell, weights=grad, minlength=k * width).reshape(k, width).cumsum(axis=1)
                h = np.bincount(cell, weights=hess, minlength=k * width).reshape(k, width).cumsum(axis=1)
                c = np.bincount(cell, minlength=k * width).reshape(k, width).cumsum(axis=1)
                gl, hl, cl = g[:, : len(e)], h[:, : len(e)], c[:, : len(e)]
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain = np.where((cl >= LEAST_LEAF) & (ct - cl >= LEAST_LEAF), gain, -1)
                if not gain.size:
                    continue
                at = gain.argmax(axis=1)
                value = gain[np.arange(k), at]
                better = value > best
                best[better] = value[better]
                feature[first : first + k][better] = f
                cut[first : first + k][better] = e[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        local = node - inner
        leaf = -RATE * np.bincount(local, weights=grad, minlength=inner + 1) / (np.bincount(local, weights=hess, minlength=inner + 1) + RIDGE)
        margin += leaf[local]
        for held, new in zip(out, (feature, cut, leaf), strict=True):
            held.append(new)
    return Forest(np.array(out[0]), np.array(out[1]), np.array(out[2]), base)


def _of_texts(texts: pd.Series) -> np.ndarray:
    parts = [statistics(Words(held)) for _, _, held in chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


def train_model(docs: DataFrame, labels: DataFrame, **bounds) -> Forest:
    """Fit on a bounded sample of labelled documents outside the hold-out."""
    modulus, held = HOLD_OUT
    train = sample(docs, labels, "quality", id_remainder(F.col("doc_id"), modulus) != held, **bounds)
    return boost(_of_texts(train["text"]), train["y"].to_numpy(dtype=float))


def score(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """`docs` with `__tw_score`."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(forest))  # fixed size

    def make(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array(Forest(**shared.value).score(statistics(Words(texts))))]

    return with_columns(docs.drop("__tw_score"), text_col, [T.StructField("__tw_score", T.DoubleType())], make)


def scored_ids(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score) with only ids and texts going through Python."""
    return score(docs.select("doc_id", "text"), forest).select("doc_id", F.col("__tw_score").alias("score"))
