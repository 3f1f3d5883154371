"""Words, shingles and hashes of whole texts with numpy, without a Python object per word.

A word is a maximal run of ASCII digits, ASCII letters (A-Z lowered) and any
characters above U+007F; on UTF-8 bytes that is a run of bytes in a fixed class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_B = np.arange(256)
WORD_BYTE = ((_B >= 0x30) & (_B <= 0x39)) | ((_B >= 0x41) & (_B <= 0x5A)) | ((_B >= 0x61) & (_B <= 0x7A)) | (_B >= 0x80)
LOWERED = np.where((_B >= 0x41) & (_B <= 0x5A), _B + 32, _B).astype(np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def times(k: int, factor: int) -> np.uint64:
    """k * factor modulo 2**64."""
    return np.uint64(k * factor & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pd.Series, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, UTF-8 texts) in slices of about `max_bytes`; a longer text is a slice of its own. Null is empty."""
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if held and size + len(b) > max_bytes:
            yield start, i, held
            start, held, size = i, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield start, start + len(held), held


def slices(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """`chunks` of an Arrow column of strings; only one slice at a time becomes Python objects."""
    held = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    start = 0
    while start < len(texts):
        done = int(held[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(held, done + max_bytes, side="right")))
        yield start, stop, [t or b"" for t in texts.slice(start, stop - start).cast(pa.binary()).to_pylist()]
        start = stop


def with_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[list[bytes]], list[pa.Array]]) -> DataFrame:
    """`df` and columns that `make` finds from whole texts; all other columns pass through Arrow as they are, nulls and types included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, held in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *make(held)], [*part.schema.names, *(f.name for f in fields)])

    at = df.columns.index(text_col)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


class Words:
    """All words of several texts: `doc` (index of the text), `start` and `end` (bytes in `raw`)."""

    def __init__(self, texts: list[bytes]):
        self.n_docs = len(texts)
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        joined = b"\n".join(texts)
        self.raw = LOWERED[np.frombuffer(joined, dtype=np.uint8)] if joined else np.zeros(0, np.uint8)
        self.original = np.frombuffer(joined, dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths + 1)])[: self.n_docs]
        inside = np.zeros(len(self.raw) + 2, dtype=np.int8)
        inside[1:-1] = WORD_BYTE[self.raw]
        step = np.diff(inside)
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs) if self.n_docs else np.zeros(0, np.int64)
        self._prefix = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of raw[start:end], by the text alone and not by its place."""
        if self._prefix is None:
            powers = np.cumprod(np.full(len(self.raw) + 1, _BASE, dtype=np.uint64))
            self._prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self._inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(self.raw), inverse, dtype=np.uint64))])
        value = (self._prefix[end] - self._prefix[start]) * self._inverse[start]
        return mix(value ^ ((end - start).astype(np.uint64) << np.uint64(40)))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of every run of `size` words; a text of fewer words, but not none, is one shingle."""
        h, n = self.hashes(), len(self.start)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.concatenate([[0], np.cumsum(self.count)])[:-1]
        place = np.arange(n) - first[self.doc]
        is_head = (place + size <= self.count[self.doc]) | ((place == 0) & (self.count[self.doc] < size))
        left = np.minimum(self.count[self.doc] - place, size)
        total = np.zeros(n, np.uint64)
        for k in range(size):
            take = h[: n - k] if k == 0 else h[k:]
            part = mix(take + times(k + 1, int(_BASE)))
            total[: n - k] += np.where(left[: n - k] > k, part, np.uint64(0))
        return self.doc[is_head], mix(total[is_head])
