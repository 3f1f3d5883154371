"""A row key that spreads copies of one text over all partitions.

``doc_id`` alone may repeat or be null, and a text alone may be a third of the table,
so joins back to documents use both, null-safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID, HASH = "__tw_id", "__tw_hash"


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Key columns (id, 64-bit text hash) to select from `docs`."""
    return [docs[id_col].alias(ID), F.xxhash64(docs[text_col]).alias(HASH)]


def same_key(left: DataFrame, right: DataFrame) -> Column:
    return (left[HASH] == right[HASH]) & left[ID].eqNullSafe(right[ID])
