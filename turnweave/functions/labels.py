"""Column expressions over labels, texts and numbers. Those with SQL text for arguments and results nest in lambdas."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnweave.schema import ACTIONS, MOVES, ROLE_ACTIONS, TRUSTED

WORDS = r"[\\p{L}\\p{N}_]+"
TERMS = r"[\\p{L}\\p{N}]+"


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def clean_label(x: str) -> str:
    """Lower case, other runs than letters and digits to one underscore, none at the ends; empty is "unknown"."""
    return f"coalesce(nullif(trim(BOTH '_' FROM regexp_replace(lower({x}), '[^a-z0-9]+', '_')), ''), 'unknown')"


def map_action(x: str, default: str = "'unknown'") -> str:
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in ACTIONS.items())
    return f"coalesce(try_element_at(map({pairs}), {x}), {default})"


def move_group(x: str) -> str:
    return f"CASE WHEN {x} IN ({quoted(ROLE_ACTIONS)}) THEN 'unknown' WHEN {x} IN ({quoted(MOVES)}) THEN {x} ELSE 'other' END"


def trusted(x: str) -> str:
    return f"{x} IN ({quoted(TRUSTED)})"


def words(x: str) -> str:
    """Lower-cased words, letters of any script, digits and underscores."""
    return f"regexp_extract_all(lower({x}), '{WORDS}', 0)"


def _marked() -> dict[str, str]:
    """Lower-case letters that are a letter from a to z under one combining mark, and that letter; letters under two marks stay."""
    apart = ((chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x1F00))
    return {c: d[0] for c, d in apart if len(d) == 2 and "a" <= d[0] <= "z" and unicodedata.combining(d[1])}


MARKED = _marked()


def plain(text: str) -> str:
    """Lower case, single marks taken off."""
    return text.lower().translate(str.maketrans(MARKED))


def plain_column(x: Column) -> Column:
    return F.translate(F.lower(x), "".join(MARKED), "".join(MARKED.values()))


def terms(x: str) -> str:
    return f"regexp_extract_all(translate(lower({x}), '{''.join(MARKED)}', '{''.join(MARKED.values())}'), '{TERMS}', 0)"


# What counts as white space when texts are compared, ASCII separators and all Unicode spaces.
SPACES = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def stripped(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, f"^{SPACES}+|{SPACES}+$", "")


def single_spaced(x: Column) -> Column:
    """Stripped, with every inner run of white space as one blank."""
    return F.regexp_replace(stripped(x), f"{SPACES}+", " ")


def entropy(values: str) -> str:
    """Normalised entropy of an array; an array of one kind gives 0."""
    share = f"transform(array_distinct({values}), v -> size(filter({values}, w -> w = v)) / size({values}))"
    total = f"aggregate({share}, 0D, (a, p) -> a - p * ln(p))"
    return f"(abs({total}) / ln(greatest(2, size(array_distinct({values})))))"


def color_bins(kind: str) -> str:
    """Bin number for the map's colours: kind is speakers, reach or known."""
    return {
        "speakers": "least(speakers, 4)",
        "reach": "CASE WHEN reach IS NULL THEN 0 WHEN reach <= 1 THEN 1 WHEN reach <= 2 THEN 2 WHEN reach <= 4 THEN 3 ELSE 4 END",
        "known": "CASE WHEN known < 0.1 THEN 0 WHEN known < 0.5 THEN 1 WHEN known < 0.9 THEN 2 ELSE 3 END",
    }[kind]


def compact_number(x: str) -> str:
    """1.2M and 3.4K style numbers."""
    return f"CASE WHEN {x} >= 1000000 THEN concat(format_number(round({x} / 1000000, 1), 1), 'M') WHEN {x} >= 1000 THEN concat(format_number(round({x} / 1000, 1), 1), 'K') ELSE cast({x} AS STRING) END"


def jitter(multiplier: int) -> str:
    """Deterministic map jitter of an episode id, in [-0.006, 0.006)."""
    return f"((pmod(episode_id * {multiplier}, 4294967296) / 4294967296D - 0.5D) * 0.012D)"


JITTER_X, JITTER_Y = 2654435761, 1597334677
