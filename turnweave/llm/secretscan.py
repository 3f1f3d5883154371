"""Secret scan over a trigram inverted index, in DataFrame operations only.

A rule is a regular expression with a test on its matches. From the expression's parse
tree comes a Boolean trigram query: trigrams that every match must hold, as a conjunction
of alternatives. The index holds (trigram, row key) postings for the trigrams that the
rules name. Postings are intersected per row and query branch; a rule's candidates are
the rows that satisfy its query, and only they are verified with the expression. Rules
with no mandatory trigram (such as a run of hex digits) scan every text.

Spans are code-point offsets, end exclusive, leftmost and non-overlapping per kind.
Edge cases: a null text counts as empty; rows with equal id and text share postings and
each keeps its own output row; a null id is a key like any other; an empty table gives an
empty result; no other column is read.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm.rowkeys import HASH, ID, with_key
from turnweave.llm.storage import materialise


@dataclass(frozen=True)
class Rule:
    """`pattern` in the common subset of Python, Java and RE2; group `group` must have `least` characters; `folded`: ASCII letters in either case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    folded: bool = False
    tight: str = ""  # the same valid matches without a test afterwards


# The first three are the required rules, the rest well-known public token formats.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, tight=r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]+", 0, 16, tight=r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, tight=r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
BASE_KINDS = ("assign", "access", "hex")
MAX_STRINGS = 16  # alternatives kept exact while a query is derived


# --- Boolean trigram queries -------------------------------------------------------------


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _product(left: set[str] | None, right: set[str] | None) -> set[str] | None:
    if left is None or right is None or len(left) * len(right) > MAX_STRINGS:
        return None
    return {x + y for x in left for y in right}


def trigram_query(pattern: str, folded: bool = False) -> list[frozenset[frozenset[str]]]:
    """A conjunction of clauses; a clause is a set of branches, each a set of trigrams that must all occur.

    Every match of `pattern` satisfies every clause with at least one branch. An empty
    conjunction means that the pattern has no mandatory trigram. With `folded`, trigrams
    are lower case and meant for a lower-cased text.
    """
    clauses: list[frozenset[frozenset[str]]] = []

    def flush(run: set[str] | None) -> None:
        branches = frozenset(_trigrams(s) for s in run or {""})
        if all(branches):
            clauses.append(branches)

    def strings(items) -> set[str] | None:
        """The exact finite set of strings of a sequence, or None."""
        run: set[str] | None = {""}
        for op, arg in items:
            run = _product(run, one(op, arg))
            if run is None:
                return None
        return run

    def one(op, arg) -> set[str] | None:
        if op is sre.LITERAL:
            return {chr(arg).lower() if folded else chr(arg)}
        if op is sre.IN:
            if any(kind is not sre.LITERAL for kind, _ in arg) or len(arg) > 8:
                return None
            return {chr(c).lower() if folded else chr(c) for _, c in arg}
        if op is sre.SUBPATTERN:
            return strings(arg[3])
        if op is sre.BRANCH:
            parts = [strings(x) for x in arg[1]]
            return None if any(p is None for p in parts) or sum(map(len, parts)) > MAX_STRINGS else set().union(*parts)
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 1:
            inner = strings(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        return None

    def walk(items) -> None:
        run: set[str] | None = {""}
        for op, arg in items:
            exact = one(op, arg)
            joined = _product(run, exact)
            if joined is not None:
                run = joined
                continue
            flush(run)
            run = exact if exact is not None else {""}
            if exact is None:
                if op is sre.SUBPATTERN:
                    walk(arg[3])
                elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                    walk(arg[2])
        flush(run)

    walk(sre_parser.parse(pattern))
    return list(dict.fromkeys(clauses))


# --- Index, intersection, verification ---------------------------------------------------


def _any_of(grams: set[str]) -> str:
    """A look-ahead for any of the trigrams: first a class of their first characters, then a branch for each of these."""
    coded = lambda text: "".join(f"\\x{{{ord(c):x}}}" for c in text)
    rests: dict[str, list[str]] = {}
    for g in sorted(grams):
        rests.setdefault(g[0], []).append(coded(g[1:]))
    branches = "|".join(f"{coded(first)}(?:{'|'.join(rest)})" for first, rest in rests.items())
    return f"(?=[{coded(rests)}])(?=({branches}))"


def trigram_postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, key) postings for the trigrams that the rules' queries name.

    Trigrams of folded rules are indexed with the prefix "~" over the lower-cased text.
    One pass of a look-ahead alternation finds them, duplicates go before the explode.
    """
    named = {False: set(), True: set()}
    for rule in rules:
        for clause in trigram_query(rule.pattern, rule.folded):
            named[rule.folded] |= set().union(*clause)
    found = []
    for folded, grams in named.items():
        if grams:
            listed = F.array_distinct(F.regexp_extract_all(docs[text_col], F.lit(("(?i)" if folded else "") + _any_of(grams)), F.lit(1)))
            found.append(F.array_distinct(F.transform(listed, lambda g: F.concat(F.lit("~"), F.lower(g)))) if folded else listed)
    every = F.concat(*found) if found else F.array().cast("array<string>")
    return docs.select(*with_key(docs, id_col, text_col), F.explode(every).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, kinds): the rules whose trigram query each row's postings satisfy.

    A row's postings are at most the trigrams that the rules name, whatever its length, so
    the collected set is bounded.
    """
    per_row = postings.groupBy(ID, HASH).agg(F.collect_set("trigram").alias("grams"))
    kinds = []
    for rule in rules:
        query = trigram_query(rule.pattern, rule.folded)
        if query:
            passes = F.lit(True)
            for clause in query:
                branches = [F.size(F.array_except(F.array(*[F.lit("~" * rule.folded + g) for g in sorted(b)]), F.col("grams"))) == 0 for b in sorted(clause, key=sorted)]
                any_branch = branches[0]
                for b in branches[1:]:
                    any_branch = any_branch | b
                passes = passes & any_branch
            kinds.append(F.when(passes, F.lit(rule.kind)))
    listed = F.array_compact(F.array(*kinds)) if kinds else F.array().cast("array<string>")
    return per_row.select(ID, HASH, listed.alias("kinds")).where(F.size("kinds") > 0)


def _let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once; lambda bodies evaluate what they mention for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running_sum(steps: Column, block: int = 512) -> Column:
    """Inclusive running sums of an array, in blocks so that long arrays stay near linear."""

    def sums(values: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
        add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"] + x)).alias("all"))
        return F.aggregate(values, zero, add, lambda acc: acc["all"])

    def in_blocks(values: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))
        local = F.transform(starts, lambda b: sums(F.slice(values, b * block + 1, F.lit(block))))
        return _let(local, lambda parts: F.flatten(F.zip_with(parts, _before(parts), lambda part, held: F.transform(part, lambda x: x + held))))

    def _before(parts: Column) -> Column:
        ends = sums(F.transform(parts, lambda part: F.element_at(part, -1)))
        return F.slice(F.concat(F.array(F.lit(0).cast("long")), ends), F.lit(1), F.size(parts))

    return _let(steps, lambda v: F.when(F.size(v) <= block, sums(v)).otherwise(in_blocks(v)))


def java_pattern(rule: Rule) -> str:
    """The rule's expression as the scan runs it."""
    return ("(?i)" if rule.folded else "") + (rule.tight or rule.pattern)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind) of the rule's valid matches."""
    pattern = F.lit(java_pattern(rule))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    matches = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m).cast("long"))
    tested = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m).cast("long")) if rule.group else matches
    ends = _running_sum(F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: g + m))
    rows = F.transform(
        F.arrays_zip(ends.alias("end"), matches.alias("n"), tested.alias("tested")),
        lambda x: F.struct((x["end"] - x["n"]).alias("start"), F.lit(order).alias("ord"), x["end"].alias("end"), F.lit(rule.kind).alias("kind"), x["tested"].alias("tested")),
    )
    kept = F.filter(rows, lambda x: x["tested"] >= rule.least) if rule.least and not rule.tight else rows
    return F.transform(kept, lambda x: F.struct(x["start"], x["ord"], x["end"], x["kind"]))


NO_SPANS = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `secret_spans`: array of (start, ord, end, kind) by start, then rule order.

    The candidates join by (id, text hash), so copies of one text do not meet in a task.
    """
    found = candidates(trigram_postings(docs, rules, id_col, text_col), rules).withColumnsRenamed({ID: "__tw_cid", HASH: "__tw_chash", "kinds": "__tw_kinds"})
    found = materialise(found, "secret-candidates")  # of known size: broadcast while small, and then texts are not shuffled
    keyed = docs.select("*", *with_key(docs, id_col, text_col))
    joined = keyed.join(found, (keyed[HASH] == found["__tw_chash"]) & keyed[ID].eqNullSafe(found["__tw_cid"]), "left")
    none = F.array().cast(NO_SPANS)
    spans = []
    for order, rule in enumerate(rules):
        text = F.col(text_col)
        asked = F.array_contains("__tw_kinds", rule.kind) if trigram_query(rule.pattern, rule.folded) else F.lit(True)
        spans.append(F.when(asked & text.rlike(java_pattern(rule)), _spans(text, rule, order)).otherwise(none))
    every = F.array_sort(F.concat(*spans))
    return joined.withColumn("secret_spans", every).select(*[c for c in docs.columns if c != "secret_spans"], "secret_spans")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """`docs` with every found span replaced by `mark`; overlapping spans merge into one mark."""
    text = F.col(text_col)
    scanned = scan(docs, text_col=text_col, **options)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["out"]).alias("out"),
    )
    done = F.aggregate("secret_spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    return scanned.withColumn(text_col, F.when(F.size("secret_spans") > 0, done).otherwise(text)).select(*docs.columns)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
