"""License scan by an exact set-similarity join, in DataFrame operations only.

A text block is a line. A template matches a block when the share of the template's
distinct words that the block holds is at least `threshold`. The join is exact: template
words are put in global frequency order (rarest first, counted over all documents); by
the prefix filter a match must share one of a template's first |T| - need + 1 words; the
length filter drops blocks with too few template words, the positional filter pairs whose
remaining words cannot reach `need`; what is left is verified by intersection.

The fixed phrases of the base labels are found in whole texts as consecutive words.

Edge cases: null and wordless texts have no labels and score 0; a null id is a key like
any other; repeated rows each keep their row; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm.rowkeys import HASH, ID, with_key
from turnweave.llm.sqlwords import IN_WORD, OUT_OF_WORD, let, word_count

# The phrases and labels of the base, and wordings of well-known licenses.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the Apache License. You may obtain a copy of the License at apache.org"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
THRESHOLD = 0.85


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall("[0-9a-z]+", text.lower())))


def _either(words: list[str]) -> str:
    """A word-bounded alternation, one branch per first letter."""
    by_letter: dict[str, list[str]] = {}
    for w in sorted(words):
        by_letter.setdefault(w[0], []).append(w[1:])
    branches = "|".join(f"{c}(?:{'|'.join(sorted(rest, reverse=True))})" for c, rest in sorted(by_letter.items()))
    return f"(?i)(?<!{IN_WORD})(?:{branches})(?!{IN_WORD})"


def global_order(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> list[str]:
    """`vocabulary` by its number of occurrences in all documents, rarest first, ties by code point.

    One sum per template word comes back, so its size depends on the templates alone.
    """
    seen = docs.select(F.explode(F.regexp_extract_all(docs[text_col], F.lit(_either(vocabulary)), F.lit(0))).alias("w"))
    counts = {r["w"]: r["n"] for r in seen.groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def template_matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, line, label, template, containment) for every line and template at or above the threshold."""
    spark = SparkSession.getActiveSession()
    sets = [template_words(t) for _, t in templates]
    order = global_order(docs, sorted(set().union(*sets)), text_col)
    rank = {w: i for i, w in enumerate(order)}
    prefixes = []
    for t, ((label, _), words) in enumerate(zip(templates, sets, strict=True)):
        words = sorted(words, key=rank.__getitem__)
        need = math.ceil(threshold * len(words) - 1e-9)
        prefixes += [(w, t, label, i, need, words) for i, w in enumerate(words[: len(words) - need + 1])]
    table = spark.createDataFrame(prefixes, "word string, template int, label string, i int, need int, words array<string>")
    filtered = F.lit(_either(sorted({p[0] for p in prefixes})))

    lines = docs.where(docs[text_col].rlike(_either(sorted({p[0] for p in prefixes}))))
    lines = lines.select(*with_key(docs, id_col, text_col), F.posexplode(F.split(docs[text_col], "\n", -1)).alias("line", "block"))
    lines = lines.where(F.regexp_like("block", filtered))
    found = F.transform(F.regexp_extract_all("block", F.lit(_either(order)), F.lit(0)), lambda w: F.lower(w))
    in_order = F.array_intersect(F.array(*[F.lit(w) for w in order]), found)
    held = lines.select(ID, HASH, "line", in_order.alias("held")).select("*", F.posexplode("held").alias("j", "word"))
    pairs = held.join(F.broadcast(table), "word")  # one row per word in the templates' prefixes
    size, j, i = F.size("held"), F.col("j"), F.col("i")
    pairs = pairs.where(size >= F.col("need"))
    pairs = pairs.where(F.least(i, j) + 1 + F.least(F.size("words") - i - 1, size - j - 1) >= F.col("need"))
    # of several shared prefix words the first one stands for the pair
    pairs = pairs.where(F.when(i > 0, ~F.arrays_overlap(F.slice("words", F.lit(1), i), "held")).otherwise(F.lit(True)))
    shared = F.size(F.array_intersect("words", "held"))
    return pairs.where(shared >= F.col("need")).select(ID, HASH, "line", "label", "template", (shared / F.size("words")).alias("containment"))


def phrase_places(text: Column) -> Column:
    """Array of (start, label): word numbers at which a phrase's words stand consecutively."""
    one_of = "|".join(p.replace(" ", OUT_OF_WORD + "+") for p in PHRASES)
    pattern = F.lit(f"(?i)(?<!{IN_WORD})(?:{one_of})(?!{IN_WORD})")
    named = F.create_map(*[F.lit(x) for p, label in PHRASES.items() for x in (p[0], label)])
    lengths = F.create_map(*[F.lit(x) for p in PHRASES for x in (p[0], len(p.split()))])
    letters = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.lower(F.substring(m, 1, 1)))
    steps = F.zip_with(F.transform(F.split(text, pattern, -1), word_count), letters, lambda g, c: F.struct(g.alias("gap"), c.alias("letter")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,label:string>>").alias("all"))

    def add(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        place = F.struct(start.alias("start"), named[s["letter"]].alias("label"))
        return F.struct((start + lengths[s["letter"]]).alias("at"), F.concat(acc["all"], F.array(place)).alias("all"))

    places = let(F.filter(steps, lambda s: s["letter"].isNotNull()), lambda v: F.aggregate(v, zero, add, lambda acc: acc["all"]))
    return F.when(text.rlike(f"(?i)(?<!{IN_WORD})(?:{one_of})(?!{IN_WORD})"), places).otherwise(F.array().cast("array<struct<start:bigint,label:string>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Key, `n_words`, `places`, `template_labels` and `score` of every document; texts are not shuffled.

    The score is the largest containment of a matching template, or 1 where a phrase stands.
    """
    best = template_matches(docs, id_col=id_col, text_col=text_col, **options).groupBy(ID, HASH)
    best = best.agg(F.collect_set("label").alias("template_labels"), F.max("containment").alias("containment"))
    best = best.withColumnsRenamed({ID: "__tw_bid", HASH: "__tw_bhash"})
    base = docs.select(*with_key(docs, id_col, text_col), word_count(docs[text_col]).alias("n_words"), phrase_places(docs[text_col]).alias("places"))
    joined = base.join(best, (base[HASH] == best["__tw_bhash"]) & base[ID].eqNullSafe(best["__tw_bid"]), "left")
    return joined.select(
        ID,
        HASH,
        "n_words",
        "places",
        F.coalesce("template_labels", F.array().cast("array<string>")).alias("template_labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
