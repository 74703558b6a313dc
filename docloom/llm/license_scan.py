"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

All of it is Spark expressions. The words of a text are runs of letters, digits and non-ASCII characters after A-Z are
lower-cased. A block is a line, or for long lines each window of 128 words at a stride of 64; and, since notices are
wrapped, each such window of the whole text across its line breaks. A block matches a
template if it has at least `threshold` of the template's distinct words. The join orders the templates' words by
their document frequency over all texts, rarest first. Then, for each block:
  prefix filter: it has one of a template's first |T| - need + 1 words (need = ceil(threshold * |T|)), found by an
  inverted index of those words; length filter: it has at least `need` of the templates' words; positional filter:
  what stands before and after the shared word in both orders can still add up to `need`; then the overlap is counted.
No pair that meets the threshold is lost. The templates are a parameter, bounded by MOST_TEMPLATES, and go into the
plan as literals, so nothing is shuffled but the word frequencies.

Defined results: a null or empty text has no words, places or labels and score 0; repeated rows are scanned row by row;
other columns go through whole.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import packed, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels (fixed values).
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
WINDOW, STRIDE = 128, 64
MOST_TEMPLATES = 200
#: Public license notices (fixed values).
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def words_of(lowered: Column | str) -> Column:
    """The words of a lower-cased text. Cutting at what stands between them is several times as fast as matching them."""
    return F.array_remove(F.split(lowered, BETWEEN, -1), "")


def template_words(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """(label, distinct words, sorted) of each template."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; the plan holds {MOST_TEMPLATES} at most")
    table = str.maketrans(UPPER, LOWER)
    out = [(label, sorted(set(re.findall(WORDS, text.translate(table))))) for label, text in templates]
    if any(not words or len(words) > STRIDE for _, words in out):
        raise ValueError(f"a template has 1 to {STRIDE} distinct words")
    return out


def word_order(rows: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by document frequency over all rows of `_words`, rarest first; ties by the word."""
    if not vocabulary:
        return []
    counted = rows.select(F.explode(F.array_intersect(F.lit(vocabulary), "_words")).alias("w")).groupBy("w").count()
    n = {r.w: r["count"] for r in counted.collect()}  # at most the vocabulary
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def phrase_places(words: Column, lowered: Column) -> Column:
    """array of (at, label): the starts of PHRASES, in order. Texts without the last word of a phrase skip the search."""
    last = sorted({p.split()[-1] for p, _ in PHRASES})
    label = None
    at = lambda i, k: F.get(words, i + F.lit(k))

    def place(i: Column) -> Column:
        nonlocal label
        label = None
        for phrase, name in PHRASES:
            parts = phrase.split()
            same = at(i, 0) == parts[0]
            for k, w in enumerate(parts[1:], 1):
                same = same & (at(i, k) == w)
            label = F.when(same, name) if label is None else label.when(same, name)
        return F.struct(i.cast("long").alias("at"), label.alias("label"))

    some = F.lit(False)
    for w in last:
        some = some | F.contains(lowered, F.lit(w))
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    return F.when(some & (F.size(words) > 0), F.filter(F.transform(F.sequence(F.lit(0), F.size(words) - 1), place), lambda x: x["label"].isNotNull())).otherwise(none)


def windows(words: Column) -> Column:
    """The blocks of the words of one line or text: each window."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(words) - WINDOW + STRIDE - 1) / STRIDE).cast("int")))
    return F.transform(starts, lambda k: F.slice(words, k * STRIDE + 1, WINDOW))


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(_row, n_words, places, matches, wrapped) for every row of docs.

    places: (at, label) of each phrase; matches: (label, containment) of each template that a block of a line meets;
    wrapped: those that a block across line breaks meets.
    """
    sets = template_words(templates)
    vocabulary = sorted({w for _, ws in sets for w in ws})
    rows = packed(docs, text).withColumn("_lowered", F.translate("_text", UPPER, LOWER)).drop("_text")
    rows = rows.withColumn("_words", words_of("_lowered"))
    order = word_order(rows.select("_words"), vocabulary)
    rank = {w: k for k, w in enumerate(order)}
    index: dict[str, list[tuple[int, int]]] = {}
    ordered, need = [], []
    for k, (_, ws) in enumerate(sets):
        ordered.append(sorted(ws, key=rank.__getitem__))
        need.append(math.ceil(threshold * len(ws) - 1e-9))
        for p, w in enumerate(ordered[k][: len(ws) - need[k] + 1]):
            index.setdefault(w, []).append((k, p))
    none = F.array().cast("array<struct<label:string,containment:double>>")
    rows = rows.withColumn("n_words", F.size("_words").cast("long")).withColumn("places", phrase_places(F.col("_words"), F.col("_lowered")))
    if not index:
        return rows.select("_row", "n_words", "places", none.alias("matches"), none.alias("wrapped"))
    prefix = [w for w in order if w in index]
    posting = F.create_map(*[x for w in prefix for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("t"), F.lit(p).alias("p")) for k, p in index[w]]))])
    shapes = F.array(*[F.struct(F.lit(sets[k][0]).alias("label"), F.lit(ordered[k]).alias("words"), F.lit(len(ordered[k])).alias("size"), F.lit(need[k]).alias("need")) for k in range(len(sets))])
    # the templates' words in a block, in the global order: all that an overlap can count
    known = lambda block: F.array_intersect(F.lit(order), block)
    blocks = F.flatten(F.transform(F.split("_lowered", "\n", -1), lambda line: F.transform(windows(words_of(line)), known)))
    across = F.transform(windows(F.col("_words")), known)
    some = F.arrays_overlap("_words", F.lit(prefix))
    with_prefix = lambda cond, c: F.when(cond, F.filter(c, lambda b: F.arrays_overlap(b, F.lit(prefix)))).otherwise(F.array().cast("array<array<string>>"))
    rows = rows.withColumn("_blocks", with_prefix(some, blocks)).withColumn("_across", with_prefix(some & F.contains("_lowered", F.lit("\n")), across))

    def matched(block: Column) -> Column:
        def candidates(w: Column) -> Column:
            q = F.array_position(block, w) - 1

            def reachable(x: Column) -> Column:
                shape = F.get(shapes, x["t"])
                bound = 1 + F.least(x["p"], q) + F.least(shape["size"] - x["p"] - 1, F.size(block) - q - 1)
                return (F.size(block) >= shape["need"]) & (bound >= shape["need"])

            return F.transform(F.filter(F.element_at(posting, w), reachable), lambda x: x["t"])

        pairs = F.array_distinct(F.flatten(F.transform(F.array_intersect(block, F.lit(prefix)), candidates)))
        counted = F.transform(pairs, lambda t: F.struct(F.get(shapes, t)["label"].alias("label"), F.get(shapes, t)["need"].alias("need"), F.get(shapes, t)["size"].alias("size"), F.size(F.array_intersect(F.get(shapes, t)["words"], block)).alias("n")))
        return F.transform(F.filter(counted, lambda x: x["n"] >= x["need"]), lambda x: F.struct(x["label"].alias("label"), (x["n"] / x["size"]).alias("containment")))

    matches = lambda c: F.when(F.size(c) > 0, F.flatten(F.transform(c, matched))).otherwise(none)
    return rows.select("_row", "n_words", "places", matches("_blocks").alias("matches"), matches("_across").alias("wrapped"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = lambda c: F.array_sort(F.array_distinct(c))
    return rows.select(
        F.col("_row.doc_id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.at").alias("first_word"),
        F.array_max("places.at").alias("last_word"),
        F.array_join(labels(F.col("places.label")), ",").alias("base_labels"),
        F.array_join(labels(F.concat("places.label", "matches.label", "wrapped.label")), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.concat("matches.containment", "wrapped.containment")), F.lit(0.0))).alias("score"),
    )


def sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> str:
    """The query's rows in DuckDB SQL: every block of a line, and of a whole text of several lines, against every template, without filters."""
    sets = ", ".join("('{}', [{}], {})".format(label, ", ".join(f"'{w}'" for w in words), math.ceil(threshold * len(words) - 1e-9)) for label, words in template_words(templates))
    phrase = lambda parts: " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(parts))
    case = "CASE " + " ".join(f"WHEN {phrase(p.split())} THEN '{name}'" for p, name in PHRASES) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORDS}') AS ws FROM d),
p AS (SELECT r, i, {case} AS label FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE contains(t, 'license'))),
base AS (SELECT r, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS z, list(label) AS labels FROM p WHERE label IS NOT NULL GROUP BY r),
lines AS (SELECT r, regexp_extract_all(line, '{WORDS}') AS ls FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w) UNION ALL SELECT r, ws AS ls FROM w WHERE contains(t, chr(10))),
blocks AS (SELECT r, list_distinct(ls[k * {STRIDE} + 1 : k * {STRIDE} + {WINDOW}]) AS b FROM (SELECT r, ls, unnest(range(0, greatest(0, CAST(floor((len(ls) - {WINDOW} + {STRIDE} - 1) / {STRIDE}) AS INT)) + 1)) AS k FROM lines WHERE len(ls) > 0)),
sets(label, ts, need) AS (VALUES {sets}),
pairs AS (SELECT r, label, len(ts) AS size, need, len(list_intersect(ts, b)) AS n FROM blocks, sets),
found AS (SELECT r, list(label) AS labels, max(n / size) AS best FROM pairs WHERE n >= need GROUP BY r)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(base.a AS BIGINT) AS first_word, CAST(base.z AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(coalesce(base.labels, []))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
  CAST(CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(found.best, 0.0) END AS DOUBLE) AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN found USING (r)"""
