"""Licence scans by a positional rare-token index, in DataFrame functions only.

A template is a licence's name in one of its forms, or a notice with its mandatory key phrases at their
places in the text. All phrases together form a small fixed vocabulary. One pass counts in how many
documents each of its words occurs (a table of that vocabulary's size), which gives the words' IDF.

In a document, the licence words it holds are looked up from the highest IDF down: each word's postings
are the phrases that it is the rarest word of, with its offset, and a posting stays only if the document
has all other words of the phrase too. The places of these rare words give phrase starts; starts at which
the phrase's next rarest word isn't at its relative position go, and what is left is verified word by
word. Of phrases that start at one word the longest counts, so a name with its version or its further
terms isn't taken for the plainer name; a phrase that is denied ("not the", "nor the") doesn't count. The
postings of a template are then intersected by relative position: its key phrases must all lie within
``SLACK`` words of their places in the notice, as seen from the first one. Everything but the count is a
narrow, row-wise plan: no shuffle, no key, nothing to skew.

The base labels need none of this: they name the base phrases that occur at all.

Defined cases: a null or empty text has no words, no labels and score 0; texts are read whole; repeated
rows give repeated rows; licences with equal scores are all listed; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import text_of

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: How far a key phrase may lie from its place, in words, and what denies a phrase right before it or before its article.
SLACK, DENIED, ARTICLES = 8, ("not", "nor", "never", "neither", "without"), ("the", "a", "an", "under")

#: Licence names in the forms they are written in.
NAMES = {
    "mit": ("mit license", "the mit license", "mit licence"),
    "apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license"),
    "apache-1.1": ("apache license version 1 1", "apache software license version 1 1"),
    "bsd": ("bsd license", "bsd 2 clause", "bsd 3 clause"),
    "isc": ("isc license",),
    "gpl-2": ("gnu general public license version 2", "general public license v2", "general public license version 2", "gnu general public license v2"),
    "gpl-3": ("gnu general public license version 3", "general public license v3", "general public license version 3", "gnu general public license v3"),
    "lgpl": ("gnu lesser general public license", "lesser general public license", "gnu library general public license"),
    "agpl": ("gnu affero general public license", "affero general public license"),
    "mpl-2.0": ("mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license v2 0"),
    "mpl-1.1": ("mozilla public license 1 1", "mozilla public license version 1 1"),
    "mpl": ("mozilla public license",),
    "epl": ("eclipse public license",),
    "cc-by": ("creative commons attribution", "cc by"),
    "cc-by-nc": ("creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc"),
    "cc-by-sa": ("creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"),
    "cc-by-nd": ("creative commons attribution noderivatives", "creative commons attribution noderivs", "creative commons attribution no derivatives", "cc by nd"),
    "cc-by-nc-sa": ("creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike", "cc by nc sa"),
    "cc-by-nc-nd": ("creative commons attribution noncommercial noderivatives", "creative commons attribution noncommercial noderivs", "creative commons attribution non commercial no derivatives", "cc by nc nd"),
    "cc0": ("cc0", "creative commons zero"),
    "boost": ("boost software license",),
    "proprietary": ("proprietary and confidential", "confidential and proprietary"),
}
#: (label, words of a notice up to its last key phrase, mandatory key phrases).
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
     ("permission is hereby granted free of charge", "to any person obtaining a copy", "to deal in the software without restriction", "sublicense and or sell copies of the software")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms", "with or without modification", "the following conditions are met")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify and or distribute this software", "for any purpose with or without fee is hereby granted")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
     ("apache license version 2 0", "you may not use this file except in compliance with the license")),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
     ("you can redistribute it and or modify it under the terms of the", "general public license", "as published by the free software foundation")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
     ("this source code form is subject to the terms of the", "mozilla public license v 2 0")),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("this is free and unencumbered software", "released into the public domain")),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
     ("permission is hereby granted free of charge", "to any person or organization obtaining a copy", "covered by this license")),
    ("proprietary", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited",
     ("unauthorized copying of this file via any medium", "is strictly prohibited")),
)


def _template(label: str, notice: str, keys: tuple[str, ...]) -> tuple[str, tuple[tuple[str, int], ...]]:
    """A label and its key phrases with their offsets in the notice's words."""
    words = re.findall(LICENSE_WORD, notice.lower())
    spots = [next(i for i in range(len(words)) if words[i : i + len(k.split())] == k.split()) for k in keys]
    return label, tuple((k, at - spots[0]) for k, at in zip(keys, spots))


#: (label, ((key phrase, offset from the first one), ...)).
TEMPLATES = (*((label, ((name, 0),)) for label, names in NAMES.items() for name in names), *(_template(*x) for x in NOTICES))
PHRASES = tuple(dict.fromkeys([p for _, p in BASE] + [p for _, keys in TEMPLATES for p, _ in keys]))
NUMBER = {p: i for i, p in enumerate(PHRASES)}
SIZE = {p: len(p.split()) for p in PHRASES}
#: For each phrase the longer ones that begin with it, and the words that a template's keys have.
LONGER = {p: [q for q in PHRASES if q.startswith(p + " ")] for p in PHRASES}
#: Words of matched key phrases that make a score of 1.
FULL = 24


def score_of(keys: tuple[tuple[str, int], ...]) -> float:
    """Half for a match, the rest by how much text it stands on."""
    return 0.5 + min(FULL, sum(SIZE[p] for p, _ in keys)) / (2.0 * FULL)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(LICENSE_WORD), 0)


def document_frequencies(worded: DataFrame, words: str = "words") -> dict[str, int]:
    """In how many rows each template word occurs: one count per word of the fixed vocabulary."""
    vocabulary = sorted({w for p in PHRASES for w in p.split()})
    held = F.explode(F.array_intersect(F.col(words), F.array(*map(F.lit, vocabulary))))
    counts = worded.select(held.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return dict.fromkeys(vocabulary, 0) | {r.word: r.n for r in counts.collect()}


def postings_of(frequency: dict[str, int]) -> list[tuple]:
    """(phrase number, phrase, rarest word, its offset, next rarest word, its offset), from the highest IDF down."""
    out = []
    for i, phrase in enumerate(PHRASES):
        order = sorted(enumerate(phrase.split()), key=lambda x: (frequency[x[1]], -x[0]))
        (at, rare), (at2, rare2) = order[0], order[min(1, len(order) - 1)]
        out.append((i, phrase, rare, at, rare2, at2))
    return sorted(out, key=lambda x: (frequency[x[2]], x[2], x[0]))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` and the matches as ``found``."""
    worded = docs.select(F.col(id_column).alias("doc_id"), words_of(text_of(text_column)).alias("words"))
    frequency = document_frequencies(worded)
    index = postings_of(frequency)
    words, rare = F.col("words"), list(dict.fromkeys(x[2] for x in index))
    names = ("phrase", "words", "rare", "at", "rare2", "at2")
    postings = F.array(*(F.struct(*((F.array(*map(F.lit, v.split())) if n == "words" else F.lit(v)).alias(n) for n, v in zip(names, x))) for x in index))
    nothing = F.slice(postings, 1, 0)
    # The document's licence words and the postings that it can have, rarest words first.
    held = F.array_intersect(F.array(*map(F.lit, sorted(frequency))), words)
    alive = F.filter(postings, lambda p: F.size(F.array_except(p["words"], F.col("held"))) == 0)
    looked = worded.withColumn("held", F.when(F.arrays_overlap(words, F.array(*map(F.lit, rare))), held).otherwise(F.array().cast("array<string>")))
    looked = looked.withColumn("alive", F.when(F.size("held") > 0, alive).otherwise(nothing))
    anchors = F.col("alive")["rare"]
    places = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(anchors, w), F.struct(w.alias("word"), i.alias("pos")))), lambda x: x.isNotNull())
    hits = looked.withColumn("hits", F.when(F.size("alive") > 0, places).otherwise(F.slice(places, 1, 0)))
    starts = F.flatten(F.transform("hits", lambda h: F.transform(F.filter("alive", lambda p: p["rare"] == h["word"]), lambda p: F.struct(p.alias("p"), (h["pos"] - p["at"]).alias("start")))))
    aligned = F.filter(starts, lambda s: (s["start"] >= 0) & (F.get(words, s["start"] + s["p"]["at2"]) == s["p"]["rare2"]))
    verified = F.filter(aligned, lambda s: F.slice(words, s["start"] + 1, F.size(s["p"]["words"])) == s["p"]["words"])
    word = lambda i: F.coalesce(F.get(words, i), F.lit(""))
    denied = lambda i: word(i - 1).isin(*DENIED) | (word(i - 1).isin(*ARTICLES) & word(i - 2).isin(*DENIED))
    found = F.transform(verified, lambda s: F.struct(s["p"]["phrase"].alias("phrase"), s["start"].cast("long").alias("start"), denied(s["start"]).alias("denied")))
    rows = hits.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.size("hits") > 0, found).otherwise(F.slice(found, 1, 0)).alias("found"))
    base = F.transform(F.filter("found", lambda x: x["phrase"].isin([NUMBER[p] for _, p in BASE])), lambda x: x["start"])
    rows = rows.withColumn("base", base).withColumn("ids", F.array_distinct(F.col("found")["phrase"]))
    # Where each phrase stands for itself: not denied, and not as the beginning of a longer one.
    of = lambda p: F.transform(F.filter("found", lambda x: x["phrase"] == NUMBER[p]), lambda x: x["start"])

    def own(p: str) -> Column:
        plain = F.transform(F.filter("found", lambda x: (x["phrase"] == NUMBER[p]) & ~x["denied"]), lambda x: x["start"])
        return F.array_except(plain, F.flatten(F.array(*map(of, LONGER[p])))) if LONGER[p] else plain

    has = lambda p: F.array_contains("ids", NUMBER[p])

    def whole(keys: tuple[tuple[str, int], ...]) -> Column:
        if len(keys) == 1:
            return has(keys[0][0]) & (F.size(own(keys[0][0])) > 0)
        near = lambda s, p, off: F.exists(of(p), lambda t: F.abs(t - off - s) <= SLACK)
        return reduce(Column.__and__, (has(p) for p, _ in keys)) & F.exists(own(keys[0][0]), lambda s: reduce(Column.__and__, (near(s, p, off) for p, off in keys[1:])))

    told = [(label, score_of(keys), whole(keys)) for label, keys in TEMPLATES]
    named = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(label).alias("label"), F.lit(s).alias("score"))) for label, s, c in told)))
    rows = rows.withColumn("told", F.when(F.size("found") > 0, named).otherwise(F.slice(named, 1, 0)))
    bases = F.array_compact(F.array(*(F.when(has(p), F.lit(label)) for label, p in BASE)))
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    least = F.when(F.size(bases) > 0, F.lit(0.5)).otherwise(0.0)
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base").alias("first_word"), F.array_max("base").alias("last_word"), joined(bases).alias("base_labels"),
        joined(F.concat(bases, F.col("told")["label"])).alias("labels"), F.greatest(least, F.coalesce(F.array_max(F.col("told")["score"]), F.lit(0.0))).alias("score"), "found",
    )


def license_rows(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("found")


def _oracle() -> str:
    spaced = lambda p: f" {'  '.join(p.split())} "
    at = lambda p: f"CASE WHEN contains(s, '{spaced(p)}') THEN [i - 1 for i in range(1, len(ws) + 1) if " + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(p.split())) + "] ELSE []::BIGINT[] END"
    listed = lambda ws: ", ".join(f"'{w}'" for w in ws)
    word = lambda i: f"CASE WHEN {i} < 1 THEN '' ELSE coalesce(ws[{i}], '') END"
    free = lambda i: f"NOT ({word(i)} IN ({listed(DENIED)}) OR ({word(i)} IN ({listed(ARTICLES)}) AND {word(f'({i}) - 1')} IN ({listed(DENIED)})))"
    own = lambda p: f"list_filter(a{NUMBER[p]}, lambda x: {free('x::BIGINT')}" + "".join(f" AND NOT list_contains(a{NUMBER[q]}, x)" for q in LONGER[p]) + ")"

    def whole(keys: tuple[tuple[str, int], ...]) -> str:
        (first, _), rest = keys[0], keys[1:]
        inner = " AND ".join(f"len(list_filter(a{NUMBER[p]}, lambda t: abs(t - {off} - y) <= {SLACK})) > 0" for p, off in rest)
        return f"len({own(first)}) > 0" if not rest else f"len(list_filter({own(first)}, lambda y: {inner})) > 0"

    told = [f"CASE WHEN {whole(keys)} THEN {{'label': '{label}', 'score': {score_of(keys)}::DOUBLE}} END" for label, keys in TEMPLATES]
    bases = f"list_filter([{', '.join(f'''CASE WHEN len(a{NUMBER[p]}) > 0 THEN '{label}' END''' for label, p in BASE)}], lambda x: x IS NOT NULL)"
    base = " || ".join(f"a{NUMBER[p]}" for _, p in BASE)
    return rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LICENSE_WORD}') AS ws FROM documents
), s AS (
  SELECT doc_id, ws, ' ' || array_to_string(ws, '  ') || ' ' AS s FROM w
), a AS (
  SELECT doc_id, ws, {', '.join(f'{at(p)} AS a{i}' for p, i in NUMBER.items())} FROM s
), t AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, {base} AS base, {bases} AS bases, list_filter([{', '.join(told)}], lambda x: x IS NOT NULL) AS told FROM a
)
SELECT doc_id, n_words, len(base)::BIGINT AS n_base, list_min(base)::BIGINT AS first_word, list_max(base)::BIGINT AS last_word, array_to_string(list_sort(list_distinct(bases)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(bases || list_transform(told, lambda x: x.label))), ',') AS labels,
  greatest(CASE WHEN len(bases) > 0 THEN 0.5 ELSE 0 END::DOUBLE, coalesce(list_max(list_transform(told, lambda x: x.score)), 0))::DOUBLE AS score FROM t
"""


ORACLE = _oracle()
