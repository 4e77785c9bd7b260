"""Operator 11: licence scans by a positional rare-token index, by DataFrame functions only.

A template is a run of words with mandatory phrases inside. One pass over the corpus counts the documents that
hold each licence word; a template's postings are its two mandatory words of highest IDF, with their places in
it. A second pass looks each file's words up: where the rarest stands, the template would begin so many words
before; the second rarest must stand at its own place from there; then the mandatory phrases are compared word by
word. As every mandatory phrase holds its template's rarest word or stands at a fixed distance from it, no place
is missed. Nothing is shuffled but the counts of licence words.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .lines import held

#: Separators, once A-Z are lower-case.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    #: Words between bars are mandatory.
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.replace("|", " ").split()

    @property
    def must(self) -> list[int]:
        """Places of the mandatory words."""
        found, at = [], 0
        for i, part in enumerate(self.text.split("|")):
            n = len(part.split())
            found += range(at, at + n) if i % 2 else []
            at += n
        return found


#: Phrases and labels of the contract, then notices of public licences.
TEMPLATES = (
    Template("mit", "|under the mit license|", True),
    Template("apache-2", "|apache license version 2|", True),
    Template("cc-by-nc", "|cc by nc|", True),
    Template("mit", "|permission is hereby granted free of charge to any person obtaining a copy of this software| and associated documentation files"),
    Template("apache-2", "|you may not use this file except in compliance with the license| you may obtain a copy of the license at"),
    Template("gpl-2", "this program is licensed under the |gnu general public license version 2|"),
    Template("gpl-2", "the terms of the |gnu general public license as published by the free software foundation either version 2|"),
    Template("gpl-3", "this work is licensed under the |gnu general public license version 3|"),
    Template("gpl-3", "the terms of the |gnu general public license as published by the free software foundation either version 3|"),
    Template("lgpl", "the terms of the |gnu lesser general public license| as published by the free software foundation"),
    Template("agpl-3", "the terms of the |gnu affero general public license| as published by the free software foundation"),
    Template("bsd", "|redistribution and use in source and binary forms with or without modification are permitted| provided that the following conditions are met"),
    Template("isc", "|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted|"),
    Template("mpl-2", "this source code form is |subject to the terms of the mozilla public license v 2 0|"),
    Template("epl-2", "made available under the terms of the |eclipse public license| v 2 0"),
    Template("boost", "distributed under the |boost software license version 1 0|"),
    Template("unlicense", "|this is free and unencumbered software released into the public domain|"),
    Template("zlib", "|this software is provided as is without any express or implied warranty| in no event will the authors be held liable"),
    Template("cc0", "|cc0 1 0| universal"),
    Template("cc-by", "this work is licensed under a |creative commons attribution 4 0 international license|"),
    Template("cc-by-sa", "|cc by sa|"),
    Template("cc-by-nc", "this work is licensed under a |creative commons attribution noncommercial|"),
)


class Entry(NamedTuple):
    """A template's words, their weights (IDF in thousandths, rounded), and its one or two rarest mandatory words' places."""

    words: list[str]
    weights: list[int]
    must: list[int]
    rare: list[int]


def words(text: str) -> Column:
    """Lower-cased words with one space between. The Kelvin sign, whose lower case would be an ASCII letter, is put aside."""
    lower = F.lower(F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("K"), F.lit("ƻ")))
    return F.trim(F.regexp_replace(lower, APART, " "))


def index(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> list[Entry]:
    """Counts the documents that hold each word of the templates, over all documents: at most one row a word comes to the driver."""
    known = sorted({w for t in templates for w in t.words})
    # The empty word counts documents.
    each = docs.select(F.explode(F.concat(F.array_intersect(F.split(words(text_col), " "), F.array(*map(F.lit, known))), F.array(F.lit("")))).alias("w"))
    df = {r.w: r.n for r in each.groupBy("w").agg(F.count("*").alias("n")).collect()}
    weight = {w: math.floor(1000 * math.log((df.get("", 0) + 1) / (df.get(w, 0) + 1)) + 0.5) + 1 for w in known}
    entries = []
    for t in templates:
        first = {}
        for k in t.must:
            first.setdefault(t.words[k], k)
        rare = sorted(first.values(), key=lambda k: (-weight[t.words[k]], k))[:2]
        entries.append(Entry(t.words, [weight[w] for w in t.words], t.must, rare))
    return entries


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per row of docs: id, n_words, matches.

    matches: array of (template, label, base, start, length, share, verified) by start, for each place where a template's two rarest
    words stand at their distance. share: how much of the template's weight stands at its place; verified: all mandatory
    phrases do. start counts words from 0 and is below 0 where a file begins inside a template. Null text counts as empty:
    no words, no matches. Repeated rows and rows without an id are files each. Other columns aren't read.
    """
    entries = index(docs, text_col, templates)
    number = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<int>")
    postings: dict[str, list[int]] = {}
    for i, e in enumerate(entries):
        postings.setdefault(e.words[e.rare[0]], []).append(i)
    lookup = F.create_map(*(x for w, ids in postings.items() for x in (F.lit(w), number(ids))))
    known = F.array(*(F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.array(*map(F.lit, e.words)).alias("words"), number(e.weights).alias("weights"), number(e.must).alias("must"), F.lit(e.rare[0]).alias("k"), F.lit(e.rare[-1]).alias("k2")) for t, e in zip(templates, entries)))
    d = held(docs.select(F.col(id_col).alias("id"), words(text_col).alias("t")), w=F.when(F.col("t") != "", F.split("t", " ")).otherwise(F.array().cast("array<string>"))).drop("t")
    d = held(d, at=F.filter(F.transform("w", lambda x, i: F.when(x.isin(list(postings)), i)), lambda i: i.isNotNull()))
    place = lambda i, k: F.get("w", i + k)
    stands = lambda start, t, k: F.coalesce(place(start, k) == F.get(t.words, k), F.lit(False))
    begins = F.flatten(F.transform("at", lambda i: F.transform(F.element_at(lookup, F.get("w", i)), lambda t: F.struct(t.alias("t"), (i - F.get(known, t).k).alias("start")))))
    d = held(d, begins=F.filter(begins, lambda b: stands(b.start, F.get(known, b.t), F.get(known, b.t).k2)))

    def judged(b: Column) -> Column:
        t = F.get(known, b.t)
        got = F.aggregate(F.sequence(F.lit(0), F.size(t.words) - 1), F.lit(0), lambda n, k: n + F.when(stands(b.start, t, k), F.get(t.weights, k)).otherwise(0))
        whole = F.aggregate(t.weights, F.lit(0), lambda n, x: n + x)
        return F.struct(b.t.alias("template"), t.label.alias("label"), t.base.alias("base"), b.start.alias("start"), F.size(t.words).alias("length"), (got / whole).alias("share"), F.forall(t.must, lambda k: stands(b.start, t, k)).alias("verified"))

    return d.select(F.col("id").alias(id_col), F.size("w").cast("long").alias("n_words"), F.transform("begins", judged).alias("matches"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns. score: the best match's share, half of it where its phrases aren't verified; 0 without matches."""
    sure = F.filter("matches", lambda m: m.verified)
    based = F.filter("matches", lambda m: m.verified & m.base)
    d = held(found, sure=sure, based=based)
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m.label))), ",")
    starts = F.transform("based", lambda m: m.start.cast("long"))
    score = F.coalesce(F.array_max(F.transform("matches", lambda m: F.when(m.verified, m.share).otherwise(m.share / 2))), F.lit(0.0))
    return d.select(id_col, "n_words", F.size("based").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), named("based").alias("base_labels"), named("sure").alias("labels"), score.alias("score"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))


_ROWS = ", ".join(f"({i}, '{t.label}', {str(t.base).lower()}, {k}, '{w}', {str(k in t.must).lower()})" for i, t in enumerate(TEMPLATES) for k, w in enumerate(t.words))
OP11_SQL = rf"""
WITH t(template, label, base, k, word, must) AS (VALUES {_ROWS}),
d AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{APART}', ' ', 'g'), ' ') AS x FROM documents),
l AS (SELECT doc_id, CASE WHEN x = '' THEN []::VARCHAR[] ELSE string_split(x, ' ') END AS words FROM d),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM l),
f AS (SELECT word, count(DISTINCT doc_id) AS df FROM w WHERE word IN (SELECT word FROM t) GROUP BY word),
n AS (SELECT count(*) AS n FROM documents),
i AS (SELECT DISTINCT t.word, (floor(1000 * ln((n.n + 1) / (coalesce(f.df, 0) + 1)) + 0.5) + 1)::BIGINT AS weight FROM t CROSS JOIN n LEFT JOIN f USING (word)),
m AS (SELECT template, word, min(k) AS k FROM t WHERE must GROUP BY template, word),
r AS (SELECT m.*, row_number() OVER (PARTITION BY template ORDER BY weight DESC, k) AS rank, count(*) OVER (PARTITION BY template) AS words FROM m JOIN i USING (word)),
b AS (SELECT w.doc_id, r.template, w.pos - r.k AS start FROM w JOIN r ON w.word = r.word AND r.rank = 1),
b2 AS (SELECT b.* FROM b JOIN r ON r.template = b.template AND r.rank = least(r.words, 2) JOIN w ON w.doc_id = b.doc_id AND w.pos = b.start + r.k AND w.word = r.word),
j AS (SELECT b2.doc_id, template, label, base, start, sum(CASE WHEN w.word = t.word THEN weight ELSE 0 END) / sum(weight) AS share, bool_and(coalesce(w.word = t.word, false)) FILTER (must) AS verified
    FROM b2 JOIN t USING (template) JOIN i ON i.word = t.word LEFT JOIN w ON w.doc_id = b2.doc_id AND w.pos = b2.start + t.k GROUP BY ALL),
g AS (SELECT doc_id, count(*) FILTER (verified AND base) AS n_base, min(start) FILTER (verified AND base) AS first_word, max(start) FILTER (verified AND base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified AND base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified) AS labels, max(CASE WHEN verified THEN share ELSE share / 2 END) AS score FROM j GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM l LEFT JOIN g USING (doc_id)
"""
