"""Licence scan with a positional rare-token index; DataFrame functions only.

Templates are key phrases of licences with the text that usually stands around them. Of each file, the licence
words that it holds are ranked by IDF, taken over all documents. A template whose phrase's words the file all
holds is looked up by the two of these words that rank highest: the file's places of each, moved back by the
word's place in the phrase, are postings of possible starts, and only starts in both postings are left. There the
mandatory phrase is verified word by word, and the share of the template's text that stands at its relative
positions makes the score.

A phrase can only stand where all its words stand, so no place is missed. Texts are split once: what the first
pass keeps are counts, the licence words of each file, and the words of those files that hold all words of some
phrase. Document frequencies are one count for each licence word, whatever the corpus.

Null or empty text: no words, no places, empty labels, score 0. Null ids and repeated rows are kept, one
output row per input row. Templates that tie in rank go by their order in the phrase. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, materialise

#: What separates words, after A-Z were lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence phrase: ``before`` and ``after`` are usual surroundings, ``phrase`` is mandatory."""

    label: str
    phrase: str
    before: str = ""
    after: str = ""
    base: bool = False

    @property
    def words(self) -> list[str]:
        return f"{self.before} {self.phrase} {self.after}".split()

    @property
    def key(self) -> tuple[int, list[str]]:
        """Where the phrase starts in the template, and its words."""
        return len(self.before.split()), self.phrase.split()


#: Fixed phrases of licences, with text around them as it is usually published.
TEMPLATES = (
    Template("mit", "mit license", "released under the", base=True),
    Template("apache", "apache license", "licensed under the", "version 2", base=True),
    Template("gpl", "general public license", "this work is licensed under the gnu", "version 3", base=True),
    Template("apache", "you may not use this file except in compliance with the license", "licensed under the apache license version 2 0 the license", "you may obtain a copy of the license at"),
    Template("gpl", "either version 3 of the license or at your option any later version", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("gpl", "either version 2 of the license or at your option any later version", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "gnu lesser general public license", "under the terms of the", "as published by the free software foundation"),
    Template("agpl", "gnu affero general public license", "under the terms of the", "as published by the free software foundation"),
    Template("mpl", "mozilla public license", "this source code form is subject to the terms of the", "v 2 0"),
    Template("epl", "eclipse public license", "this program and the accompanying materials are made available under the terms of the", "v 2 0"),
    Template("bsd", "redistribution and use in source and binary forms", "", "with or without modification are permitted provided that the following conditions are met"),
    Template("bsd", "redistributions of source code must retain the above copyright notice", "", "this list of conditions and the following disclaimer"),
    Template("bsd", "bsd license", "released under the"),
    Template("isc", "isc license", "released under the"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "", "with or without fee is hereby granted"),
    Template("zlib", "this software is provided as is without any express or implied warranty", "", "in no event will the authors be held liable for any damages arising from the use of this software"),
    Template("cc-by-nc", "licensed under cc by nc", "this text is", "4 0"),
    Template("cc-by-sa", "licensed under cc by sa", "this text is", "4 0"),
    Template("cc-by", "creative commons attribution", "licensed under a", "license"),
    Template("unlicense", "released into the public domain", "this is free and unencumbered software"),
    Template("mit", "permission is hereby granted free of charge", "", "to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
)


def words_of(text: Column) -> Column:
    """The words of a text, null: none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), lambda w: w != "")


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def inverse_frequencies(frequencies: dict[str, int]) -> dict[str, float]:
    top = max([*frequencies.values(), 1])
    return {w: math.log((1 + top) / (1 + n)) for w, n in frequencies.items()}


def first_pass(docs: DataFrame, templates: tuple[Template, ...], keep: tuple[str, ...]) -> DataFrame:
    """``keep``, n_words, the licence words ``held`` by each file, and its words where these make up a phrase."""
    vocabulary = sorted({w for t in templates for w in t.key[1]})
    phrases = F.array(*(_strings(sorted(set(t.key[1]))) for t in templates))
    split = docs.select(*keep, words_of(F.col("text")).alias("words"))
    split = split.select(*keep, "words", F.array_intersect("words", _strings(vocabulary)).alias("held"))
    some = F.exists(phrases, lambda p: F.size(F.array_except(p, F.col("held"))) == 0)
    return materialise(split.select(*keep, F.size("words").cast("long").alias("n_words"), "held", F.when(some, F.col("words")).alias("words")), "licence-words")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words and ``places``: the verified (template, start, n_words, coverage) of each file."""
    files = first_pass(docs, templates, keep)
    counts = files.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    frequencies = {r["word"]: r["n"] for r in counts.collect()}  # at most one row per licence word
    idf = inverse_frequencies({w: frequencies.get(w, 0) for t in templates for w in t.key[1]})
    rows = []
    for i, t in enumerate(templates):
        lead, phrase = t.key
        rare = sorted(range(len(phrase)), key=lambda k: (-idf[phrase[k]], k))  # by rank: a file that holds the phrase holds these
        one, two = rare[0], rare[1] if len(rare) > 1 else rare[0]
        number = lambda k: F.lit(k).cast("int")
        rows.append(F.struct(number(i).alias("template"), number(lead).alias("lead"), F.lit(phrase[one]).alias("rare"), number(one).alias("at"), F.lit(phrase[two]).alias("next"), number(two).alias("next_at"), _strings(phrase).alias("phrase"), _strings(t.words).alias("words")))
    anchors = sorted({phrase[k] for t in templates for phrase in [t.key[1]] for k in range(len(phrase))})

    words = F.col("words")
    # the places of licence words, by word; then postings of starts, their intersection, and the phrase
    found = files.select(*keep, "n_words", "held", "words", F.filter(F.transform(words, lambda w, i: F.when(w.isin(anchors), F.struct(w.alias("word"), i.alias("at")))), lambda h: h.isNotNull()).alias("hits"))
    postings = lambda word, at: F.transform(F.filter("hits", lambda h: h["word"] == word), lambda h: h["at"] - at)

    def starts(t: Column) -> Column:
        both = F.array_intersect(postings(t["rare"], t["at"]), postings(t["next"], t["next_at"]))
        stands = F.filter(both, lambda s: (s >= 0) & (F.slice(words, F.greatest(s, F.lit(0)) + 1, F.size(t["phrase"])) == t["phrase"]))
        return F.transform(stands, lambda s: F.struct(t["template"].alias("template"), s.alias("start"), F.size(t["phrase"]).alias("n_words"), covered(t, s).alias("coverage")))

    def covered(t: Column, start: Column) -> Column:
        same = F.filter(F.transform(t["words"], lambda w, i: F.get(words, start - t["lead"] + i) == w), lambda x: x)
        return F.size(same) / F.size(t["words"])

    candidates = F.filter(F.array(*rows), lambda t: F.size(F.array_except(t["phrase"], F.col("held"))) == 0)
    return found.select(*keep, "n_words", F.when(words.isNotNull(), F.flatten(F.transform(candidates, starts))).alias("places"))


def report(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document: base places, all labels, and the best coverage as the score."""
    base = [i for i, t in enumerate(templates) if t.base]
    found = scan(docs, templates)
    places = F.coalesce(F.col("places"), F.array().cast(found.schema["places"].dataType))
    labels = F.array(*(F.lit(t.label) for t in templates))
    of_base = F.filter(places, lambda p: p["template"].isin(base))
    named = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda p: F.get(labels, p["template"])))), ",")
    rows = found.select("doc_id", "n_words", places.alias("places"), of_base.alias("base"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["start"])).cast("long").alias("last_word"),
        named(F.col("base")).alias("base_labels"),
        named(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0)).alias("score"),
    )


def report_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same rows in DuckDB SQL, without an index: every template is tried at every word."""
    def literal(words: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"

    rows = ", ".join(f"({i}, '{t.label}', {str(t.base).lower()}, {t.key[0]}, {literal(t.key[1])}, {literal(t.words)})" for i, t in enumerate(templates))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t(template, label, base, lead, phrase, words) AS (VALUES {rows}),
p AS (
  SELECT d.r, t.template, t.label, t.base, s.i - 1 AS start,
    len(list_filter(range(1, len(t.words) + 1), lambda k: s.i - t.lead + k - 1 >= 1 AND d.w[s.i - t.lead + k - 1] IS NOT DISTINCT FROM t.words[k])) / len(t.words) AS coverage
  FROM d, t, LATERAL (SELECT unnest(list_filter(range(1, len(d.w) + 1), lambda i: d.w[i] = t.phrase[1])) AS i) s
  WHERE list_has_any(d.w, t.phrase) AND d.w[s.i:s.i + len(t.phrase) - 1] = t.phrase)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
  CAST(count(*) FILTER (WHERE p.base) AS BIGINT) AS n_base,
  CAST(min(p.start) FILTER (WHERE p.base) AS BIGINT) AS first_word,
  CAST(max(p.start) FILTER (WHERE p.base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT p.label, ',' ORDER BY p.label) FILTER (WHERE p.base), '') AS base_labels,
  coalesce(string_agg(DISTINCT p.label, ',' ORDER BY p.label) FILTER (WHERE p.label IS NOT NULL), '') AS labels,
  CAST(coalesce(max(p.coverage), 0) AS DOUBLE) AS score
FROM d LEFT JOIN p ON p.r = d.r GROUP BY d.r, d.doc_id, d.w
"""
