"""Licence scans by a positional rare-token index.

Templates are phrases and notices of licences.  The index holds, for each
template, the two rarest words of its key phrases, by the number of documents
that hold them, with their positions; so a file looks up its licence words of the
highest inverse document frequency only.  A place of such a word in a file,
less its position in the template, is where the template would begin; the
beginnings that both words agree on are intersected, and every key phrase is
verified there, word by word.  Key phrases are mandatory, so no place is missed.
A template is found where its key phrases stand and a share of LEAST of its
words are at their relative positions.

Templates are few and given as a parameter; all work on a file is done in its
own row with array functions, so no text is shuffled, and a word of any
frequency is counted with a partial aggregate.  DataFrame functions only.

Defined cases: a null text counts as empty, which has no words and score 0; ties
need no rule, for all places count; repeated rows are scanned alike; a template's
part beyond the file's ends isn't there; words that no document holds have the
highest frequency of all and find nothing; an empty table gives no rows; columns
of the result's names are replaced.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's words that have to be at their relative positions.
LEAST = 0.8


@dataclass(frozen=True)
class Template:
    """label, the words of the text in lower case, and its mandatory phrases, each of two words or more; base: whether its places are reported one by one."""

    label: str
    text: str
    phrases: tuple[str, ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def places(self) -> list[tuple[str, int]]:
        """Word and position of all words of the key phrases."""
        out, words = [], self.words
        for phrase in self.phrases:
            w = phrase.split()
            at = next((i for i in range(len(words)) if words[i : i + len(w)] == w), None)
            if at is None or len(w) < 2:
                raise ValueError(f"{phrase!r} isn't a phrase of two words or more of {self.text!r}")
            out += [(x, at + i) for i, x in enumerate(w)]
        return sorted(set(out), key=lambda x: x[1])


def _phrase(label: str, text: str, base: bool = False) -> Template:
    return Template(label, text, (text,), base)


#: Phrases of the contract, then phrases and opening words of public licences.
TEMPLATES = (
    _phrase("mit", "under the mit license", True),
    _phrase("apache-2", "apache license version 2", True),
    _phrase("cc-by-nc", "cc by nc", True),
    _phrase("cc-by-sa", "cc by sa"),
    _phrase("gpl", "gnu general public license"),
    _phrase("lgpl", "gnu lesser general public license"),
    _phrase("agpl", "gnu affero general public license"),
    _phrase("mpl", "mozilla public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    Template("cc-by-nc", "creative commons attribution noncommercial", ("creative commons", "attribution noncommercial")),
    Template("public-domain", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
)


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many documents each word of the key phrases stands; no more rows than those words."""
    known = sorted({w for t in templates for w, _ in t.places()})
    held = F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, known)))
    rows = docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return dict.fromkeys(known, 0) | {r["w"]: r["n"] for r in rows.collect()}


def index(templates: tuple[Template, ...], frequency: dict[str, int]) -> list[list[tuple[str, int]]]:
    """Per template its postings: the two words of its key phrases with the highest inverse document frequency, and their positions."""
    return [sorted(t.places(), key=lambda x: (frequency[x[0]], x[1]))[:2] for t in templates]


def _begins(words: Column, hits: Column, postings: list[tuple[str, int]]) -> Column:
    """Where a template would begin by each of its postings, intersected."""

    def of(word: str, at: int) -> Column:
        return F.transform(F.filter(hits, lambda i: F.get(words, i) == word), lambda i: i - at)

    return F.array_intersect(*[of(word, at) for word, at in postings])


def _stands(words: Column, begin: Column, places: list[tuple[str, int]]) -> Column:
    out = F.lit(True)
    for w, at in places:
        out = out & F.coalesce(F.get(words, begin + at) == w, F.lit(False))
    return out


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and places, which replace columns of
    these names.  places: label, first word and share of words of all templates whose key phrases stand."""
    found_in = index(templates, frequencies(docs, templates))
    known = sorted({w for postings in found_in for w, _ in postings})
    names = ["_words", "_hits", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
    docs = docs.drop(*names).withColumn("_words", words_of(F.col("text")))
    words, hits = F.col("_words"), F.col("_hits")
    at = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    docs = docs.withColumn("_hits", F.filter(at, lambda i: F.get(words, i).isin(known)))

    def of(t: Template, postings: list[tuple[str, int]]) -> Column:
        begins = F.filter(_begins(words, hits, postings), lambda b: _stands(words, b, t.places()))
        text = F.array(*map(F.lit, t.words))
        same = lambda b: F.size(F.filter(F.sequence(F.lit(0), F.lit(len(t.words) - 1)), lambda j: F.get(words, b + j) == F.get(text, j)))
        share = (lambda b: F.lit(1.0)) if len(t.places()) == len(t.words) else lambda b: same(b) / len(t.words)
        return F.transform(begins, lambda b: F.struct(F.lit(t.label).alias("label"), b.cast("long").alias("word"), share(b).alias("share"), F.lit(t.base).alias("base")))

    docs = docs.withColumn("places", F.when(F.size(hits) > 1, F.concat(*[of(t, p) for t, p in zip(templates, found_in, strict=True)])).otherwise(F.array().cast("array<struct<label:string,word:bigint,share:double,base:boolean>>")))
    base = F.filter("places", lambda p: p["base"])
    join = lambda ps: F.array_join(F.array_sort(F.array_distinct(F.transform(ps, lambda p: p["label"]))), ",")
    out = docs.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "n_base": F.size(base).cast("long"),
            "first_word": F.array_min(F.transform(base, lambda p: p["word"])),
            "last_word": F.array_max(F.transform(base, lambda p: p["word"])),
            "base_labels": join(base),
            "labels": join(F.filter("places", lambda p: p["share"] >= LEAST)),
            "score": F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)),
        }
    )
    return out.drop("_words", "_hits")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _sql() -> str:
    """Every start of every text is tried, without an index."""
    rows = ", ".join(f"('{t.label}', {str(t.words)}, {[w for w, _ in t.places()]}, {[at for _, at in t.places()]}, {t.base})" for t in TEMPLATES)
    return rf"""
WITH t(label, tw, kw, ka, base) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT k, w, label, tw, kw, ka, base, unnest(list_filter(range(len(w)), lambda i: w[i + 1] = kw[1])) - ka[1] AS b FROM d, t),
p AS (SELECT k, label, base, b, len(list_filter(range(len(tw)), lambda j: coalesce(b + j >= 0 AND w[b + j + 1] = tw[j + 1], false))) / len(tw) AS share FROM s
      WHERE len(list_filter(range(len(kw)), lambda j: coalesce(b + ka[j + 1] >= 0 AND w[b + ka[j + 1] + 1] = kw[j + 1], false))) = len(kw)),
g AS (SELECT k, count(*) FILTER (base) AS n_base, min(b) FILTER (base) AS first_word, max(b) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= {LEAST}) AS labels, max(share) AS score FROM p GROUP BY k)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN g USING (k)"""


ORACLE = {"op13_licenses": _sql()}
