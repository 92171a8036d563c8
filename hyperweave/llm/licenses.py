"""License scans (12), native: a positional index of rare licence words.

Templates are short notices. Of each, the words that the fewest documents hold (counted over all rows) make the
index. A text looks up those of its words that are in the index; each occurrence votes for (template, place where
the template would start). A template is there if ``coverage`` of its words stand at their places, all words of
its key phrases among them. That allows m misses in a template, so of p indexed places p - m vote for every
true place: with indexed words for m + ``VOTES`` places of each template, nothing is lost. Places with enough votes
are compared word by word.

Everything after the counts happens inside the row: no shuffle and no join. The index, bounded by the
templates, is part of the plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, own, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases and labels of the base scan.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: label, notice with its key phrases in brackets.
TEMPLATES = (
    ("agpl", "You should have received a copy of the [GNU Affero General Public License] along with this program"),
    ("apache-2.0", "Licensed under the [Apache License Version 2 0]"),
    ("apache-2.0", "you may not use this file except in [compliance with the License] You may obtain a copy of the License at"),
    ("bsd", "[Redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under [CC BY 4 0]"),
    ("cc-by-nc", "Licensed under [CC BY NC] 4 0"),
    ("cc-by-nd", "Licensed under [CC BY ND] 4 0"),
    ("cc-by-sa", "Licensed under [CC BY SA] 4 0"),
    ("cc-by", "This work is licensed under a [Creative Commons Attribution] 4 0 International License"),
    ("cc-by-sa", "This work is licensed under a [Creative Commons Attribution ShareAlike] 4 0 International License"),
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the [GNU General Public License] as published by the Free Software Foundation"),
    ("gpl-2.0", "This work is licensed under the [GNU General Public License version 2]"),
    ("gpl-3.0", "This work is licensed under the [GNU General Public License version 3]"),
    ("isc", "Permission to use copy modify and or distribute this software for any purpose [with or without fee is hereby granted]"),
    ("lgpl", "This library is free software you can redistribute it and or modify it under the terms of the [GNU Lesser General Public License] as published by the Free Software Foundation"),
    ("mit", "Released under the [MIT License]"),
    ("mit", "[Permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the [Mozilla Public License v 2 0]"),
    ("unlicense", "This is free and unencumbered software [released into the public domain]"),
)
VOTES, COVERAGE_PERCENT = 3, 80
#: More words than this in all templates are refused, as they are part of the plan.
MOST_WORDS = 20_000


@dataclass(frozen=True)
class Notice:
    label: str
    words: tuple[str, ...]
    must: tuple[bool, ...]

    @staticmethod
    def of(label: str, text: str) -> Notice:
        words, must, inside = [], [], False
        for piece in re.split(r"([\[\]])", text):
            if piece in ("[", "]"):
                inside = piece == "["
            else:
                found = [w for w in re.split(GAP, piece.translate(str.maketrans(UPPER, LOWER))) if w]
                words += found
                must += [inside] * len(found)
        if not words:
            raise ValueError(f"no words in the template of {label}")
        return Notice(label, tuple(words), tuple(must))


def notices(templates=TEMPLATES) -> list[Notice]:
    out = [Notice.of(*t) for t in templates]
    if sum(len(n.words) for n in out) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} words")
    return out


def words_of(text: Column) -> Column:
    """The words of a text, ASCII letters in lower case; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), lambda w: w != "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def document_counts(df: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each word of the vocabulary stands; words that stand nowhere are missing."""
    held = df.select(F.explode(F.array_intersect(words_of(own(df, text)), _strings(vocabulary))).alias("word"))
    return {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row for each template word at most


def rare_index(found: list[Notice], counts: dict[str, int], least_votes: int = VOTES, percent: int = COVERAGE_PERCENT) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """Postings (template, place) of the rarest words, rarest first (ties by the word); and the votes that each template needs.

    Words that no document holds are the rarest: they are left out of the postings, as nothing looks them up.
    """
    rank = lambda w: (counts.get(w, 0), w)
    postings: dict[str, list[tuple[int, int]]] = {}
    votes = []
    for t, n in enumerate(found):
        misses, places = len(n.words) * (100 - percent) // 100, 0
        for w in sorted(set(n.words), key=rank):
            if places >= misses + least_votes:
                break
            at = [p for p, x in enumerate(n.words) if x == w]
            postings.setdefault(w, []).extend((t, p) for p in at)
            places += len(at)
        votes.append(places - misses)
    return {w: postings[w] for w in sorted(postings, key=rank) if counts.get(w)}, votes


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once (lambdas compute what they mention each time)."""
    return F.transform(F.array(value), use)[0]


def phrase_places(words: Column, phrases=PHRASES) -> Column:
    """array<struct<at, label>>: where the words of a phrase stand one after the other, in order."""
    split = [(p.split(" "), label) for p, label in phrases]

    def label_at(w: Column, i: Column) -> Column:
        out = None
        for ws, label in split:
            hit = w == ws[0]
            for k, x in enumerate(ws[1:], 1):
                hit = hit & F.coalesce(F.get(words, i + k) == x, F.lit(False))
            out = F.when(hit, label) if out is None else out.when(hit, label)
        return out

    return F.filter(F.transform(words, lambda w, i: F.struct(i.cast("long").alias("at"), label_at(w, i).alias("label"))), lambda s: s["label"].isNotNull())


def template_hits(words: Column, found: list[Notice], index: dict, votes: list[int], percent: int = COVERAGE_PERCENT) -> Column:
    """array<struct<label, at, coverage>>: templates that stand in ``words`` (one may start before the first word)."""
    if not index:
        return F.array().cast("array<struct<label: string, at: int, coverage: double>>")
    postings = F.create_map(*[x for w, ps in index.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in ps]))])
    templates = F.array(*[F.array(*[F.struct(F.lit(w).alias("w"), F.lit(m).alias("must")) for w, m in zip(n.words, n.must)]) for n in found])
    labels, needed = _strings(n.label for n in found), F.array(*[F.lit(v) for v in votes])

    def cast_by(present: Column) -> Column:
        """Sorted (template, start), one for each occurrence of a word of the index and each of its postings."""
        at = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda s: F.array_contains(present, s["w"]))
        return F.array_sort(F.flatten(F.transform(at, lambda s: F.transform(postings[s["w"]], lambda q: F.struct(q["t"].alias("t"), (s["i"] - q["p"]).alias("at"))))))

    def elected(cast: Column) -> Column:
        """Each (template, start) once that has enough votes: equal votes are neighbours."""
        return F.array_distinct(F.filter(cast, lambda v, i: F.coalesce(F.get(cast, i + F.get(needed, v["t"]) - 1) == v, F.lit(False))))

    def compared(v: Column) -> Column:
        """The hit, or null where the words of a key phrase are not all in place."""
        equal = F.transform(F.get(templates, v["t"]), lambda x, p: F.struct(F.coalesce(F.get(words, v["at"] + p) == x["w"], F.lit(False)).alias("same"), x["must"].alias("must")))
        hit = lambda e: F.struct(F.get(labels, v["t"]).alias("label"), v["at"].alias("at"), (F.size(F.filter(e, lambda x: x["same"])) / F.size(e)).alias("coverage"))
        return _let(equal, lambda e: F.when(F.forall(e, lambda x: x["same"] | ~x["must"]), hit(e)))

    no_place = F.array().cast("array<struct<t: int, at: int>>")
    places = _let(F.array_intersect(_strings(index), words), lambda present: F.when(F.size(present) > 0, _let(cast_by(present), elected)).otherwise(no_place))
    return F.filter(F.transform(places, compared), lambda h: h.isNotNull() & (100 * h["coverage"] >= percent))


def scan(df: DataFrame, text: str = "text", out: str = "licenses", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Add struct ``out``: n_words, phrases array<struct<at, label>>, templates array<struct<label, at, coverage>>.

    Places are word numbers from 0. Null and empty texts have no words and no hits; repeated rows get the same hits
    and each counts as a document; ties between templates at one place stay, each with its hit; an empty table stays
    empty; a very long text is read whole, as one array of its words. Other columns pass through, ``out`` gets
    underscores where the name is taken.
    """
    found = notices(templates)
    index, votes = rare_index(found, document_counts(df, text, sorted({w for n in found for w in n.words})))
    words = free_name(df, "words")
    with_words = df.withColumn(words, words_of(own(df, text)))
    w = F.col(words)
    told = F.struct(F.size(w).cast("long").alias("n_words"), phrase_places(w, phrases).alias("phrases"), template_hits(w, found, index, votes).alias("templates"))
    return with_words.withColumn(free_name(df, out), told).drop(words)


def op12_license_scan(spark, sf_dir):
    told = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licenses.*")
    at = F.transform("phrases", lambda s: s["at"])
    labels = lambda c: F.array_distinct(F.transform(c, lambda s: s["label"]))
    return told.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(labels("phrases")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels("phrases"), labels("templates"))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("templates", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
        F.size("templates").cast("long").alias("n_templates"),
    )


def _sql() -> str:
    """The same for DuckDB: every start of every template is compared, as the votes lose none."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({t}, {text(n.label)}, {len(n.words)}, {p}, {text(w)}, {m})" for t, n in enumerate(notices()) for p, (w, m) in enumerate(zip(n.words, n.must)))
    base = " UNION ALL ".join(f"SELECT doc_id, i, {text(label)} AS label FROM places WHERE " + " AND ".join(f"ws[i + {k + 1}] = {text(x)}" for k, x in enumerate(p.split(" "))) for p, label in PHRASES)
    return rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
 places AS (SELECT doc_id, ws, unnest(range(0, len(ws))) AS i FROM docs),
 base AS ({base}),
 told AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS ls FROM base GROUP BY doc_id),
 template(t, label, n, p, w, must) AS (VALUES {rows}),
 musts AS (SELECT t, sum(must::INT) AS m FROM template GROUP BY t),
 words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM docs),
 placed AS (
  SELECT doc_id, t, label, i - p AS at, count(*) / max(n) AS coverage, sum(must::INT) AS m
  FROM words JOIN template USING (w) GROUP BY doc_id, t, label, i - p HAVING 100 * (count(*) / max(n)) >= {COVERAGE_PERCENT}),
 hits AS (SELECT placed.* FROM placed JOIN musts USING (t) WHERE placed.m = musts.m),
 best AS (SELECT doc_id, max(coverage) AS score, count(*) AS n_templates, list(DISTINCT label) AS ls FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
 coalesce(array_to_string(list_sort(told.ls), ','), '') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(told.ls, []), coalesce(best.ls, [])))), ',') AS labels,
 coalesce(score, 0)::DOUBLE AS score, coalesce(n_templates, 0) AS n_templates
FROM docs d LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id)
"""


SQL = _sql()
