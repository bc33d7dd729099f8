"""Operator 9: license scans by an exact set-similarity join, in DataFrame functions alone.

A block is a run of consecutive words of a text, wherever its lines end, a quarter longer than the template. A template
matches a text with a block that holds at least ``threshold`` of the template's distinct words. Texts are cut into tiles
that overlap, so that every block lies in one. Words are ordered by their frequency over all documents, rarest first; a
tile with a block that matches must hold one of the template's first ``size - needed + 1`` words (prefix filter), have
enough words (length filter), and have enough of them left from the shared word on (positional filter). What passes is
verified block by block. Templates are a fixed, small list, so they are broadcast; texts are read once, and only documents
that hold enough words of some template are cut into tiles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import written

#: Phrases that the base looks for, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices (the operative sentence of each license or its usual reference) and their labels.
TEMPLATES = (
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0 international"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

THRESHOLD = 0.9


def _normal(text: Column) -> Column:
    """Words with one space between them. ``lower`` also changes other letters than A-Z, none of which becomes part of a phrase."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _needed(size: int, threshold: float) -> int:
    return math.ceil(threshold * size - 1e-9)


def _sets(templates) -> list[tuple[str, list[str]]]:
    return [(label, list(dict.fromkeys(text.split()))) for label, text in templates]


def block_words(text: str) -> int:
    """Words of a block for the template ``text``."""
    return math.ceil(len(text.split()) * 1.25)


def scanned(documents: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One pass: each row's words, base places and template words, with all its words where some template may match."""
    sets = _sets(templates)
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, words in sets for w in words})])
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("norm", _normal(F.col("text")))
    words = F.when(F.col("norm") == "", F.array().cast("array<string>")).otherwise(F.split("norm", " "))
    rows = rows.withColumn("words", words).withColumn("hits", F.array_intersect("words", vocabulary)).withColumn("pad", F.concat(F.lit(" "), "norm", F.lit(" ")))
    n, first, last, labels = [], [], [], []
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    for phrase, label in PHRASES.items():
        there = F.contains("pad", F.lit(f" {phrase} "))
        n.append(F.when(there, F.regexp_count("pad", F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0))
        first.append(F.when(there, spaces(F.substring_index("pad", f" {phrase} ", 1))))
        last.append(F.when(there, spaces(F.regexp_extract("pad", f"(?s)^(.*) {phrase} ", 1))))
        labels.append(F.when(there, F.lit(label)))
    may = F.lit(False)
    for _, own in sets:
        may = may | (F.size(F.array_intersect("hits", F.array(*[F.lit(w) for w in own]))) >= _needed(len(own), threshold))
    return rows.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        sum(n[1:], n[0]).cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base_labels"),
        "hits",
        F.when(may, F.col("words")).alias("may"),
    )


def matches(found: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, tile (from 0), label, containment of the best block of every tile with one that meets the threshold."""
    spark, sets = found.sparkSession, _sets(templates)
    # Frequencies of template words over all documents: as many rows as there are template words.
    counts = {r.word: r.n for r in found.select(F.explode("hits").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted({w for _, words in sets for w in words}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    ranks = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)])
    vocabulary = F.array(*[F.lit(w) for w in order])
    step = max(block_words(text) for _, text in templates)
    rows = []
    for (label, words), (_, text) in zip(sets, templates, strict=True):
        own = sorted(rank[w] for w in words)
        needed = _needed(len(own), threshold)
        rows += [(label, own, block_words(text), needed, place, own[place]) for place in range(len(own) - needed + 1)]
    prefixes = F.broadcast(spark.createDataFrame(rows, "label string, t_words array<int>, width int, needed int, t_place int, word int"))
    # Tiles of two steps, one step apart: a block of one step or less lies in one of them.
    starts = F.sequence(F.lit(0), F.greatest(F.size("may") - 1, F.lit(0)), F.lit(step))
    tiles = found.filter("may is not null").select("doc_id", "text_hash", F.posexplode(F.transform(starts, lambda s: F.slice("may", s + 1, 2 * step))).alias("tile", "run"))
    placed = F.filter(F.transform("run", lambda w, i: F.struct(i.alias("at"), F.element_at(ranks, w).alias("w"))), lambda x: x["w"].isNotNull())
    tiles = tiles.select("doc_id", "text_hash", "tile", placed.alias("placed")).withColumn("b_words", F.array_sort(F.array_distinct(F.transform("placed", lambda x: x["w"]))))
    met = tiles.select("doc_id", "text_hash", "tile", "placed", "b_words", F.posexplode("b_words").alias("b_place", "word"))
    left = 1 + F.least(F.size("t_words") - F.col("t_place") - 1, F.size("b_words") - F.col("b_place") - 1)
    candidates = met.join(prefixes, "word").filter((F.size("b_words") >= F.col("needed")) & (left >= F.col("needed"))).filter(
        # Of several shared prefix words the first one speaks for the pair.
        F.array_min(F.array_intersect("b_words", "t_words")) == F.col("word")
    )
    candidates = candidates.filter(F.size(F.array_intersect("b_words", "t_words")) >= F.col("needed"))
    # Every block of use begins with one of the template's words; it holds at most ``width`` of them.
    own = candidates.withColumn("own", F.filter("placed", lambda x: F.array_contains("t_words", x["w"])))
    block = lambda first, i: F.filter(F.slice("own", i + 1, F.col("width")), lambda x: x["at"] < first["at"] + F.col("width"))
    shared = F.array_max(F.transform("own", lambda first, i: F.size(F.array_distinct(F.transform(block(first, i), lambda x: x["w"])))))
    return own.withColumn("shared", shared).filter(F.col("shared") >= F.col("needed")).select("doc_id", "text_hash", "tile", "label", (F.col("shared") / F.size("t_words")).alias("containment"))


def scan_licenses(documents: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Words, base places and labels of each row's whole text, and the labels that templates add; ``score`` is the best containment found.

    A phrase of the base scores 1; with nothing found the score is 0. A null or empty text has no words; repeated rows
    each get their row; an empty table gives no rows.
    """
    found = written(scanned(documents, templates, threshold), "license-scan")
    best = matches(found, templates, threshold).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    best = best.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    joined = found.join(best, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB: every run of words against every template, without filters."""
    normal = "trim(regexp_replace(lower({}), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'))"
    rows = ", ".join(f"('{label}', {words!r}::VARCHAR[], {_needed(len(words), threshold)}, {block_words(text)})" for (label, words), (_, text) in zip(_sets(templates), templates, strict=True))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {normal.format("coalesce(text, '')")} AS norm FROM documents),
words AS (SELECT doc_id, text, CASE WHEN norm = '' THEN []::VARCHAR[] ELSE string_split(norm, ' ') END AS w FROM docs),
phrases(phrase, label, size) AS (VALUES {phrases}),
places AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words) JOIN phrases
  ON array_to_string(w[i:i + size - 1], ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS own FROM places GROUP BY doc_id),
templates(label, t, needed, width) AS (VALUES {rows}),
runs AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
more AS (SELECT doc_id, list(DISTINCT label) AS added, max(shared / size) AS best FROM
  (SELECT doc_id, label, needed, len(t) AS size, len(list_intersect(t, w[i:i + width - 1])) AS shared FROM runs CROSS JOIN templates WHERE list_contains(t, w[i])) WHERE shared >= needed GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(own, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(added, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""
