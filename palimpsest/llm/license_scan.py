"""License scan: exact set-similarity join of text blocks with license templates, in built-in expressions only.

A block is a line of a text, or a window: a run of consecutive words, wherever lines end.  A block matches a template when at least
``percent`` of the template's distinct words stand in it (containment).  A template's windows have ``100 / percent`` as many words as
its text, so a statement wrapped over any number of lines is found, also with marks of comments in between, while words that are
strewn over a text match nothing.  Tokens have one global order: template words by the number of lines
that have them, rarest first, then all others, which can match nothing.  Filters, none of which loses a match:

* *text*: a text with a match has ``due`` words of that template in all; only such texts are cut into blocks;
* *prefix*: a match shares one of the template's ``size - due + 1`` first words;
* *length*: a matching block has at least ``due`` words;
* *position*: from the first shared word on, block and template must both have ``due`` words left.

The template table is a fixed parameter; only it and its words' counts are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import checkpoint

#: Fixed values: (label, text) of common license statements.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "This work is licensed under the GNU General Public License, version"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution License"),
    ("reserved", "All rights reserved"),
)

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAPS_IN_LINE = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def _all_words(text: str) -> list[str]:
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UP, _LOW)))


def template_words(text: str) -> list[str]:
    """Distinct words of a template, as the scan takes them."""
    return list(dict.fromkeys(_all_words(text)))


def window_words(text: str, percent: int) -> int:
    """Words of the windows that a template is looked for in."""
    return max(1, len(_all_words(text)) * 100 // percent)


def _due(own: list, percent: int) -> int:
    return max(1, -(-len(own) * percent // 100))


def _count(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def _phrases(docs: DataFrame) -> DataFrame:
    """The base columns; ``__low`` holds the lower-cased text."""
    # words between single blanks, doubled so that phrases side by side do not share one
    flat = F.concat(F.lit("  "), F.btrim(F.regexp_replace("__low", _GAPS, "  ")), F.lit("  "))
    out = docs.withColumn("__flat", flat)
    out = out.withColumn("n_words", F.when(F.btrim("__flat") == "", F.lit(0).cast("long")).otherwise(_count(F.col("__flat"), "  ") - 1))
    total, firsts, lasts, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in PHRASES:
        wide = "  " + phrase.replace(" ", "  ") + "  "
        n = F.when(F.col("__flat").contains(wide), F.regexp_count("__flat", F.lit(f"(?<=  ){phrase.replace(' ', '  ')}(?=  )")).cast("long")).otherwise(F.lit(0).cast("long"))
        before = F.substring_index("__flat", wide, 1)
        after = F.substring_index("__flat", wide, -1)
        words = len(phrase.split())
        total = total + n
        found = F.col("__flat").contains(wide)
        firsts.append(F.when(found, _count(before, "  ")))
        lasts.append(F.when(found, F.col("n_words") - words - _count(after, "  ")))
        labels.append(F.when(found, F.lit(label)))
    return out.withColumns({
        "n_base": total,
        "first_word": F.least(*firsts), "last_word": F.greatest(*lasts),
        "__base": F.array_compact(F.array(*labels)),
    }).drop("__flat")


def _blocks(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(key, block words, template words in it) of each line with a template word."""
    lines = docs.select("__key", F.explode(F.split(F.regexp_replace("__low", _GAPS_IN_LINE, " "), "\n")).alias("line"))
    words = F.split(F.btrim("line"), " ")
    held = F.array_intersect(words, F.array(*[F.lit(w) for w in vocabulary]))
    return lines.select("__key", F.size(F.array_distinct(words)).alias("size"), held.alias("held")).filter(F.size("held") > 0)


def _likely(docs: DataFrame, templates: tuple[tuple[str, str], ...], percent: int) -> DataFrame:
    """The rows of ``docs`` (__key, __low) with as many words of a template, anywhere in the text, as a match has.

    The words go through a generator: the optimizer would put them into the filter once for each template.
    """
    sets = [template_words(t) for _, t in templates]
    words = lambda ws: F.array(*[F.lit(w) for w in ws])
    text = F.split(F.btrim(F.regexp_replace("__low", _GAPS, " ")), " ")
    held = docs.select("__key", "__low", F.explode(F.array(F.array_intersect(text, words(sorted({w for own in sets for w in own}))))).alias("held"))
    enough = F.lit(False)
    for own in sets:
        enough = enough | (F.size(F.array_intersect("held", words(own))) >= _due(own, percent))
    return held.filter(enough).select("__key", "__low")


def _window_matches(docs: DataFrame, templates: tuple[tuple[str, str], ...], percent: int) -> DataFrame:
    """(__key, label, share) of each text of ``docs`` (__key, __low) and template with a window within the threshold."""
    rows = []
    for label, text in templates:
        own = template_words(text)
        rows.append(F.struct(
            F.lit(label).alias("label"), F.array(*[F.lit(w) for w in own]).alias("own"),
            F.lit(_due(own, percent)).alias("due"), F.lit(window_words(text, percent)).alias("width"),
        ))
    words = docs.select("__key", F.split(F.btrim(F.regexp_replace("__low", _GAPS, " ")), " ").alias("words"))
    words = words.select("__key", "words", F.explode(F.array(*rows)).alias("t"))
    words = words.filter(F.size(F.array_intersect("words", "t.own")) >= F.col("t.due"))
    # places of the template's words; a window begins at each of them
    at = "filter(transform(words, (w, i) -> named_struct('w', w, 'i', i)), x -> array_contains(t.own, x.w))"
    met = words.select("__key", "t", F.explode(F.array(F.expr(at))).alias("at"))
    most = "array_max(transform(at, (x, k) -> size(array_distinct(transform(filter(slice(at, k + 1, t.width), y -> y.i < x.i + t.width), y -> y.w)))))"
    met = met.select("__key", "t", F.explode(F.array(F.expr(most))).alias("both")).filter(F.col("both") >= F.col("t.due"))
    return met.select("__key", F.col("t.label").alias("label"), (F.col("both") / F.size("t.own")).alias("share"))


def matches(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = 80) -> DataFrame:
    """(__key, label, share) of the lines and windows of ``docs`` (__key, __low) and the templates within the threshold."""
    spark: SparkSession = docs.sparkSession
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    docs = checkpoint(_likely(docs, templates, percent))
    blocks = _blocks(docs, vocabulary)
    counts = blocks.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("blocks"))
    counted = {r.word: r.blocks for r in counts.collect()}  # at most one row for each template word
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    index = []
    for number, (label, text) in enumerate(templates):
        own = sorted(rank[w] for w in template_words(text))
        due = _due(own, percent)
        for place, r in enumerate(own[: len(own) - due + 1]):
            index.append((number, label, r, place, due, own))
    prefixes = spark.createDataFrame(index, "template int, label string, word int, place int, due int, own array<int>")
    ranks = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])
    ordered = blocks.select("__key", "size", F.array_sort(F.transform("held", lambda w: F.element_at(ranks, w))).alias("ranks"))
    spread = ordered.select("__key", "size", "ranks", F.posexplode("ranks").alias("at", "word"))
    met = spread.join(F.broadcast(prefixes), "word")
    met = met.filter(
        (F.col("size") >= F.col("due"))
        & (F.size("ranks") - F.col("at") >= F.col("due"))
        & (F.size("own") - F.col("place") >= F.col("due"))
    )
    shared = met.withColumn("both", F.array_intersect("ranks", "own"))
    # a pair that meets at several words counts at the first of them
    due = shared.filter((F.size("both") >= F.col("due")) & (F.array_min("both") == F.col("word")))
    lines = due.select("__key", "label", (F.size("both") / F.size("own")).alias("share"))
    return lines.union(_window_matches(docs, templates, percent))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = 80) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of ``docs`` (doc_id, text).

    ``score`` is the largest containment of a match, 1 where a base phrase stands, else 0.  Null texts are empty.  Rows with the
    same id and text get the same result each; null ids are kept.  Extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), _UP, _LOW).alias("__low"))
    rows = rows.withColumn("__key", F.struct(F.coalesce("doc_id", F.lit(0)).alias("a"), F.col("doc_id").isNull().alias("b"), F.xxhash64("__low").alias("c")))
    found = matches(rows, templates, percent).groupBy("__key").agg(F.collect_set("label").alias("__found"), F.max("share").alias("__share"))
    base = _phrases(rows).drop("__low")
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    none = F.array().cast("array<string>")
    return base.join(found, "__key", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        text(F.col("__base")).alias("base_labels"),
        text(F.concat("__base", F.coalesce("__found", none))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("__share", F.lit(0.0))).alias("score"),
    )
