"""License scan by diagonal voting, in DataFrame functions alone.

A text's words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` once A-Z are
lower-cased.  Templates are short word sequences: the base phrases, and notices
and names of licenses.  The steps:

1. Every two neighbouring words of every text make a rolling 2-gram; its hash is
   joined to the templates' 2-grams (a broadcast of a fixed table) and the
   words themselves are compared, so a hash collision never counts.
2. A hit at word p for a template's gram t votes for the diagonal p - t, the
   place where the template would begin.  Votes are gathered in one shuffle by
   document row; a diagonal keeps the template's grams that voted as bits.
3. Neighbouring diagonals, up to ``gap`` apart, are merged: words put in or left
   out move the rest of a notice to the next diagonals.
4. Spans are verified: a base phrase, like any template of fewer than
   ``short`` words, needs all its grams on one diagonal; a longer one needs a
   ``share`` of its grams within the merged diagonals.

Only hits are shuffled, and one row for each document; the key is the document
row, so that no phrase, however frequent, is a hot key.

Edge cases: a NULL or empty text, or one of a single word, has no hit: 0 places,
NULL first and last word, empty labels, score 0.  Every row is a document, also
if its doc_id is repeated or NULL.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: What stands between the words of a lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE, SHORT, GAP = 0.75, 10, 8


@dataclass(frozen=True)
class Template:
    """Words that stand for a license; ``base``: one of the base phrases."""

    words: str
    label: str
    base: bool = False

    @property
    def grams(self) -> list[tuple[str, str]]:
        w = self.words.split()
        return list(zip(w, w[1:]))


# The base phrases and their labels.
BASE = (
    Template("gnu general public license", "gpl", True),
    Template("apache license", "apache", True),
    Template("cc by", "cc-by", True),
    Template("mit license", "mit", True),
)
# Names and opening words of public licenses.
NOTICES = (
    Template("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    Template("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    Template("www apache org licenses license 2 0", "apache"),
    Template("gnu gpl", "gpl"),
    Template("gnu lesser general public license", "lgpl"),
    Template("gnu library general public license", "lgpl"),
    Template("gnu affero general public license", "agpl"),
    Template("gnu free documentation license", "gfdl"),
    Template("this program is free software you can redistribute it and or modify it under the terms of the gnu", "gnu"),
    Template("creative commons attribution", "cc-by"),
    Template("creativecommons org licenses by", "cc-by"),
    Template("creative commons attribution sharealike", "cc-by-sa"),
    Template("cc by sa", "cc-by-sa"),
    Template("creative commons attribution noncommercial", "cc-by-nc"),
    Template("cc by nc", "cc-by-nc"),
    Template("cc by nd", "cc-by-nd"),
    Template("creative commons zero", "cc0"),
    Template("cc0 1 0 universal", "cc0"),
    Template("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    Template("bsd license", "bsd"),
    Template("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    Template("isc license", "isc"),
    Template("mozilla public license", "mpl"),
    Template("eclipse public license", "epl"),
    Template("boost software license", "bsl"),
    Template("this is free and unencumbered software released into the public domain", "unlicense"),
)
TEMPLATES = BASE + NOTICES


def license_words(text: Column) -> Column:
    """The words of a text, in order."""
    whole = F.coalesce(text, F.lit(""))
    # In ASCII alone, lower() is the same as the plain replacement of A-Z, and faster.
    folded = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return F.array_remove(F.split(folded, BETWEEN), "")


def grams_needed(template: Template, share: float, short: int) -> int:
    """How many of a template's grams verify a span."""
    n = len(template.grams)
    return n if template.base or n + 1 < short else min(n, -int(-share * n // 1))


def license_spans(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, share: float = SHARE, short: int = SHORT, gap: int = GAP) -> DataFrame:
    """(row, doc_id, n_words, template, label, base, start, grams, found) of
    each verified span: ``template`` is the place in ``templates``, ``start``
    the span's first word (from 0; for merged diagonals that of the first one),
    ``found`` how many of the template's ``grams`` it holds.  Every document
    has one more row, whose template is NULL."""
    if any(not 1 <= len(t.grams) <= 63 for t in templates):
        raise ValueError("a template has 2 to 64 words")
    spark = docs.sparkSession
    grams = [(n, i, a, b) for n, t in enumerate(templates) for i, (a, b) in enumerate(t.grams)]
    table = spark.createDataFrame(grams, "template int, at int, a string, b string").withColumn("gram", F.xxhash64("a", "b"))
    # A gram that every document starts with, so that documents without a hit stay.
    start = spark.createDataFrame([(-1, 0, None, None, 0)], "template int, at int, a string, b string, gram long")
    table = F.broadcast(table.unionByName(start))

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), license_words(F.col("text")).alias("words"))
    rolling = F.zip_with("words", F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.xxhash64(a, b))
    # The grams in a projection of their own: the generator and the join after it then run in generated code, which passes ``words`` by reference.
    texts = texts.withColumn("grams", F.concat(F.array(F.lit(0).cast("long")), rolling))
    every = texts.select("row", "doc_id", "words", F.posexplode_outer("grams").alias("p", "gram"))
    same = (F.get("words", F.col("p") - 1) == F.col("a")) & (F.get("words", F.col("p")) == F.col("b"))
    hits = every.join(table, "gram").where(F.when(F.col("template") < 0, F.col("p") == 0).otherwise(F.col("p").between(1, F.size("words") - 1) & same))
    votes = hits.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "template", "at", (F.col("p") - 1 - F.col("at")).alias("start")).repartition("row")

    per_template = lambda values: F.get(F.array(*map(F.lit, values)), F.col("template"))
    diagonals = votes.groupBy("row", "doc_id", "n_words", "template", "start").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))
    near = W.partitionBy("row", "template").orderBy("start").rangeBetween(0, gap)
    exact = per_template([len(t.grams) == grams_needed(t, share, short) for t in templates])
    merged = diagonals.withColumn("bits", F.when(exact, F.col("bits")).otherwise(F.bit_or("bits").over(near)))
    spans = merged.select(
        "row", "doc_id", "n_words", F.when(F.col("template") >= 0, F.col("template")).alias("template"),
        per_template([t.label for t in templates]).alias("label"), per_template([t.base for t in templates]).alias("base"), "start",
        per_template([len(t.grams) for t in templates]).alias("grams"), F.bit_count("bits").alias("found"), per_template([grams_needed(t, share, short) for t in templates]).alias("need"),
    )
    return spans.where("template IS NULL OR found >= need").drop("need")


def license_scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, share: float = SHARE, short: int = SHORT, gap: int = GAP) -> DataFrame:
    """One row per document: doc_id, n_words, n_base (places of base phrases),
    first_word and last_word (their smallest and largest start), base_labels
    and labels (distinct, sorted, joined by commas), score (largest share of a
    template's grams that a verified span holds; 0 without one)."""
    spans = license_spans(docs, templates, share, short, gap)
    base = lambda c: F.when(F.col("base"), F.col(c))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per_row = spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(base("start")).alias("n_base"),
        F.min(base("start")).cast("long").alias("first_word"),
        F.max(base("start")).cast("long").alias("last_word"),
        joined(base("label")).alias("base_labels"),
        joined("label").alias("labels"),
        F.coalesce(F.max(F.col("found") / F.col("grams")), F.lit(0.0)).alias("score"),
    )
    return per_row.drop("row")
