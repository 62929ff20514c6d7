"""License passages by diagonal voting, in DataFrame operations alone.

Documents and license templates are cut into words; all rolling word pairs and runs of four words are
hashed and joined with the places of the same hashes in the templates. A hit at word p of the
document and word t of a template lies on the diagonal p - t: an unbroken copy puts all its hits on
one diagonal, a copy with words added or left out on a few neighbouring ones. Hits are counted per
diagonal, neighbouring diagonals are merged, and a merged span counts when it covers enough of the
template's runs (all of them, on one diagonal, for the short phrases).

Templates are literals, so the joined side has a few hundred rows whatever the corpus. Every document
also carries one marker hash, so that documents without hits stay and the table is read once.

Defined results: a null text is empty; a document without words has counts 0, labels '' and score 0; equal
rows give equal rows, each its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from earmark.functions.columns import literal_table
from earmark.llm.common import named

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONG_RUN = 4
# diagonals this near belong to one copy with words added or left out
NEAR = 3
# share of a long template's runs that a span must cover
COVERAGE = 0.6
MARKER = -1

# fixed values: phrases that name a license, and public wordings of license notices
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]
NOTICES = [
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
        "mit",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License",
        "apache",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        "gpl",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "bsd",
    ),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
]


def words_of(text: Column) -> Column:
    """Lower-cased words. Only letters outside ASCII differ from lowering A-Z alone, and no phrase has any."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), "")


def _rolling(words: Column) -> list[Column]:
    """Hashes of the word pairs and of the four-word runs at every place; later places give null."""
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(words, rest, lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    ahead = F.slice(pairs, 3, F.greatest(F.size(pairs) - 2, F.lit(0)))
    return [pairs, F.zip_with(pairs, ahead, lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))]


def template_runs(spark: SparkSession, phrases=None, notices=None) -> DataFrame:
    """(h, template, label, base, t, runs): places of the hashes in the templates."""
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    rows = [(i, text, label, i < len(phrases)) for i, (text, label) in enumerate([*phrases, *notices])]
    table = literal_table(spark, "template int, text string, label string, base boolean", rows)
    table = table.withColumn("words", words_of(F.col("text")))
    pairs, runs = _rolling(F.col("words"))
    table = table.withColumn("hashes", F.when(F.col("base"), pairs).otherwise(runs))
    table = table.withColumn("hashes", F.filter("hashes", lambda h: h.isNotNull()))
    return table.select(
        "template", "label", "base", F.size("hashes").alias("runs"), F.posexplode("hashes").alias("t", "h")
    )


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=None, notices=None) -> DataFrame:
    """(row, n_words, spans) per distinct (id, text): spans are (first, last, label, base, score).

    ``row`` is a struct (id, digest of the text, copies).
    """
    spark = docs.sparkSession
    templates = template_runs(spark, phrases, notices)
    marker = literal_table(
        spark, "template int, label string, base boolean, runs int, t int, h long", [(MARKER, None, False, 1, 0, MARKER)]
    )
    templates = F.broadcast(templates.unionByName(marker))  # a few hundred rows of literals

    text = F.coalesce(F.col("text"), F.lit(""))
    worded = named(docs, [id_col, text_col]).toDF("id", "text").select(
        "id", F.xxhash64(text).alias("digest"), words_of(F.col("text")).alias("words")
    )
    # pairs stand at even places and runs at odd ones; the marker comes first
    pairs, runs = _rolling(F.col("words"))
    hashed = worded.select("id", "digest", F.size("words").alias("n_words"), pairs.alias("pairs"), runs.alias("runs"))
    both = F.concat(F.array(F.lit(MARKER).cast("long")), F.col("pairs"), F.col("runs"))
    placed = hashed.select("id", "digest", "n_words", F.posexplode(both).alias("at", "h")).filter("h IS NOT NULL")
    hits = placed.join(templates, "h").withColumn("p", (F.col("at") - 1) % F.greatest("n_words", F.lit(1)))
    # each kind of hash meets its own templates only: pairs the phrases, runs the notices
    first_half = (F.col("at") - 1) < F.col("n_words")
    hits = hits.filter((F.col("template") == MARKER) | (F.col("base") == first_half))

    copies = F.sum(F.when(F.col("template") == MARKER, 1))
    diagonals = (
        hits.groupBy("id", "digest", "n_words", "template", "label", "base", "runs", (F.col("p") - F.col("t")).alias("diagonal"))
        .agg(copies.alias("copies"), F.collect_set("t").alias("places"))  # at most a template's runs
    )
    beside = Window.partitionBy("id", "digest", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(beside)) > F.when(F.col("base"), F.lit(0)).otherwise(F.lit(NEAR))
    merged = (
        diagonals.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(beside))
        .groupBy("id", "digest", "n_words", "template", "label", "base", "runs", "span")
        .agg(
            F.max("copies").alias("copies"),
            F.min(F.col("diagonal") + F.array_min("places")).alias("first"),
            F.max(F.col("diagonal") + F.array_max("places")).alias("last"),
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"),
        )
        .withColumn("score", F.col("covered") / F.col("runs"))
    )
    holds = F.col("score") >= F.when(F.col("base"), F.lit(1.0)).otherwise(F.lit(COVERAGE))
    span = F.struct("first", "last", "label", "base", "score")
    return merged.groupBy("id", "digest", "n_words").agg(
        F.max("copies").alias("copies"),
        F.sort_array(F.collect_list(F.when((F.col("template") != MARKER) & holds, span))).alias("spans"),
    )


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=None, notices=None) -> DataFrame:
    """(<id>, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per document."""
    found = scan(docs, id_col=id_col, text_col=text_col, phrases=phrases, notices=notices)
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first"])).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
