"""License notices by diagonal voting.

Every rolling run of ``GRAM`` words of a document is joined to the positions at which that
run stands in a license template.  A hit votes for the diagonal ``word position - template
position``; votes are aggregated by diagonal, neighbouring diagonals (a few inserted or
missing words) are merged to one span, and a span is verified by the share of the template's
runs it holds and by its length.  Exact phrases are found beside that.  The joined templates
are the fixed table below, so their broadcast has a fixed size.

Null and empty texts have no words and no labels (score 0).  Rows that share an id are one
document whose rows are scanned apart and whose votes are pooled, so each of them gets the same method labels;
a null id is an id of its own.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sqltext import alnum_words, let, match_starts, quoted

GRAM = 3
MERGE_DIAGONALS = 2
MIN_COVERAGE = 0.6
MAX_STRETCH = 1.5

# Phrase -> label, and label -> template words.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
)


def template_grams(spark: SparkSession) -> DataFrame:
    """(template, label, n_grams, t_len, t_pos, g0..g2): each word run of each template."""
    rows = []
    for number, (label, text) in enumerate(TEMPLATES):
        words = text.split()
        n = len(words) - GRAM + 1
        rows += [(number, label, n, len(words), i, *words[i : i + GRAM]) for i in range(n)]
    return spark.createDataFrame(rows, "template int, label string, n_grams int, t_len int, t_pos int, g0 string, g1 string, g2 string")


def phrase_places(words: Column) -> Column:
    """Word positions at which a phrase starts: array of (label, place), gathered phrase by phrase."""

    def places(joined: Column, phrase: str, label: str) -> Column:
        spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
        n = len(phrase.split())

        def starts(pieces: Column) -> Column:
            gaps = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), spaces)
            places = let(gaps, lambda g: match_starts(g, F.array_repeat(F.lit(n), F.size(g))))
            return F.transform(places, lambda x: F.struct(F.lit(label).alias("label"), x.cast("long").alias("place")))

        empty = F.array().cast("array<struct<label:string,place:bigint>>")
        return F.when(F.contains(joined, F.lit(f" {phrase} ")), let(F.split(joined, f" {phrase}(?= )", -1), starts)).otherwise(empty)

    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return let(joined, lambda j: F.concat(*[places(j, p, label) for p, label in PHRASES]))


def method_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans: (id, label, first, last, coverage); ``last`` is exclusive, both in words."""
    words = docs.select(F.col(quoted(id_col)).alias("id"), alnum_words(F.col(quoted(text_col))).alias("w")).where(F.size("w") >= GRAM)
    runs = words.select("id", F.posexplode(F.slice(F.arrays_zip(
        F.col("w").alias("w0"), F.slice("w", F.lit(2), F.size("w")).alias("w1"), F.slice("w", F.lit(3), F.size("w")).alias("w2"),
    ), F.lit(1), F.size("w") - (GRAM - 1))))
    runs = runs.select("id", "pos", F.col("col.w0").alias("w0"), F.col("col.w1").alias("w1"), F.col("col.w2").alias("w2"))
    t = template_grams(docs.sparkSession)
    same = (F.xxhash64("w0", "w1", "w2") == F.xxhash64("g0", "g1", "g2")) & (F.col("w0") == F.col("g0")) & (F.col("w1") == F.col("g1")) & (F.col("w2") == F.col("g2"))
    hits = runs.join(F.broadcast(t), same).withColumn("diagonal", F.col("pos") - F.col("t_pos"))
    votes = hits.groupBy("id", "template", "label", "n_grams", "t_len", "diagonal").agg(
        F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"),
    )
    w = Window.partitionBy("id", "template").orderBy("diagonal")
    opened = votes.withColumn("opens", F.when(F.col("diagonal") - F.lag("diagonal").over(w) <= MERGE_DIAGONALS, 0).otherwise(1))
    numbered = opened.withColumn("span", F.sum("opens").over(w))
    spans = numbered.groupBy("id", "template", "label", "n_grams", "t_len", "span").agg(
        F.sum("votes").alias("votes"), F.min("lo").alias("first"), (F.max("hi") + GRAM).alias("last"),
    ).withColumn("coverage", F.least(F.lit(1.0), F.col("votes") / F.col("n_grams")))
    return spans.where(
        (F.col("coverage") >= MIN_COVERAGE) & (F.col("last") - F.col("first") <= F.col("t_len") * MAX_STRETCH)
    ).select("id", "label", F.col("first").cast("long"), F.col("last").cast("long"), "coverage")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, places (phrase label and word position), method labels and coverage."""
    words = alnum_words(F.col(quoted(text_col)))
    base = docs.select(F.col(quoted(id_col)).alias("id"), words.alias("w")).select(
        "id", F.size("w").cast("long").alias("n_words"), phrase_places(F.col("w")).alias("places"),
    )
    # at most one label a template, so the gathered set is bounded by the fixed table
    found = method_spans(docs, id_col, text_col).groupBy(F.col("id").alias("found_id")).agg(
        F.collect_set("label").alias("method_labels"), F.max("coverage").alias("coverage"),
    )
    return base.join(found, F.col("id").eqNullSafe(F.col("found_id")), "left").drop("found_id")
