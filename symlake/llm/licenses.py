"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license notices.

A notice of m words and n distinct tokens is met by a block, m / t consecutive words of a text at
containment t (rounded up), that holds k = ceil(t n) of its tokens at least, its telling words among
them. Line breaks, comment marks and punctuation are no words, so wrapping doesn't count. The join of
all blocks with all notices goes over single tokens. A notice's tokens are ordered by how many
documents of the corpus hold them, rarest first; then
  prefix filter:     a block that meets it holds one of the n - k + 1 rarest (any k tokens reach into
                     that prefix), so only words around a prefix token are looked at,
  length filter:     these words have k distinct ones at least,
  position filter:   with the prefix token at place p the first that they share, k of the tokens from
                     place p on are among them.
What passes is counted in full, block by block. Notices are a table; what moves for a hit is twice
the longest block at most, and texts themselves stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm.common import broadcast_if_small, cut, prepare, stored

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
CONTAINMENT = 0.8
#: Short public notices: label, text, telling words (without which a block isn't of this license).
NOTICES = (
    ("apache-2.0", "under the Apache License, Version 2.0", "apache"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ""),
    ("mit", "under the MIT License", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ""),
    ("bsd", "under the BSD License", "bsd"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ""),
    ("gpl", "under the GNU General Public License, version", "gnu general"),
    ("gpl", "under the GPL license", "gpl"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general"),
    ("cc-by-nc", "licensed under CC BY NC", "cc by nc"),
    ("mpl-2.0", "under the Mozilla Public License version 2.0", "mozilla"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "mozilla"),
    ("public-domain", "this is free and unencumbered software released into the public domain", "unencumbered"),
)
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """The words of a text with single spaces between them.

    lower() does for A-Z what is asked; of other letters it makes none of the letters that a phrase
    or template is matched by, but for the Kelvin sign, which stays as it is.
    """
    kept = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ǂ"))
    return F.trim(F.regexp_replace(F.lower(kept), _SEPARATORS, " "))


def _words(line: Column) -> Column:
    return F.when(line == "", F.lit(0)).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _first(line: Column, phrase: str) -> Column:
    """The first word place of a phrase in padded words, or null."""
    at = F.instr(line, f" {phrase} ")
    return F.when(at > 0, at - 1 - F.length(F.replace(F.substring(line, F.lit(1), at - 1), F.lit(" "), F.lit(""))))


def _last(line: Column, phrase: str, words: Column) -> Column:
    back = F.reverse(line)
    at = F.instr(back, f" {phrase[::-1]} ")
    after = at - 1 - F.length(F.replace(F.substring(back, F.lit(1), at - 1), F.lit(" "), F.lit("")))
    return F.when(at > 0, words - after - len(phrase.split()))


def base_places(docs: DataFrame, line: str = "line") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word and base (labels), from the column of normalised words."""
    padded = F.concat(F.lit(" "), F.col(line), F.lit(" "))
    n_words = _words(F.col(line))
    some = F.col(line).rlike("|".join(PHRASES))
    # No phrase overlaps itself, so non-overlapping matches are all places.
    counts = {p: F.when(some, F.regexp_count(padded, F.lit(f" {p}(?= )"))).otherwise(F.lit(0)) for p in PHRASES}
    return docs.select(
        "*",
        n_words.cast("long").alias("n_words"),
        sum(counts.values()).cast("long").alias("n_base"),
        F.when(some, F.least(*(_first(padded, p) for p in PHRASES))).cast("long").alias("first_word"),
        F.when(some, F.greatest(*(_last(padded, p, n_words) for p in PHRASES))).cast("long").alias("last_word"),
        F.array_compact(F.array(*(F.when(counts[p] > 0, F.lit(label)) for p, label in PHRASES.items()))).alias("base"),
    )


def notice_table(spark: SparkSession, notices: tuple = NOTICES) -> DataFrame:
    return spark.createDataFrame(list(notices), "label string, notice string, telling string")


def _postings(notices: DataFrame, documents: DataFrame, containment: float) -> DataFrame:
    """One row per notice and prefix token: token, place (from 1), label, ordered (tokens, rarest first), need, width, telling."""
    split = lambda c: F.filter(F.split(normalised(F.col(c)), " "), lambda x: x != "")
    words = notices.select("label", split("notice").alias("words"), split("telling").alias("telling")).distinct().filter(F.size("words") > 0)
    words = cut(words.withColumn("id", F.monotonically_increasing_id()))
    tokens = words.select("id", F.explode(F.array_distinct("words")).alias("token"))
    sought = broadcast_if_small(cut(tokens.select("token").distinct()))
    # Counted in each task before the shuffle: one row per token in the end.
    held = documents.select(F.explode(F.array_distinct(F.split("line", " "))).alias("token")).join(sought, "token").groupBy("token").agg(F.count("*").alias("held"))
    ordered = tokens.join(held, "token", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "token"))).alias("o"))
    n = F.size("ordered")
    rows = words.join(ordered, "id").select("label", F.col("o.token").alias("ordered"), F.size("words").alias("m"), "telling")
    rows = rows.withColumn("need", F.ceil(n * containment - 1e-9).cast("int")).withColumn("width", F.ceil(F.col("m") / containment - 1e-9).cast("int"))
    return rows.select("label", "ordered", "need", "width", "telling", F.posexplode(F.slice("ordered", F.lit(1), n - F.col("need") + 1)).alias("place", "token")).withColumn("place", F.col("place") + 1)


def scan(docs: DataFrame, notices: DataFrame | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    docs needs doc_id and text, notices (NOTICES if None) label, notice and telling; other columns are
    ignored. Null and empty texts have no words and no labels. Rows stand for themselves, so null and
    repeated doc_ids change nothing. score is the greatest containment of a notice that one of the
    text's blocks meets, 1 where a phrase stands word for word, else 0. An empty table gives no rows,
    an empty list of notices leaves the phrases.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text").cast("string")).alias("line"))
    postings = cut(_postings(notice_table(spark) if notices is None else notices, rows, containment))
    # The driver sees the prefix tokens, which the list of notices bounds.
    prefix = sorted(r[0] for r in postings.select("token").distinct().collect())
    reach = postings.agg(F.max("width")).first()[0] or 1

    def around(words: Column) -> Column:
        def hit(x: Column, i: Column) -> Column:
            begin = F.greatest(i - (reach - 1), F.lit(0))
            return F.when(x.isin(prefix), F.struct(x.alias("token"), (i - begin + 1).alias("at"), F.slice(words, begin + 1, i - begin + reach).alias("near")))

        return F.filter(F.transform(words, hit), lambda h: h.isNotNull())

    # An array of one binds the words, which the lambdas read often.
    hits = F.flatten(F.transform(F.array(F.split("line", " ")), around)) if prefix else F.lit(None).cast("array<struct<token: string, at: int, near: array<string>>>")
    found = stored(base_places(rows).withColumn("hits", hits).drop("line").withColumn("row", F.monotonically_increasing_id()))

    pairs = found.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*").join(broadcast_if_small(postings), "token")
    begin = F.greatest(F.col("at") - F.col("width") + 1, F.lit(1))
    pairs = pairs.select("row", "label", "ordered", "need", "width", "telling", "place", (F.col("at") - begin + 1).alias("at"), F.slice("near", begin, F.col("at") - begin + F.col("width")).alias("near"))
    pairs = pairs.filter(F.size(F.array_distinct("near")) >= F.col("need"))
    pairs = pairs.filter(F.size(F.array_intersect(F.slice("ordered", F.col("place"), F.size("ordered")), "near")) >= F.col("need"))

    def shared(i: Column) -> Column:
        held = F.transform(F.array(F.slice("near", i, F.col("width"))), lambda w: F.when(F.size(F.array_except("telling", w)) == 0, F.size(F.array_intersect("ordered", w))))
        return F.get(held, F.lit(0))

    most = pairs.select("row", "label", "need", (F.array_max(F.transform(F.sequence(F.lit(1), F.col("at")), shared))).alias("most"), F.size("ordered").alias("n"))
    met = most.filter(F.col("most") >= F.col("need")).groupBy("row").agg(F.collect_set("label").alias("own"), F.max(F.col("most") / F.col("n")).alias("share"))
    placed = found.drop("hits").join(met, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    return placed.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
