"""License scans by diagonal voting (operator 9).  DataFrame functions only.

Method: every rolling 2-gram of words in a text is hashed and joined to the
places of the same 2-gram in the templates.  A hit votes for the diagonal
(place in the text less place in the template), and votes are added up for each
diagonal.  A phrase, or a notice of fewer than ``WHOLE`` words, stands where a
diagonal's words are all the template's.  For longer notices the diagonals that
are at most ``SLACK`` words apart are merged (words were added or lost on the
way), and the span is verified: of the template's words, each place once, as
many as stand there in ascending order (their longest common subsequence with the
words from ``PAD`` before the diagonal to ``PAD`` after its end) are its score.

Only hits leave a text's row, each with the few words around it that the check
needs, so a text is read once, never shuffled, and never copied for each word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphsift.functions.text import let
from glyphsift.sources.tables import table

from .common import identified, stored

#: Base phrases: found only as they stand.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
#: Notices: found when most of their words stand in order; short ones when they stand whole.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("creative-commons", "licensed under a creative commons attribution"),
    ("proprietary", "all rights reserved"),
]
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SLACK, PAD, WHOLE = 3, 8, 8
#: Most words of a template (a place is a bit of a long), and most 2-grams of all templates, which are broadcast.
TEMPLATE_WORDS, TEMPLATE_GRAMS = 62, 100_000


def scan_words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased.

    lower() also folds other letters, which never makes them ASCII but for the
    Kelvin sign; that one is masked, so ASCII words come out as they have to.
    """
    folded = F.lower(F.regexp_replace(text, "K", "�"))
    return F.filter(F.split(folded, NOT_WORD), lambda w: w != "")


def templates(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """``tid, label, base, whole, twords, masks, tpos, gram``: a row for each 2-gram.

    ``masks``: for each word, the bits of its places.
    """
    rows = []
    for tid, (label, text, base) in enumerate([(a, b, True) for a, b in phrases] + [(a, b, False) for a, b in notices]):
        ws = text.split()
        if not 2 <= len(ws) <= TEMPLATE_WORDS:
            raise ValueError(f"a template has 2 to {TEMPLATE_WORDS} words: {text}")
        rows.append((tid, label, base, base or len(ws) < WHOLE, ws, {w: sum(1 << i for i, x in enumerate(ws) if x == w) for w in ws}))
    if sum(len(r[4]) for r in rows) > TEMPLATE_GRAMS:
        raise ValueError(f"more than {TEMPLATE_GRAMS} words of templates")
    frame = spark.createDataFrame(rows, "tid int, label string, base boolean, whole boolean, twords array<string>, masks map<string, long>")
    return frame.select("*", F.posexplode(_grams(F.col("twords"))).alias("tpos", "gram"))


def _grams(ws: Column) -> Column:
    return F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1)))


def in_order(ws: Column, masks: Column, size: Column) -> Column:
    """Length of the longest common subsequence of words and a template, a bit for each of its places: cleared ones are matched."""
    full = F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1
    hit = lambda v, w: v.bitwiseAND(F.coalesce(F.try_element_at(masks, w), F.lit(0).cast("long")))
    left = F.aggregate(ws, full, lambda v, w: (v + hit(v, w)).bitwiseOR(v - hit(v, w)).bitwiseAND(full))
    return size - F.bit_count(left)


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, share: float = 0.6) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``, one row per input row.

    Null text has no words.  Without a find the label columns are empty strings,
    the places null and the score 0; ``score`` is the largest share of a
    template's words found in order, 1 for a phrase.  Repeated rows give repeated
    rows, an empty table none.
    """
    tpl = templates(docs.sparkSession, phrases, notices)
    known = [r.gram for r in tpl.select("gram").distinct().collect()]  # TEMPLATE_GRAMS at most
    reach = TEMPLATE_WORDS + PAD
    # hits of a text, with the words around each; ``from``: the place of the first of them
    around = lambda ws, g: F.struct(g["at"].alias("at"), g["gram"].alias("gram"), F.greatest(g["at"] - reach, F.lit(0)).alias("from"), F.slice(ws, F.greatest(g["at"] - reach, F.lit(0)) + 1, 2 * reach).alias("words"))
    hits = lambda ws: F.transform(F.filter(F.transform(_grams(ws), lambda g, i: F.struct(i.alias("at"), g.alias("gram"))), lambda g: g["gram"].isin(known)), lambda g: around(ws, g))
    base = identified(docs)
    each = base.select("__d", "__t", "doc_id", let(scan_words(F.col("text")), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), hits(ws).alias("hits"))).alias("__x"))
    each = stored(each.select("__d", "__t", "doc_id", F.col("__x.n").alias("n_words"), F.col("__x.hits").alias("__hits")), "hits")

    # the templates are bounded by TEMPLATE_GRAMS
    hits = each.select("__d", "__t", F.explode("__hits").alias("h")).select("__d", "__t", "h.*").join(F.broadcast(tpl), "gram")
    diag, size = (F.col("at") - F.col("tpos")).alias("__diag"), F.size("twords")
    hits = hits.withColumn("__diag", diag).withColumn("__lead", F.greatest(F.col("__diag") - F.col("from"), F.lit(0)))
    # words of the text along the diagonal, and those of the template that they stand against (a text may begin or end within it)
    along = F.slice("words", F.col("__lead") + 1, size + F.least("__diag", F.lit(0)))
    agree = F.zip_with(along, F.slice("twords", 1 - F.least("__diag", F.lit(0)), size), lambda a, b: F.coalesce(a == b, F.lit(False)))
    hits = hits.withColumn("__agree", F.size(F.filter(agree, lambda x: x)))
    # a diagonal's span is verified at its first hit: the words are the same at each
    first = F.array_min(F.filter(F.transform(F.sequence(F.lit(0), size - 2), lambda i: F.when(F.get("words", F.col("__diag") + i - F.col("from")).eqNullSafe(F.get("twords", i)) & F.get("words", F.col("__diag") + i + 1 - F.col("from")).eqNullSafe(F.get("twords", i + 1)), i)), lambda i: i.isNotNull()))
    begin = F.greatest(F.col("__diag") - PAD, F.lit(0))
    span = F.slice("words", begin - F.col("from") + 1, F.col("__diag") + size + PAD - begin)
    found = F.when(F.col("whole"), F.when(F.col("__agree") == size, 1.0).otherwise(0.0)).when(F.col("tpos") == first, in_order(span, F.col("masks"), size) / size)
    votes = hits.select("__d", "__t", "tid", "label", "base", "__diag", found.alias("__score")).groupBy("__d", "__t", "tid", "label", "base", "__diag").agg(F.count("*").alias("__votes"), F.max("__score").alias("__score"))
    by = Window.partitionBy("__d", "__t", "tid").orderBy("__diag")
    step = F.when(F.col("base") | F.coalesce(F.col("__diag") - F.lag("__diag").over(by) > SLACK, F.lit(True)), 1).otherwise(0)
    spans = votes.withColumn("__new", step).withColumn("__span", F.sum("__new").over(by))
    spans = spans.groupBy("__d", "__t", "tid", "label", "base", "__span").agg(F.max("__score").alias("__score"), F.min("__diag").alias("__place"))
    spans = spans.where(F.col("__score") >= share).withColumn("__place", F.when(F.col("base"), F.col("__place")))
    found = spans.groupBy("__d", "__t").agg(
        F.count("__place").alias("n_base"), F.min("__place").alias("first_word"), F.max("__place").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("__score").alias("score"),
    )
    empty = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return each.select("__d", "__t", "doc_id", "n_words").join(found, ["__d", "__t"], "left").select("doc_id", "n_words", empty("n_base", 0), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), empty("base_labels", ""), empty("labels", ""), empty("score", 0.0))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
