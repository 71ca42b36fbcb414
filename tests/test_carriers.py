"""Carrier detectors on labelled texts, neighbour rules and floods."""

import time

import pytest
from pyspark.sql import functions as F

from glyphsift.operators import carriers as C
from glyphsift.operators import rewrite as R

Z, J, VS = "​", "‍", "️"
POSITIVE = [
    ("zero_width", f"hid{Z}den"), ("zero_width", f"a{J}b"), ("zero_width", "soft­hyphen"), ("zero_width", "x﻿y"), ("zero_width", J), ("zero_width", "left‎right"),
    ("tags_block", "tag \U000e0041\U000e0042"), ("tags_block", "\U000e0068\U000e0069"), ("tags_block", "\U0001f3f4\U000e0067 no cancel"),
    ("variation_selectors", "x" + VS * 4), ("variation_selectors", "a" + VS), ("variation_selectors", VS), ("variation_selectors", "x\U000e0100"),
    ("bidi_override", "a‮b"), ("bidi_override", "a‭b"),
    ("markdown_comment", "text <!-- hidden --> more"), ("markdown_comment", "<!--\nlines\n-->"),
    ("whitespace", "a\u00a0b\u00a0c\u00a0d"), ("whitespace", "a\u2009b\u2009c d"), ("whitespace", "line \nline \nend"),
    ("homoglyph", "pаypal"), ("homoglyph", "gοοd"), ("homoglyph", "Сomputer"),
]
LEGITIMATE = [
    "plain ascii prose, nothing else", "", "naïve café", "\U0001f468‍\U0001f469 family", "❤️ heart", "\U0001f3f4\U000e0067\U000e0062\U000e007f flag", "﻿leading mark",
    "مرحبا‌بك", "क्‍ष", "שלום‏ עולם", "漢字かなカナ", "한국어漢字", "русский текст", "ελληνικά", "10 000 km", "<!-- -->", "葛\U000e0100", "one trailing \nline", "日本語abc", "Ünïcödé",
]


def kinds(df):
    return {r.doc_id: set(r.kinds) for r in C.detect_carriers(df).select("doc_id", F.transform("findings", lambda f: f["kind"]).alias("kinds")).collect()}


def test_labelled(spark):
    rows = [(i, t) for i, (_, t) in enumerate(POSITIVE)] + [(1000 + i, t) for i, t in enumerate(LEGITIMATE)] + [(9999, None)]
    got = kinds(spark.createDataFrame(rows, "doc_id long, text string"))
    for i, (kind, text) in enumerate(POSITIVE):
        assert kind in got[i], (kind, text)
    for i, text in enumerate(LEGITIMATE):
        assert not got[1000 + i], (text, got[1000 + i])
    assert not got[9999]


def test_overrides_are_format_characters_too(spark):
    assert kinds(spark.createDataFrame([(0, "a‮b")], "doc_id long, text string"))[0] == {"zero_width", "bidi_override"}


def test_only_severe_findings_alarm(spark):
    rows = C.detect_carriers(spark.createDataFrame([(0, "a \nb \nc"), (1, f"a{Z}")], "doc_id long, text string")).select("doc_id", "alarm").collect()
    assert {r.doc_id: r.alarm for r in rows} == {0: False, 1: True}


def test_payload_is_redacted(spark):
    f = spark.createDataFrame([("x\U000e0068\U000e0069",)], "text string").select(C.DETECTORS["tags_block"](F.col("text")).alias("f"), C.tags_payload(F.col("text")).alias("p")).first()
    assert f.p == "hi" and f.f.payload_len == 2 and len(f.f.payload_sha256) == 64


def test_located(spark):
    text = f"aé{Z}\nb{Z}"
    got = C.located(spark.createDataFrame([(0, text)], "doc_id long, text string"), f"[{Z}]").orderBy("idx").collect()
    assert [(r.idx, r.start, r.end, r.line) for r in got] == [(2, 3, 6, 1), (5, 8, 11, 2)]


@pytest.mark.parametrize("ch", [Z, "\U000e0041"])
def test_flood(spark, ch):
    df = spark.createDataFrame([(0, "x" + ch * 200_000)], "doc_id long, text string")
    kinds(df.limit(0))
    began = time.time()
    assert kinds(df)[0]
    assert time.time() - began < 20


def test_normalised_text_is_clean(spark):
    rows = [(i, t) for i, (k, t) in enumerate(POSITIVE) if "line \n" not in t]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", R.normalize_carriers(F.col("text")))
    got = kinds(df.where("text is not null"))
    assert all(not v for v in got.values()), {k: v for k, v in got.items() if v}
    same = spark.createDataFrame([(i, t) for i, t in enumerate(LEGITIMATE) if "<!--" not in t], "doc_id long, text string")
    assert same.where(R.normalize_carriers(F.col("text")) != F.col("text")).count() == 0


def test_register(spark):
    C.register("digits", lambda t: C._finding("digits", F.regexp_count(t, F.lit("[0-9]")), "info", 0.1, 0.5, "digits"))
    try:
        assert kinds(spark.createDataFrame([(0, "a1")], "doc_id long, text string"))[0] == {"digits"}
    finally:
        del C.DETECTORS["digits"]


def test_report_plan(spark):
    """The detectors run once, above the exchange: no filter on the findings is pushed below it."""
    df = spark.range(8).select(F.col("id").alias("doc_id"), F.concat(F.lit("x\u200b"), F.col("id").cast("string")).alias("text")).repartition(2)
    report = C.explained(C.detect_carriers(df), "doc_id")
    below = report._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[1]
    assert "200B" not in below and report.count() == 8


def test_failing_detector(spark):
    """A detector that raises on a text gives an info finding there and goes on elsewhere."""
    C.register("shout", C.isolated("shout", lambda t: 1 // (len(t) - 4) if t.isupper() else 0))
    try:
        rows = spark.createDataFrame([(0, "AAAA"), (1, "AAAAA"), (2, "aaa"), (3, None)], "doc_id long, text string")
        got = {(r.doc_id, r.f.kind, r.f.severity) for r in C.explained(C.detect_carriers(rows), "doc_id").collect()}
    finally:
        del C.DETECTORS["shout"]
    assert got == {(0, "detector_error", "info"), (1, "shout", "medium")}


def test_long_texts(spark):
    """Long texts of one kind of character are read in linear time."""
    rows = [(0, "\u200b" * 200_000), (1, "\U000e0041" * 200_000), (2, "a" * 200_000), (3, "д" * 200_000), (4, "é" * 200_000 + "д")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    C.detect_carriers(df.limit(1)).collect()
    began = time.perf_counter()
    hits = {r.doc_id: [(f.kind, f.hits) for f in r.findings] for r in C.detect_carriers(df).collect()}
    assert time.perf_counter() - began < 20
    assert hits[0] == [("zero_width", 200_000)] and hits[1] == [("tags_block", 200_000)] and not hits[2] and not hits[3] and hits[4] == [("homoglyph", 1)]
