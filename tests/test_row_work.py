"""Work that stays within a row, and is done once."""

import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from glyphsift.functions import text as T
from glyphsift.functions import unicode_tables as U
from glyphsift.operators import rewrite as R
from glyphsift.plans import carrier_queries, catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["rewrite_ladder", "rewrite_gate", "roundtrip_gate", "reorder_fidelity", "overlap_cost", "substitute_tokens"])
def test_no_shuffle_by_key(spark, name):
    assert "hashpartitioning" not in plan(catalog.queries()[name](spark, SF))


def test_classes():
    for cls in (U.PY_SPACE, U.word_chars()):
        inside = {c for a, b in U.spans_of(cls) for c in range(a, b + 1)}
        assert {c for a, b in U.spans_of(U.others(cls)) for c in range(a, b + 1)} == set(range(sys.maxunicode + 1)) - inside


def test_words_are_counted_without_negated_classes(spark):
    texts = ["a b", "", "  x y\u0085z\x1c", "\U0001f600 é　ß", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.word_count(F.col("text")).alias("n"))
    assert all(r.n == (None if r.text is None else len(r.text.split())) for r in df.collect())
    for name in ("length_gate", "canonicalize_c"):
        assert "[^" not in plan(catalog.queries()[name](spark, SF)).replace('[^"\\\\]', "").replace("[^'\\\\]", "").replace("[^\\n]", "")


def test_c_tokens(spark):
    code = "int naïve_x1 = 3.5; foo(été, été) → bar　/* gone */ « x »"
    want = [t for t in re.findall(r"[A-Za-z_]\w*|[0-9]+\.?[0-9]*|[^\w\s]", re.sub(r"/\*.*?\*/", " ", code))]
    got = spark.createDataFrame([(code,)], "c string").select(R.canonicalize_c(F.col("c"))).first()[0].split(" ")
    assert len(got) == len(want) and [w for w in got if unicodedata.category(w[0])[0] in "PS"] == [w for w in want if unicodedata.category(w[0])[0] in "PS" and w[0] != "_"]


def test_reports_run_the_detectors_once(spark):
    p = plan(carrier_queries.report_lines(spark, SF))
    assert "alarm" in p and not re.search(r"Filter [^\n]*<!--", p)


def test_lexicon_is_asked_by_a_set(spark):
    df = spark.createDataFrame([("Big bIG BIG house, xyzzy",)], "t string")
    assert "INSET" in plan(df.select(R.roundtrip_translate(F.col("t")))).upper()


def test_code_of_one_file_is_dealt_out(spark):
    df = catalog.queries()["code_forms_python"](spark, SF)
    rows = spark.read.parquet(f"{SF}/part.parquet").count()
    at = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(at) == rows and len(at) > 1 and max(at) < rows / 4
