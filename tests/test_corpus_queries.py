"""Registered corpus queries read all documents, whatever their language."""

import math

from pyspark.sql import functions as F

from glyphsift.plans import corpus_queries


def test_prose_gap_of_any_language(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a b c d e f "), 5).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(60).cast("long").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    row = corpus_queries.prose_gap(spark, str(tmp_path)).first()
    assert row["z"] > 0 and row["gap"] > 0 and row["p"] < 1 / 21  # more permutations than 20


def _documents(spark, tmp_path, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(i))), 256).substr(1, 3) for i in range(60)]).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.pmod("id", F.lit(2))).alias("source"), F.lit(60).cast("long").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_partition_without_a_green_cell_has_no_z(spark, tmp_path):
    row = corpus_queries.partition_z(spark, _documents(spark, tmp_path, 0)).first()
    assert (row["hits"], row["n"], row["gamma"]) == (0, 0, 0) and math.isnan(row["z"])  # 0 / 0, as in the SQL


def test_candidate_and_baseline_read_the_choices_once(spark, tmp_path, monkeypatch):
    calls, of = [], corpus_queries.choices
    monkeypatch.setattr(corpus_queries, "choices", lambda *a: calls.append(a) or of(*a))
    assert 0 < corpus_queries.calibrated_candidate(spark, _documents(spark, tmp_path, 30)).first()["fpr"] <= 1
    assert len(calls) == 1
