"""Calibrated rates: pooled references, bootstrap of prose, and the active presence test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsift.operators import keyless, partition


def calibrate(references: list[DataFrame], candidate: DataFrame, k: int, n_slots: int, n_boot: int = 120, permutations: int = 60, alpha: float = 0.05) -> DataFrame:
    """``gap, fpr, exceeds`` of a candidate's choices against bootstraps of the pooled references."""
    gaps = [partition.bootstrap_gaps(r, k, n_slots, n_boot, permutations, source=str(i), seed=1000 * i) for i, r in enumerate(references)]
    gap = partition.steal_and_test(candidate, k, n_slots, permutations=max(permutations, 100)).first()["gap"]
    return partition.score_against_baseline(reduce(DataFrame.unionByName, gaps), gap, alpha)


def prose_bootstrap_gaps(samples: DataFrame, n_boot: int = 80, permutations: int = 40, seed: int = 0, source: str = "reference") -> DataFrame:
    """``source, b, gap`` from ``doc_id, tokens`` of one reference corpus; corpora of less than four samples give gaps of 0."""
    found = keyless.prose_bootstrap(samples.select("doc_id", "tokens", F.lit(source).alias("source")), n_boot=n_boot, permutations=permutations, seed=f"boot{seed}")
    enough = samples.agg((F.count("*") >= 4).alias("__ok"))
    draws = samples.sparkSession.range(n_boot).select(F.lit(source).alias("source"), F.col("id").cast("int").alias("b"))
    return draws.join(found, ["source", "b"], "left").crossJoin(enough).select("source", "b", F.when(F.col("__ok"), F.coalesce("gap", F.lit(0.0))).otherwise(0.0).alias("gap"))  # one row


def calibrate_prose(references: list[DataFrame], candidate: DataFrame, n_boot: int = 60, permutations: int = 40, alpha: float = 0.05) -> DataFrame:
    """``gap, fpr, exceeds``; all inputs ``doc_id, tokens``."""
    gaps = [prose_bootstrap_gaps(r, n_boot, permutations, 1000 * i, str(i)) for i, r in enumerate(references)]
    grams = keyless.bigrams_of(candidate.select("doc_id", F.posexplode("tokens").alias("pos", "tok")))
    found = keyless.prose_gap(grams, permutations=max(permutations, 100)).first()
    return partition.score_against_baseline(reduce(DataFrame.unionByName, gaps), found["gap"] if found else 0.0, alpha)


def active_presence(tokens: DataFrame, queried: str, control: str, ratio_threshold: float = 2.0) -> DataFrame:
    """``l1, baseline, ratio, present``: stored answers of a model against a control's (``arm, doc_id, tok``)."""
    return keyless.compare_arms(tokens, queried, control, ratio_threshold=ratio_threshold, seed="active").withColumnRenamed("flagged", "present")
