"""Similarity gate: n-gram cosine by language, dense cosine, and its calibration."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

# Metric, threshold, character and word n of each language.
SPECS = [
    ("en", "word_char", 0.60, 3, 2), ("es", "word_char", 0.45, 3, 2), ("fr", "word_char", 0.45, 3, 2), ("de", "word_char", 0.45, 3, 2), ("ru", "word_char", 0.45, 3, 2),
    ("zh", "char", 0.25, 2, None), ("ja", "char", 0.45, 2, None), ("ko", "char", 0.25, 2, None), ("ar", "char", 0.52, 3, None), ("he", "char", 0.45, 3, None), ("hi", "char", 0.25, 3, None), ("und", "char", 0.25, 3, None),
]
EMBEDDING_THRESHOLD = 0.76


def specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPECS, "lang string, metric string, threshold double, char_n int, word_n int")


def with_spec(df: DataFrame, lang: str = "lang", table: DataFrame | None = None) -> DataFrame:
    """``df`` with the thresholds of its language; regions are dropped and unknown languages get ``und``.

    ``table``: other thresholds than the engine's own (``sources.files.language_specs``), with a row ``und``.
    """
    table = table if table is not None else specs(df.sparkSession)
    known = [r.lang for r in table.select("lang").limit(1000).collect()]  # languages of the world that have a code of their own are less
    code = F.lower(F.split_part(F.coalesce(F.col(lang), F.lit("und")), F.lit("-"), F.lit(1)))
    return df.withColumn("__lang", F.when(code.isin(known), code).otherwise("und")).join(F.broadcast(table.withColumnRenamed("lang", "__lang")), "__lang").drop("__lang")


def _char_codes(low: str, n: int) -> np.ndarray:
    """Each n-gram (n up to 3; of shorter texts the whole text) as one number: 21 bits hold any code point."""
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    n = min(n, len(points))
    codes = np.zeros(len(points) - n + 1 if n else 0, np.int64)
    for i in range(n):
        codes = (codes << 21) | points[i : i + len(codes)]
    return codes


def _char_grams(low: str, n: int) -> list[str]:
    return [low[i : i + n] for i in range(len(low) - n + 1)] if len(low) >= n else [low] if low else []


def _word_grams(low: str, n: int) -> list[str]:
    words = re.findall(r"[^ \t\n\x0b\f\r]+", low)
    return words + [" ".join(ws) for ws in zip(*(words[i:] for i in range(n)), strict=False)]


def _cosine(dot: int, x: int, y: int) -> float:
    return dot / math.sqrt(float(x) * float(y)) if x and y else 0.0


def _cosine_of_codes(a: np.ndarray, b: np.ndarray) -> float:
    (ua, na), (ub, nb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    both = np.isin(ua, ub, assume_unique=True), np.isin(ub, ua, assume_unique=True)
    return _cosine(int(na[both[0]] @ nb[both[1]]), int(na @ na), int(nb @ nb))


def _cosine_of_grams(a: list[str], b: list[str]) -> float:
    na, nb = Counter(a), Counter(b)
    square = lambda n: sum(c * c for c in n.values())
    return _cosine(sum(c * nb[g] for g, c in na.items() if g in nb), square(na), square(nb))


def text_score(a: str | None, b: str | None, char_n: int = 3, word_n: int | None = 2) -> float:
    """Cosine of the counts of two lower-case texts' character n-grams, or the greater of it and that of their words and word n-grams; 0 if either text has none."""
    if not a or not b:
        return 0.0
    if a == b:  # as the cosine would come out, to the bit
        return 1.0
    score = _cosine_of_codes(_char_codes(a, char_n), _char_codes(b, char_n)) if char_n <= 3 else _cosine_of_grams(_char_grams(a, char_n), _char_grams(b, char_n))
    return score if word_n is None else max(score, _cosine_of_grams(_word_grams(a, word_n), _word_grams(b, word_n)))


def score(before: Column, after: Column, char_n: int = 3, word_n: int | None = 2) -> Column:
    """Similarity of a row's two texts (see :func:`text_score`); within the row, so grams are neither written nor shuffled."""

    @F.pandas_udf(DoubleType())
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([text_score(x, y, char_n, word_n) for x, y in zip(a, b, strict=True)], dtype="float64")

    return scored(F.lower(before), F.lower(after))


def similarity(pairs: DataFrame, key: str = "pair_id", before: str = "before", after: str = "after", char_n: int = 3, word_n: int | None = 2) -> DataFrame:
    """``key, score``: character cosine, or the greater of character and word cosine; a row for each row."""
    return pairs.select(key, score(F.col(before), F.col(after), char_n, word_n).alias("score"))


def threshold_for(lang: str | None = None, explicit: float | None = None, embedding: bool = False) -> float:
    """Embedding before explicit before language."""
    if embedding:
        return EMBEDDING_THRESHOLD
    if explicit is not None:
        return explicit
    table = {r[0]: r[2] for r in SPECS}
    return table.get((lang or "und").lower().split("-")[0], table["und"])


def passes(score: Column, threshold: Column | float) -> Column:
    return score >= threshold


def dense_cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors or ones of different length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def separation_auc(scores: DataFrame, label: str = "label", positive: str = "preserved", score: str = "score") -> DataFrame:
    """``auc``: rank-sum form, ties count half; works on counts per score, so no pairs are formed."""
    pos = (F.col(label) == positive).cast("long")
    at = scores.groupBy(F.col(score).cast("double").alias("__s")).agg(F.sum(pos).alias("__p"), F.sum(1 - pos).alias("__n"))
    # running sums within ranges of the score, then over the ranges: no task sorts all scores
    cuts = sorted(set(scores.select(F.col(score).cast("double").alias("__s")).approxQuantile("__s", [i / 64 for i in range(1, 64)], 0.01)))
    at = at.withColumn("__bin", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("__s"))) if cuts else F.lit(0))
    bins = at.groupBy("__bin").agg(F.sum("__n").alias("__m"))  # 64 rows at most
    start = bins.select("__bin", (F.sum("__m").over(Window.orderBy("__bin")) - F.col("__m")).alias("__start"))
    within = F.coalesce(F.sum("__n").over(Window.partitionBy("__bin").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = at.withColumn("__in", within).join(start, "__bin").withColumn("__below", F.col("__start") + F.col("__in"))
    s = below.agg(F.sum(F.col("__p") * (F.col("__below") + 0.5 * F.col("__n"))).alias("u"), F.sum("__p").alias("p"), F.sum("__n").alias("n"))
    return s.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).otherwise(0.5).alias("auc"))


def threshold_at_false_accept(changed: list[float], target: float) -> float:
    """The lowest threshold that accepts at most that share of changed pairs."""
    if not changed:
        return 0.0
    ranked, k = sorted(changed), int(target * len(changed))
    return math.nextafter(ranked[-1], math.inf) if k == 0 else ranked[len(ranked) - k]


def language_thresholds(scores: DataFrame, target: float = 0.05) -> DataFrame:
    """``lang, threshold, true_accept, false_accept, n_preserved, n_changed`` from ``lang, label, score``.

    The threshold is the lowest that accepts at most that share of a language's
    changed pairs: with k of them allowed, the k-th greatest score, and the number
    above the greatest for none; 0 without changed pairs.  It is looked up in
    bins of scores, so no task sorts a whole language.
    """
    value, changed = F.col("score").cast("double"), F.col("label") == "changed"
    cuts = sorted(set(scores.select(value.alias("__s")).approxQuantile("__s", [i / 64 for i in range(1, 64)], 0.01)))
    binned = scores.select("lang", "label", value.alias("__s")).withColumn("__bin", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("__s"))) if cuts else F.lit(0))
    sizes = binned.where(changed).groupBy("lang", "__bin").agg(F.count("*").alias("__n"))  # 64 rows of a language at most
    own = Window.partitionBy("lang")
    down = own.orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumn("__k", F.greatest(F.lit(1), F.floor(F.lit(target) * F.sum("__n").over(own)))).withColumn("__none", F.floor(F.lit(target) * F.sum("__n").over(own)) == 0).withColumn("__upto", F.sum("__n").over(down))
    here = sizes.where((F.col("__upto") >= F.col("__k")) & (F.col("__upto") - F.col("__n") < F.col("__k"))).select("lang", "__bin", "__none", (F.col("__k") - F.col("__upto") + F.col("__n")).alias("__at"))
    ranked = binned.where(changed).join(here, ["lang", "__bin"]).withColumn("__r", F.row_number().over(Window.partitionBy("lang", "__bin").orderBy(F.desc("__s"))))
    found = ranked.where("__r = __at").select("lang", F.when(F.col("__none"), next_above(F.col("__s"))).otherwise(F.col("__s")).alias("threshold"))
    judged = binned.join(found, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    rate = lambda label: F.coalesce(F.avg(F.when(F.col("label") == label, (F.col("__s") >= F.col("threshold")).cast("double"))), F.lit(0.0))
    count = lambda label: F.sum((F.col("label") == label).cast("long"))
    return judged.groupBy("lang").agg(F.max("threshold").alias("threshold"), rate("preserved").alias("true_accept"), rate("changed").alias("false_accept"), count("preserved").alias("n_preserved"), count("changed").alias("n_changed"))


@F.pandas_udf(DoubleType())
def next_above(score: pd.Series) -> pd.Series:
    """The next greater number; one row of a language comes here."""
    return score.map(lambda x: math.nextafter(x, math.inf))


def fidelity(pairs: DataFrame, key: str = "pair_id", threshold: float = 0.5) -> DataFrame:
    """``key, score, accepted``."""
    return similarity(pairs, key).withColumn("accepted", F.col("score") >= threshold)
