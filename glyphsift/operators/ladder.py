"""The rewriting ladder behind the similarity gate, and the slot for a model of the user's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsift.operators import rewrite, similarity

NORMALIZE, EDIT, PARAPHRASE = 1, 2, 3
Model = Callable[[Column], Column]


def gateway(model: Model, name: str = "model") -> Callable[[Column], Column]:
    """A model that only ever sees sanitised text: ``struct<model, sent_sha256, sent_chars, answer>``, its own audit record."""

    def call(text: Column) -> Column:
        clean = rewrite.normalize_carriers(text)
        return F.struct(F.lit(name).alias("model"), F.sha2(clean, 256).alias("sent_sha256"), F.length(clean).alias("sent_chars"), model(clean).alias("answer"))

    return call


def paraphrase(text: Column, model: Model | None) -> Column:
    """The model's answer; refused when the plan is built if there is no model."""
    if model is None:
        raise ValueError("strength 3 needs a model: pass a function from column to column")
    return gateway(model)(text)["answer"]


def rewritten(df: DataFrame, strength: int = NORMALIZE, model: Model | None = None, threshold: float | None = None, roundtrip: bool = False, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, text, strength, accepted, meaning_score, message``.

    Carriers are normalised first at any strength.  Strength 2 edits tokens (or
    takes the dictionary round trip), strength 3 asks the model; if the result
    is less alike than its language's threshold, the normalised text comes back.
    """
    if strength not in (NORMALIZE, EDIT, PARAPHRASE):
        raise ValueError(f"no strength {strength}")
    clean = df.select(key, F.col(lang).alias("lang"), rewrite.normalize_carriers(F.col(text)).alias("before"))
    if strength == NORMALIZE:
        return clean.select(key, F.col("before").alias("text"), F.lit(strength).alias("strength"), F.lit(True).alias("accepted"), F.lit(1.0).alias("meaning_score"), F.lit("normalised").alias("message"))
    change = (lambda t: paraphrase(t, model)) if strength == PARAPHRASE else rewrite.roundtrip_translate if roundtrip else rewrite.token_edits
    pairs = clean.withColumn("after", change(F.col("before")))
    scored = similarity.with_spec(pairs.withColumn("score", similarity.score(F.col("before"), F.col("after"))))
    ok = F.col("score") >= (F.lit(threshold) if threshold is not None else F.col("threshold"))
    return scored.select(key, F.when(ok, F.col("after")).otherwise(F.col("before")).alias("text"), F.lit(strength).alias("strength"), ok.alias("accepted"), F.col("score").alias("meaning_score"), F.when(ok, "accepted").otherwise("meaning changed too much; normalised text returned").alias("message"))
