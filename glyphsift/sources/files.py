"""Reading texts and reference tables, writing reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsift.functions import unicode_tables as U
from glyphsift.functions.text import redact_secrets
from glyphsift.operators import rewrite, similarity

SCHEMA_VERSION = "1.0"
DISCLAIMER = "A score says how unusual a text is under a test; it is no verdict on who or what wrote it."


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: whole files; malformed bytes become U+FFFD."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def text_frame(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "doc_id long, text string")


def code_points(spark: SparkSession) -> DataFrame:
    """``kind, class``: the detectors' character classes."""
    rows = [("zero_width", U.format_chars()), ("tags_block", U.TAGS), ("variation_selectors", U.SELECTORS), ("bidi_override", U.BIDI), ("whitespace", U.SPACES_BOM)]
    return spark.createDataFrame(rows, "kind string, class string")


def confusables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(chr(k), v) for k, v in U.CONFUSABLES.items()], "ch string, latin string")


def lexicon(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``pivot, words, back``: the last word of a pivot is what a round trip gives."""
    return spark.createDataFrame([(p, w, w[-1]) for p, w in rewrite.load_lexicon(path).items()], "pivot string, words array<string>, back string")


def language_specs(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``lang, metric, threshold, char_n, word_n``: the engine's own, or those of JSON ``{lang: {metric, threshold, char_n, word_n}}``."""
    if path is None:
        return similarity.specs(spark)
    with open(path, encoding="utf-8") as f:
        rows = [(lang.lower(), x["metric"], float(x["threshold"]), x.get("char_n"), x.get("word_n")) for lang, x in json.load(f).items()]
    return spark.createDataFrame(rows, similarity.specs(spark).schema)


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``lang, label, before, after`` from JSON ``{lang: {label: [[before, after], ...]}}``."""
    raw = spark.read.text(path, wholetext=True)
    kind = "map<string, map<string, array<array<string>>>>"
    langs = raw.select(F.explode(F.from_json("value", kind)).alias("lang", "__m")).select("lang", F.explode("__m").alias("label", "__p"))
    return langs.select("lang", "label", F.explode("__p").alias("__x")).select("lang", "label", F.get("__x", F.lit(0)).alias("before"), F.get("__x", F.lit(1)).alias("after"))


def report_json(report: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``json``: one report a row, secrets redacted; payloads are never in clear."""
    cols = columns or [c for c in report.columns if c != "text"]
    body = F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), *[F.col(c) for c in cols], F.lit(DISCLAIMER).alias("disclaimer")))
    return report.select(redact_secrets(body).alias("json"))


def write_reports(report: DataFrame, path: str) -> None:
    report_json(report).select(F.col("json").alias("value")).write.text(path)


def finding_lines(found: Column) -> Column:
    """A Markdown list of a report's findings."""
    return F.array_join(F.transform(found, lambda f: F.format_string("- **%s** (%s): %s, %d", f["kind"], f["severity"], f["summary"], f["hits"])), "\n")


def to_markdown(report: DataFrame, key: str = "doc_id", limit: int = 1000) -> str:
    """The first reports as Markdown; rendering is for people, so it is bounded."""
    rows = report.select(F.col(key).cast("string").alias("k"), "words", redact_secrets(finding_lines(F.col("findings"))).alias("lines")).orderBy(key).limit(limit).collect()
    parts = [f"## {r.k}\n\nWords: {r.words}\n\n{r.lines or 'No findings.'}\n" for r in rows]
    return "\n".join([*parts, DISCLAIMER])


def calibration_json(result: dict) -> str:
    claim = "exceeds the style baseline" if result.get("exceeds") else "is within the style baseline"
    return json.dumps({"schema_version": SCHEMA_VERSION, **result, "claim": claim, "disclaimer": DISCLAIMER}, indent=2, sort_keys=True)


def calibration_markdown(result: dict) -> str:
    return f"# Calibration\n\nGap {result['gap']:.3f}, false-positive rate {result['fpr']:.3f}: the candidate {'exceeds' if result.get('exceeds') else 'is within'} the style baseline.\n\n{DISCLAIMER}\n"


def benchmark_markdown(bench: DataFrame) -> str:
    rows = bench.orderBy("scheme", "transform").collect()
    lines = ["| scheme | transform | z before | z after | drop | TPR before | TPR after |", "| --- | --- | --- | --- | --- | --- | --- |"]
    return "\n".join([*lines, *(f"| {r.scheme} | {r.transform} | {r.z_before:.2f} | {r.z_after:.2f} | {r['drop'] or 0:.2f} | {r.tpr_before:.2f} | {r.tpr_after:.2f} |" for r in rows)])
