"""The detectors on streams: stateless scans, alert windows, and running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsift.functions.text import redact_secrets, whitespace_tokens
from glyphsift.operators import carriers
from glyphsift.operators.keyed import GreenList
from glyphsift.operators.rewrite import normalize_carriers


def scan_stream(docs: DataFrame, text: str = "text") -> DataFrame:
    """Findings, a normalised and redacted text, and the alarm of each document; no state."""
    return carriers.detect_carriers(docs, text).withColumn("clean", redact_secrets(normalize_carriers(F.col(text))))


def keyed_stream(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return GreenList(key).detect(docs.withColumn("tokens", whitespace_tokens(F.col(text)))).drop("tokens")


def alert_windows(events: DataFrame, ts: str = "ts", alarm: str = "alarm", width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """``window, n, alarms`` over event time; events later than ``late`` are let go."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w).agg(F.count("*").alias("n"), F.sum(F.col(alarm).cast("long")).alias("alarms"))


def alert_sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``key, session, n``: runs of events without a longer gap."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("session")).agg(F.count("*").alias("n"))


def first_copies(docs: DataFrame, ts: str = "ts", text: str = "text", late: str = "1 hour") -> DataFrame:
    """The first of equal texts within the watermark."""
    return docs.withColumn("text_sha256", F.sha2(text, 256)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["text_sha256"])


def running_counts(docs: DataFrame, key: str = "source", mark_key: str = "demo", text: str = "text") -> DataFrame:
    """``key, green, scored`` so far, kept by Spark's own streaming aggregation."""
    c = docs.select(key, GreenList(mark_key).count(whitespace_tokens(F.col(text))).alias("__c"))
    return c.groupBy(key).agg(F.sum("__c.green").alias("green"), F.sum("__c.scored").alias("scored"))
