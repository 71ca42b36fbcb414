"""Scalar functions over a text column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import unicode_tables as U

#: What a secret looks like, in the order of replacement.
SECRETS = [r"sk-[A-Za-z0-9]{16,}", r"AIza[A-Za-z0-9_\-]{20,}", r"xai-[A-Za-z0-9]{16,}", r"(?i)(api[_-]?key|secret|token)\s*[:=]\s*\S+"]
REDACTED = "[REDACTED-SECRET]"
#: Fixed value: words below which a statistic says little.
USEFUL_WORDS = 400


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often lambdas within the body use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whitespace_tokens(text: Column) -> Column:
    """Tokens between runs of white space (Python's str.split)."""
    return F.filter(F.split(text, f"[{U.PY_SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{U.NOT_SPACE}]+"))


def prose_tokens(text: Column) -> Column:
    """Lower-case runs of a-z, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, f"^[{U.PY_SPACE}]+|[{U.PY_SPACE}]+\\z", "")


def redact_secrets(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def redact_payload(payload: Column) -> Column:
    """Length and SHA-256 of a payload instead of the payload."""
    return F.struct(F.octet_length(payload).alias("payload_len"), F.sha2(payload, 256).alias("payload_sha256"))


def length_confidence(words: Column) -> Column:
    return F.least(F.lit(1.0), words / F.lit(float(USEFUL_WORDS)))


def is_useful_length(words: Column) -> Column:
    return words > USEFUL_WORDS


def ascii_only(text: Column) -> Column:
    """One byte a character: the detectors of hidden characters pass such texts over."""
    return F.octet_length(text) == F.length(text)
