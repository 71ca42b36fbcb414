"""Carrier detectors: hidden signals in characters, as Column expressions.

Each detector counts hits in a row's text; :func:`findings` puts them together
in one projection, so a scan reads each text once and shuffles nothing.
Neighbour rules (emoji sequences, shaping scripts, flags) are lookarounds; a
missing neighbour is no emoji and has no script, so such a character is flagged.
Null text gives no finding.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphsift.functions import unicode_tables as U
from glyphsift.functions.text import ascii_only, let, word_count

FLAG = f"\\x{{1F3F4}}[{U.of((0xE0000, 0xE007E))}]*\\x{{E007F}}"
COMMENT = "(?s)<!--(.*?)-->"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _guarded(text: Column, value: Column, also: str = "") -> Column:
    """``value`` for texts with a character that could matter: all of them lie at U+0370 and above, but for those in ``also``.

    One class of one range, so texts of Latin letters never meet the long classes.
    """
    return F.when(text.isNull() | ascii_only(text), F.lit(0)).when(text.rlike(f"[{also}{U.of((0x370, 0x10FFFF))}]"), value).otherwise(0)


#: Where the detectors' characters lie, but for the long classes' few below.
HIGH = U.of((0x370, 0x10FFFF))


#: The only format character below.
SOFT = U.of(0xAD)


def rare(cls: str, low: str = "") -> str:
    """A class that is asked only about characters at U+0370 and above (and those in ``low``): each range of a class is a test of its own."""
    return f"[{low}{HIGH}&&[{cls}]]"


def has_rtl(text: Column) -> Column:
    return text.rlike(f"[{U.RTL}]")


def zero_width(text: Column) -> Column:
    """Format characters that no context clears."""
    clears = U.EMOJI + U.shaping()
    # the rare character first, so that the long classes are looked at only beside it
    joiners = _count(text, f"[{U.JOINERS}](?<!{rare(clears)}.)(?!{rare(clears)})")
    marks = F.when(has_rtl(text), 0).otherwise(_count(text, f"[{U.MARKS}]"))
    return _guarded(text, F.when(~text.rlike(rare(U.format_chars(), SOFT)), 0).otherwise(_count(text, rare(U.plain_format(), SOFT)) + _count(text, "(?s)(?<=.)\\x{FEFF}") + joiners + marks), SOFT)


def without_flags(text: Column) -> Column:
    return F.regexp_replace(text, FLAG, "")


def tags_block(text: Column) -> Column:
    """Tag characters outside subdivision flags."""
    return _guarded(text, F.when(~text.rlike(f"[{U.TAGS}]"), 0).otherwise(_count(without_flags(text), f"[{U.TAGS}]")))


def tags_payload(text: Column) -> Column:
    """The ASCII text that the tags spell."""
    found = F.regexp_extract_all(without_flags(text), F.lit(f"([{U.of((0xE0020, 0xE007E))}])"), F.lit(1))
    return F.array_join(F.transform(found, lambda c: F.char(F.ascii(c) - 0xE0000)), "")


def variation_selectors(text: Column) -> Column:
    """Selectors in runs of two or more, and single ones on a base that takes none."""
    runs = F.aggregate(F.regexp_extract_all(text, F.lit(f"([{U.SELECTORS}]{{2,}})"), F.lit(1)), F.lit(0), lambda n, x: n + F.length(x))
    single = _count(text, f"(?<![{U.SELECTORS}])[{U.SELECTORS}](?![{U.SELECTORS}])")
    fine = _count(text, f"[{U.of(0xFE0E, 0xFE0F)}](?<=[{U.EMOJI}].)(?![{U.SELECTORS}])") + _count(text, f"(?<=[{U.script('CJK')}])[{U.of((0xE0100, 0xE01EF))}](?![{U.SELECTORS}])")
    return _guarded(text, F.when(~text.rlike(f"[{U.SELECTORS}]"), 0).otherwise(runs + single - fine))


def scripts_of(word: Column) -> Column:
    """The scripts of a word's characters, in the order of SCRIPTS."""
    return F.array_compact(F.array(*[F.when(word.rlike(f"[{U.script(s)}]"), F.lit(s)) for s in U.SCRIPTS]))


def mixed_script(word: Column) -> Column:
    found = scripts_of(word)
    fine = [F.size(F.array_except(found, F.array(*map(F.lit, combo)))) == 0 for combo in U.ALLOWED]
    return (F.size(found) >= 2) & ~(fine[0] | fine[1])


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([{U.word_chars()}]+)"), F.lit(1))


#: Runs without ASCII separators: each word lies within one, and the class is cheap.
RUN = "[0-9A-Za-z_\\x{80}-\\x{10FFFF}]"
#: Runs with a letter that isn't Latin, each read once.
HIGH_RUN = f"((?<!{RUN})[0-9A-Za-z_\\x{{80}}-\\x{{36F}}]*+[{HIGH}]{RUN}*+)"


def homoglyph(text: Column) -> Column:
    """Words of two scripts or more that don't go together. Only runs with a letter that isn't Latin are taken apart."""
    runs = F.regexp_extract_all(text, F.lit(HIGH_RUN), F.lit(1))
    mixed = F.size(F.filter(F.flatten(F.transform(runs, words)), lambda w: F.when(ascii_only(w), F.lit(False)).otherwise(mixed_script(w))))
    return _guarded(text, F.when(~text.rlike(rare(U.not_latin())), 0).otherwise(mixed))


def dense_spaces(text: Column) -> Column:
    """More substituted spaces than typography explains."""
    return _count(text, f"[{U.SPACES}]") > F.greatest(F.lit(1), F.floor(word_count(text) / 20))


def substituted_spaces(text: Column) -> Column:
    return _guarded(text, F.when(~text.rlike(f"[{U.SPACES}]"), 0).when(dense_spaces(text), _count(text, f"[{U.SPACES_BOM}]")).otherwise(0), U.of(0xA0))


def trailing_space_lines(text: Column) -> Column:
    n = _count(text, "[ \\t](?=\\n|\\z)")
    return F.when(n >= 2, n).otherwise(0)


def comment_bodies(text: Column) -> Column:
    """Bodies of HTML comments that aren't blank."""
    found = F.filter(F.regexp_extract_all(text, F.lit(COMMENT), F.lit(1)), lambda x: x.rlike(f"[{U.NOT_SPACE}]"))
    return F.when(F.contains(text, F.lit("<!--")), found).when(text.isNotNull(), F.array().cast("array<string>"))


def bidi_override(text: Column) -> Column:
    return _guarded(text, _count(text, f"[{U.BIDI}]"))


def _finding(kind: str, hits: Column, severity: str, confidence: float, fpr: float, summary: str, payload: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    found = lambda n: F.struct(
        F.lit(kind).alias("kind"), F.lit(kind).alias("detector"), F.lit(severity).alias("severity"), F.lit("keyless").alias("posture"), F.lit(summary).alias("summary"), n.cast("int").alias("hits"),
        F.lit(confidence).alias("confidence"), F.lit(fpr).alias("fpr"),
        (F.octet_length(payload) if payload is not None else F.lit(None)).cast("int").alias("payload_len"), (F.sha2(payload, 256) if payload is not None else none).alias("payload_sha256"),
    )
    return let(hits, lambda n: F.when(n > 0, found(n)))


def _bodies(text: Column) -> Column:
    return F.array_join(comment_bodies(text), "\n")


#: Detector name -> finding (a struct, or null) of a text column.
DETECTORS: dict[str, Callable[[Column], Column]] = {
    "zero_width": lambda t: _finding("zero_width", zero_width(t), "high", 0.99, 0.0, "zero-width or format characters"),
    "tags_block": lambda t: _finding("tags_block", tags_block(t), "high", 0.99, 0.0, "characters of the tags block", tags_payload(t)),
    "variation_selectors": lambda t: _finding("variation_selectors", variation_selectors(t), "high", 0.97, 0.0, "variation selectors without a use"),
    "homoglyph": lambda t: _finding("homoglyph", homoglyph(t), "high", 0.9, 0.01, "words of mixed scripts"),
    "whitespace": lambda t: F.coalesce(
        _finding("whitespace", substituted_spaces(t), "medium", 0.7, 0.05, "substituted spaces"),
        _finding("whitespace", trailing_space_lines(t), "low", 0.7, 0.05, "lines that end in spaces"),
    ),
    "markdown_comment": lambda t: _finding("markdown_comment", F.size(comment_bodies(t)), "medium", 0.75, 0.05, "hidden comments", _bodies(t)),
    "bidi_override": lambda t: _finding("bidi_override", bidi_override(t), "high", 0.95, 0.0, "direction overrides"),
}


def register(name: str, detector: Callable[[Column], Column]) -> None:
    """Add a detector that :func:`findings` then runs as well."""
    DETECTORS[name] = detector


#: Detectors that have nothing to say about texts without a character of ``UNUSUAL``.
HIDDEN = ["zero_width", "tags_block", "variation_selectors", "homoglyph", "bidi_override"]
UNUSUAL = f"[{U.of(0xA0, 0xAD)}{HIGH}]"


def findings(text: Column, names: list[str] | None = None) -> Column:
    """``array<struct>`` of the detectors' findings, in their order.

    Texts without an unusual character are told by one look and meet only the
    detectors of plain text.  A detector that fails on a text fails the job, as
    any expression does; :func:`isolated` wraps one that may.
    """
    own = list(names or DETECTORS)
    all_ = lambda ns: F.array_compact(F.array(*[DETECTORS[n](text) for n in ns]))
    plain = [n for n in own if n not in HIDDEN]
    if plain == own:
        return all_(own)
    usual = F.coalesce(ascii_only(text), F.lit(True)) | ~text.rlike(UNUSUAL)
    return F.when(usual, all_(plain) if plain else F.filter(F.array(DETECTORS[own[0]](text)), lambda f: F.lit(False))).otherwise(all_(own))


def isolated(name: str, detector: Callable[[str], int]) -> Callable[[Column], Column]:
    """A detector of Python code (text to number of hits) whose failure on a text is a finding of its own: ``detector_error``, severity info.

    Register it like any other; built-in detectors are expressions that cannot fail on a text.
    """

    @F.pandas_udf("hits int, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        def one(t):
            try:
                return (0 if t is None else int(detector(t))), None
            except Exception as e:  # whatever a foreign detector raises becomes its finding
                return 0, type(e).__name__

        return pd.DataFrame([one(t) for t in texts], columns=["hits", "error"])

    def made(text: Column) -> Column:
        return let(run(text), lambda r: F.coalesce(_finding("detector_error", r["error"].isNotNull().cast("int"), "info", 0.0, 0.0, f"{name} failed"), _finding(name, r["hits"], "medium", 0.5, 0.05, f"found by {name}")))

    return made


def explained(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and one row for each finding (``f``).

    explode_outer: from a plain explode the optimizer infers that the array has
    entries, pushes that below the scan's exchange, and every detector runs twice.
    """
    return df.select(*columns, F.explode_outer("findings").alias("f")).where(F.col("f").isNotNull())


def alarmed(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the rows with an alarm.

    explode_outer, as in :func:`explained`: a filter goes below the projection, so every detector would run twice.
    """
    row = F.struct("alarm", *columns)
    return df.select(F.explode_outer(F.array(row)).alias("r")).where("r.alarm").select(*[F.col(f"r.{c}").alias(c) for c in columns])


def detect_carriers(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``words``, ``findings`` and ``alarm`` (a carrier of medium or high severity)."""
    out = df.withColumn("words", word_count(F.col(text))).withColumn("findings", findings(F.col(text)))
    return out.withColumn("alarm", F.size(high_confidence(F.col("findings"))) > 0)


def high_confidence(found: Column) -> Column:
    return F.filter(found, lambda f: (f["posture"] == "keyless") & f["severity"].isin("high", "medium") & ~f["kind"].isin("comparison", "attribution"))


def located(df: DataFrame, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, idx, ch, start, end, line``: each character that matches, with its UTF-8 bytes and 1-based line.

    Offsets are running sums over the exploded characters of texts that have a
    hit, so a flood of hits costs no more than its length.
    """
    hit = df.where(F.col(text).rlike(pattern)).select(key, F.posexplode(F.split(text, "")).alias("idx", "ch"))
    by = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = hit.withColumns({"end": F.sum(F.octet_length("ch")).over(by), "line": 1 + F.sum((F.col("ch") == "\n").cast("int")).over(by) - (F.col("ch") == "\n").cast("int")})
    return run.where(F.col("ch").rlike(pattern)).select(key, "idx", "ch", (F.col("end") - F.octet_length("ch")).alias("start"), "end", "line")
