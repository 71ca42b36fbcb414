"""Carrier scans over the tables, with carriers injected where the tables have none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsift.functions import text as T
from glyphsift.functions import unicode_tables as U
from glyphsift.operators import carriers as C
from glyphsift.operators import rewrite as R
from glyphsift.sources.tables import table

EMOJI_TAIL = "\U0001f468‍\U0001f469 ❤️ \U0001f3f4\U000e0067\U000e0062\U000e007f"


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with a carrier by ``doc_id`` modulo 9 (0: none, 8: legitimate)."""
    t, half = F.col("text"), F.floor(F.length("text") / 2).cast("int")
    at = lambda s, n: F.concat(F.substr(t, F.lit(1), n), F.lit(s), F.substr(t, n + 1))
    case = F.pmod("doc_id", F.lit(9))
    out = F.when(case == 1, at("​", F.lit(1))).when(case == 2, F.concat(t, F.lit("\U000e0041\U000e0042"))).when(case == 3, F.concat(F.lit("x" + "️" * 4), t)).when(case == 4, at("‮", half))
    out = out.when(case == 5, F.concat(t, F.lit("<!-- hidden -->"))).when(case == 6, F.translate(t, " ", " ")).when(case == 7, F.concat(t, F.lit(" pаypal"))).when(case == 8, F.concat(t, F.lit(EMOJI_TAIL)))
    return table(spark, sf_dir, "documents").select("doc_id", "source", out.otherwise(t).alias("text"))


_TAIL = "chr(128104)||chr(8205)||chr(128105)||' '||chr(10084)||chr(65039)||' '||chr(127988)||chr(917607)||chr(917602)||chr(917631)"
INJ = f"""inj AS (SELECT doc_id, source, CASE doc_id % 9
 WHEN 1 THEN substr(text,1,1)||chr(8203)||substr(text,2) WHEN 2 THEN text||chr(917569)||chr(917570)
 WHEN 3 THEN 'x'||repeat(chr(65039),4)||text WHEN 4 THEN substr(text,1,length(text)//2)||chr(8238)||substr(text,length(text)//2+1)
 WHEN 5 THEN text||'<!-- hidden -->' WHEN 6 THEN replace(text,' ',chr(160)) WHEN 7 THEN text||' p'||chr(1072)||'ypal'
 WHEN 8 THEN text||{_TAIL} ELSE text END AS text FROM documents)"""


def _on_injected(value: Callable[[Column], Column], name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: injected(spark, d).select("doc_id", value(F.col("text")).cast("long").alias(name))


def _sql(value: str, name: str) -> str:
    return f"WITH {INJ} SELECT doc_id, CAST({value} AS BIGINT) AS {name} FROM inj"


def _n(cls: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '[{cls}]'))"


_WORDS = f"len(list_filter(regexp_split_to_array(text, '[{U.PY_SPACE}]+'), lambda x: x <> ''))"
_CH = "string_split(text, '')"
#: Characters with their neighbours, of the texts that have a candidate.
_CHARS = f"""chars AS (SELECT doc_id, ch, i, lag(ch) OVER w AS p, lead(ch) OVER w AS n, rtl FROM (
 SELECT doc_id, unnest({_CH}) AS ch, generate_subscripts({_CH}, 1) AS i, regexp_matches(text, '[{U.RTL}]') AS rtl FROM inj WHERE regexp_matches(text, '[{U.format_chars()}{U.SELECTORS}]'))
 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
zw AS (SELECT doc_id, count(*) AS hits FROM chars WHERE regexp_matches(ch, '[{U.plain_format()}]') OR (ch = chr(65279) AND i > 1)
 OR (ch IN (chr(8204), chr(8205)) AND NOT coalesce(regexp_matches(p, '[{U.EMOJI}{U.shaping()}]'), false) AND NOT coalesce(regexp_matches(n, '[{U.EMOJI}{U.shaping()}]'), false))
 OR (NOT rtl AND regexp_matches(ch, '[{U.MARKS}]')) GROUP BY doc_id),
vs AS (SELECT doc_id, count(*) AS hits FROM chars WHERE regexp_matches(ch, '[{U.SELECTORS}]')
 AND (coalesce(regexp_matches(p, '[{U.SELECTORS}]'), false) OR coalesce(regexp_matches(n, '[{U.SELECTORS}]'), false)
 OR NOT ((ch IN (chr(65038), chr(65039)) AND coalesce(regexp_matches(p, '[{U.EMOJI}]'), false)) OR (regexp_matches(ch, '[{U.of((0xE0100, 0xE01EF))}]') AND coalesce(regexp_matches(p, '[{U.script('CJK')}]'), false)))) GROUP BY doc_id)"""
INJ = f"{INJ}, {_CHARS}"
_ZW = "coalesce((SELECT hits FROM zw WHERE zw.doc_id = inj.doc_id), 0)"
_VS = "coalesce((SELECT hits FROM vs WHERE vs.doc_id = inj.doc_id), 0)"
_SETS = "[" + ",".join(f"CASE WHEN regexp_matches(w, '[{U.script(s)}]') THEN '{s}' END" for s in U.SCRIPTS) + "]"
_FIT = " OR ".join("len(list_filter(s, lambda x: x NOT IN (" + ",".join(f"'{c}'" for c in combo) + "))) = 0" for combo in U.ALLOWED)
_HG = f"""CASE WHEN NOT regexp_matches(text, '[{U.not_latin()}]') THEN 0 ELSE (
 SELECT count(*) FROM (SELECT list_filter({_SETS}, lambda x: x IS NOT NULL) AS s FROM (SELECT unnest(regexp_extract_all(text, '[{U.word_chars()}]+')) AS w) WHERE strlen(w) <> length(w))
 WHERE len(s) >= 2 AND NOT ({_FIT})) END"""
_DENSE = f"{_n(U.SPACES)} > greatest(1, {_WORDS} // 20)"
_SP = f"CASE WHEN {_DENSE} THEN {_n(U.SPACES_BOM)} ELSE 0 END"
_TR = "len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[ \\t]$')))"
_TAGFREE = f"regexp_replace(text, '\\x{{1F3F4}}[{U.of((0xE0000, 0xE007E))}]*\\x{{E007F}}', '', 'g')"
_TAG = _n(U.TAGS, _TAGFREE)


def _bodies(column: str) -> str:
    return f"list_filter(regexp_extract_all({column}, '(?s)<!--(.*?)-->', 1), lambda x: regexp_matches(x, '[^{U.PY_SPACE}]'))"



_KINDS = [("zero_width", _ZW, "high"), ("tags_block", _TAG, "high"), ("variation_selectors", _VS, "high"), ("homoglyph", _HG, "high"), ("bidi_override", _n(U.BIDI), "high"), ("markdown_comment", f"len({_bodies('text')})", "medium")]


def carrier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors in one scan: a row for each finding."""
    found = C.explained(C.detect_carriers(injected(spark, sf_dir)), "doc_id")
    return found.select("doc_id", F.col("f.kind").alias("kind"), F.col("f.severity").alias("severity"), F.col("f.hits").cast("long").alias("hits"))


_REPORT = f"WITH {INJ} SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, '{s}' AS severity, CAST({v} AS BIGINT) AS hits FROM inj" for k, v, s in _KINDS)
_REPORT += f" UNION ALL SELECT doc_id, 'whitespace', CASE WHEN {_DENSE} THEN 'medium' ELSE 'low' END, CAST(CASE WHEN {_DENSE} THEN {_SP} WHEN {_TR} >= 2 THEN {_TR} ELSE 0 END AS BIGINT) FROM inj) WHERE hits > 0"


def pages_comment_carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with hidden comments: how many, how long, which digest."""
    bodies = table(spark, sf_dir, "pages").select("page_id", C.comment_bodies(F.col("html")).alias("__b")).where(F.size("__b") > 0)
    payload = F.array_join("__b", "\n")
    return bodies.select("page_id", F.size("__b").cast("long").alias("comments"), F.octet_length(payload).cast("long").alias("payload_len"), F.sha2(payload, 256).alias("payload_sha256"))


def alarm_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of texts with a carrier of medium or high severity, by source."""
    found = C.detect_carriers(injected(spark, sf_dir)).select("source", "alarm")
    return found.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("alarm").cast("long")).alias("alarms"))


def located_bidi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offsets and lines of direction overrides."""
    return C.located(injected(spark, sf_dir).select("doc_id", "text"), f"[{U.BIDI}]").select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("start").cast("long").alias("start_byte"), F.col("end").cast("long").alias("end_byte"), F.col("line").cast("long").alias("line"))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts after normalisation: as long as before the injection, and clean at a second scan."""
    out = injected(spark, sf_dir).withColumn("text", R.normalize_carriers(F.col("text")))
    return C.detect_carriers(out).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "alarm")


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", T.redact_secrets(F.col("text")).alias("__r"))
    return docs.where(F.col("__r") != F.col("text")).select("doc_id", F.length("__r").cast("long").alias("n_chars"), F.sha2("__r", 256).alias("text_sha256"))


def length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.word_count(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", w.cast("long").alias("words"), F.round(T.length_confidence(w), 6).alias("confidence"), T.is_useful_length(w).alias("useful"))


def tags_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = injected(spark, sf_dir).where(C.tags_block(F.col("text")) > 0).select("doc_id", C.tags_payload(F.col("text")).alias("__p"))
    return found.select("doc_id", F.octet_length("__p").cast("long").alias("payload_len"), F.sha2("__p", 256).alias("payload_sha256"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON reports of the texts with an alarm."""
    from glyphsift.sources.files import report_json

    return report_json(C.alarmed(C.detect_carriers(injected(spark, sf_dir)), "doc_id", "words", "findings"))


def high_confidence_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that make a text's alarm, by kind."""
    found = C.explained(C.detect_carriers(injected(spark, sf_dir)).withColumn("findings", C.high_confidence(F.col("findings"))))
    return found.groupBy(F.col("f.kind").alias("kind")).agg(F.count("*").alias("docs"), F.sum("f.hits").alias("hits"))


_SECRET = "text"
for _p in T.SECRETS:
    _SECRET = f"regexp_replace({_SECRET}, '{_p}', '{T.REDACTED}', 'g')"
_W = f"CAST({_WORDS} AS BIGINT)"

QUERIES = {
    "pages_comment_carrier": pages_comment_carrier,
    "carrier_report": carrier_report,
    "carrier_zero_width": _on_injected(C.zero_width, "hits"),
    "carrier_tags_block": _on_injected(C.tags_block, "hits"),
    "carrier_variation_selectors": _on_injected(C.variation_selectors, "hits"),
    "carrier_homoglyph": _on_injected(C.homoglyph, "hits"),
    "carrier_spaces": _on_injected(C.substituted_spaces, "hits"),
    "carrier_bidi": _on_injected(C.bidi_override, "hits"),
    "carrier_tags_payload": tags_payload,
    "carrier_located": located_bidi,
    "carrier_alarm_by_source": alarm_by_source,
    "carrier_high_confidence": high_confidence_findings,
    "normalize_carriers": normalized,
    "redact_secrets": redacted,
    "length_gate": length_gate,
    "report_json": report_lines,
}
SQL = {
    "pages_comment_carrier": f"WITH b AS (SELECT page_id, {_bodies('html')} AS b FROM pages) SELECT page_id, len(b) AS comments, strlen(array_to_string(b, chr(10))) AS payload_len, sha256(array_to_string(b, chr(10))) AS payload_sha256 FROM b WHERE len(b) > 0",
    "carrier_report": _REPORT,
    "carrier_zero_width": _sql(_ZW, "hits"),
    "carrier_tags_block": _sql(_TAG, "hits"),
    "carrier_variation_selectors": _sql(_VS, "hits"),
    "carrier_homoglyph": _sql(_HG, "hits"),
    "carrier_spaces": _sql(_SP, "hits"),
    "carrier_bidi": _sql(_n(U.BIDI), "hits"),
    "carrier_tags_payload": f"WITH {INJ}, t AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all({_TAGFREE}, '[{U.of((0xE0020, 0xE007E))}]'), lambda c: chr(unicode(c) - 917504)), '') AS p FROM inj WHERE {_TAG} > 0) SELECT doc_id, CAST(strlen(p) AS BIGINT) AS payload_len, sha256(p) AS payload_sha256 FROM t",
    "carrier_located": f"WITH {INJ}, c AS (SELECT doc_id, text, unnest({_CH}) AS ch, generate_subscripts({_CH}, 1) AS i FROM inj WHERE regexp_matches(text, '[{U.BIDI}]')) SELECT doc_id, CAST(i - 1 AS BIGINT) AS idx, CAST(strlen(substr(text, 1, i - 1)) AS BIGINT) AS start_byte, CAST(strlen(substr(text, 1, i)) AS BIGINT) AS end_byte, CAST(1 + length(substr(text, 1, i - 1)) - length(replace(substr(text, 1, i - 1), chr(10), '')) AS BIGINT) AS line FROM c WHERE regexp_matches(ch, '[{U.BIDI}]')",
    "carrier_alarm_by_source": f"WITH r AS ({_REPORT}) SELECT source, count(*) AS n, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.doc_id = d.doc_id AND severity <> 'low') THEN 1 ELSE 0 END) AS BIGINT) AS alarms FROM documents d GROUP BY source",
    "carrier_high_confidence": f"WITH r AS ({_REPORT}) SELECT kind, count(*) AS docs, CAST(sum(hits) AS BIGINT) AS hits FROM r WHERE severity <> 'low' GROUP BY kind",
    # what normalisation has to give back: the text as it was, but for the legitimate tail, the x and the folded word
    "normalize_carriers": f"SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS text_sha256, false AS alarm FROM (SELECT doc_id, CASE doc_id % 9 WHEN 3 THEN 'x'||text WHEN 6 THEN CASE WHEN length(text) - length(replace(text,' ','')) > greatest(1, {_WORDS} // 20) THEN text ELSE replace(text,' ',chr(160)) END WHEN 7 THEN text||' paypal' WHEN 8 THEN text||{_TAIL} ELSE text END AS t FROM documents)",
    "redact_secrets": f"SELECT doc_id, CAST(length(r) AS BIGINT) AS n_chars, sha256(r) AS text_sha256 FROM (SELECT doc_id, text, {_SECRET} AS r FROM documents) WHERE r <> text",
    "length_gate": f"SELECT doc_id, {_W} AS words, round(least(1.0::DOUBLE, {_W} / 400.0::DOUBLE), 6) AS confidence, {_W} > 400 AS useful FROM documents",
}
