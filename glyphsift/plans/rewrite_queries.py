"""Rewriting transforms and language detection over the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsift.functions import text as T
from glyphsift.functions import unicode_tables as U
from glyphsift.operators import rewrite as R
from glyphsift.operators import similarity as S
from glyphsift.operators.ladder import gateway, rewritten
from glyphsift.sources import tables


def _over(value: Callable[[Column], Column], table: str = "documents", key: str = "doc_id", text: str = "text") -> Callable[[SparkSession, str], DataFrame]:
    """Length and digest of the rewritten texts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = tables.table(spark, sf_dir, table).select(key, value(F.col(text)).alias("__o"))
        return out.select(key, F.length("__o").cast("long").alias("n_chars"), F.sha2("__o", 256).alias("out_sha256"))

    return run


def _sql(value: str, table: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, CAST(length(o) AS BIGINT) AS n_chars, sha256(o) AS out_sha256 FROM (SELECT {key}, {value} AS o FROM {table})"


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select("doc_id", R.detect_language(F.col("text")).alias("detected"))


def language_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled against detected language."""
    docs = tables.table(spark, sf_dir, "documents").select("lang", R.detect_language(F.col("text")).alias("detected"))
    return docs.groupBy("lang", "detected").agg(F.count("*").alias("n"))


def roundtrip_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(R.roundtrip_tokens(T.whitespace_tokens(F.col("text"))), " ").alias("__o"))
    return out.select("conv_id", "turn", F.sha2("__o", 256).alias("out_sha256"))


def _gated(spark: SparkSession, sf_dir: str, candidate: Callable[[Column], Column]) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    pairs = docs.select("doc_id", "lang", R.normalize_carriers(F.col("text")).alias("before")).withColumn("after", candidate(F.col("before")))
    judged = S.with_spec(pairs.select("doc_id", "lang", S.score(F.col("before"), F.col("after")).alias("score")))
    return judged.select("doc_id", F.round("score", 6).alias("score"), S.passes(F.col("score"), F.col("threshold")).alias("accepted"))


def rewrite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength 2: token edits behind the similarity gate."""
    return _gated(spark, sf_dir, R.token_edits)


def roundtrip_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary round trip behind the similarity gate."""
    return _gated(spark, sf_dir, R.roundtrip_translate)


def rewrite_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength 2 over whole documents: what comes out, and whether the gate let it pass."""
    out = rewritten(tables.table(spark, sf_dir, "documents"), 2)
    return out.select("doc_id", F.sha2("text", 256).alias("out_sha256"), "accepted", "message")


def gateway_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model slot would be sent: the sanitised text, never the raw one."""
    from glyphsift.plans.carrier_queries import injected

    call = gateway(F.upper, "upper")(F.col("text"))
    return injected(spark, sf_dir).select("doc_id", call.alias("__c")).select("doc_id", F.col("__c.model").alias("model"), F.col("__c.sent_sha256").alias("sent_sha256"), F.col("__c.sent_chars").cast("long").alias("sent_chars"))


def code_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python forms of snippets made from part keys."""
    from glyphsift.operators.code_forms import canonicalize_python, structural_normalize

    code = F.format_string("def f%d(a, b):\n    # note %d\n    return b * %d + a if a > b else a and b\n", F.col("p_partkey"), F.col("p_partkey"), F.pmod("p_partkey", F.lit(7)))
    # keys alone are dealt out: a file of few row groups would be parsed in as few tasks, however large it is
    keys = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism)
    parts = keys.select("p_partkey", code.alias("__c"))
    return parts.select("p_partkey", canonicalize_python("__c").alias("canonical"), structural_normalize("__c").alias("structural"))


_EDIT = "text"
for _a, _b in (("—", " - "), ("–", "-"), ("[‘’]", "''"), ("[“”]", '"'), ("…", "..."), ("[ \\t]{2,}", " ")):
    _EDIT = f"regexp_replace({_EDIT}, '{_a}', '{_b}', 'g')"
# RE2 has no lookaround: the letters beside the match are captured and given back; twice, as matches may share one
for _a, _b in R.CONTRACTIONS:
    for _ in range(2):
        _EDIT = f"regexp_replace({_EDIT}, '(^|[^{U.word_chars()}]){_a}($|[^{U.word_chars()}])', '\\1{_b.replace(chr(39), chr(39) * 2)}\\2', 'g')"
_LETTERS = "array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z]') THEN reverse(t) ELSE t END), '')"
_STRIP = f"regexp_replace(regexp_replace(x, '^[{U.PY_SPACE}]+', ''), '[{U.PY_SPACE}]+$', '')"
_SENT = f"list_filter(list_transform(regexp_extract_all(text, '(?s:.*?[.!?]+(?:[\"'')\\]]+)?(?:\\s+|\\z)|.+\\z)'), lambda x: {_STRIP}), lambda x: x <> '')"
_SENT_REV = f"coalesce(array_to_string(list_reverse({_SENT}), ' '), '')"
_TOK = f"list_filter(regexp_split_to_array(text, '[{U.PY_SPACE}]+'), lambda x: x <> '')"
_MAP = "MAP {" + ", ".join(f"'{w}': '{en[-1]}'" for en in R.LEXICON.values() for w in en) + "}"
_CASED = "CASE WHEN upper(t) = t AND lower(t) <> t THEN upper(m) WHEN upper(t[1]) = t[1] AND lower(t[1]) <> t[1] THEN upper(m[1])||substr(m, 2) ELSE m END"
_TRIP = f"array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), lambda t: coalesce({_CASED.replace('(m)', '(lex[lower(t)])').replace('m[1]', 'lex[lower(t)][1]').replace('(m,', '(lex[lower(t)],').replace('ELSE m', 'ELSE lex[lower(t)]')}, t)), '')"
_BUCKET = "[" + ", ".join(f"{{'n': len(regexp_extract_all(text, '[{c}]')), 'p': -length(regexp_extract(text, '(?s)^[^{c}]*')), 'name': '{n}'}}" for n, c in R.BUCKETS) + "]"
_FN = "[" + ", ".join(f"{{'n': len(list_intersect(ws, {fn})), 'i': {-i}, 'lang': '{lang}'}}" for i, (lang, fn) in enumerate(R.FUNCTION_WORDS.items())) + "]"
_LANG = f"""SELECT doc_id, lang, CASE WHEN top IS NULL THEN 'und' WHEN top.name = 'kana' OR (top.name = 'han' AND kana > 0) THEN 'ja' WHEN top.name = 'han' THEN 'zh'
 {' '.join(f"WHEN top.name = '{b}' THEN '{x}'" for b, x in R.BUCKET_LANGUAGE.items())} WHEN best.n > 0 THEN best.lang ELSE 'en' END AS detected FROM (
 SELECT doc_id, lang, kana, list_max(list_filter(b, lambda x: x.n > 0)) AS top, list_max({_FN}) AS best FROM (
 SELECT doc_id, lang, {_BUCKET} AS b, len(regexp_extract_all(text, '[\\x{{3040}}-\\x{{30FF}}]')) AS kana, list_distinct(list_transform({_TOK}, lambda w: lower(w))) AS ws FROM documents))"""
_GRAM = "CASE WHEN len({x}) < 3 THEN [array_to_string({x}, '')] ELSE list_transform(range(1, len({x}) - 1), lambda i: {x}[i]||{x}[i+1]||{x}[i+2]) END"
_WGRAM = "list_concat({w}, list_transform(range(1, greatest(len({w}), 1)), lambda i: {w}[i]||' '||{w}[i+1]))"


def _gate_sql(after: str, extra: str = "") -> str:
    split = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
    return f"""WITH lexicon AS (SELECT {_MAP} AS lex), p AS (SELECT doc_id, lang, text AS a, {after} AS b FROM documents, lexicon),
 w AS (SELECT *, {split('a')} AS wa, {split('b')} AS wb, string_split(lower(a), '') AS ca, string_split(lower(b), '') AS cb FROM p),
 g AS (SELECT doc_id, 'c' AS m, 1 AS s, unnest({_GRAM.format(x='ca')}) AS g FROM w UNION ALL SELECT doc_id, 'c', 2, unnest({_GRAM.format(x='cb')}) FROM w
  UNION ALL SELECT doc_id, 'w', 1, unnest({_WGRAM.format(w='wa')}) FROM w UNION ALL SELECT doc_id, 'w', 2, unnest({_WGRAM.format(w='wb')}) FROM w),
 n AS (SELECT doc_id, m, g, count(*) FILTER (s = 1) AS na, count(*) FILTER (s = 2) AS nb FROM g GROUP BY ALL),
 c AS (SELECT doc_id, m, CAST(sum(na * nb) AS DOUBLE) / sqrt(CAST(sum(na * na) AS DOUBLE) * CAST(sum(nb * nb) AS DOUBLE)) AS v FROM n GROUP BY doc_id, m)
 SELECT d.doc_id, round(coalesce(max(v), 0), 6) AS score, coalesce(max(v), 0) >= max(CASE lang WHEN 'en' THEN 0.6 ELSE 0.45 END) AS accepted FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id"""


QUERIES = {
    "token_edits": _over(R.token_edits),
    "reorder_reverse": _over(R.reorder_reverse),
    "reverse_words": _over(R.reverse_words),
    "roundtrip_translate": _over(R.roundtrip_translate),
    "roundtrip_tokens": roundtrip_tokens,
    "prose_tokens": _over(lambda t: F.array_join(T.prose_tokens(t), " ")),
    "whitespace_tokens": _over(lambda t: F.array_join(T.whitespace_tokens(t), " ")),
    "canonicalize_c": _over(R.canonicalize_c, "pages", "page_id", "html"),
    "detect_language": detect_language,
    "language_confusion": language_confusion,
    "rewrite_gate": rewrite_gate,
    "roundtrip_gate": roundtrip_gate,
    "rewrite_ladder": rewrite_ladder,
    "gateway_audit": gateway_audit,
    "code_forms_python": code_forms,
}
SQL = {
    "token_edits": _sql(_EDIT),
    "reorder_reverse": _sql(_SENT_REV),
    "reverse_words": _sql(_LETTERS),
    "roundtrip_translate": f"SELECT doc_id, CAST(length(o) AS BIGINT) AS n_chars, sha256(o) AS out_sha256 FROM (SELECT doc_id, {_TRIP} AS o FROM documents, (SELECT {_MAP} AS lex))",
    "roundtrip_tokens": f"SELECT conv_id, turn, sha256(coalesce(array_to_string(list_transform({_TOK}, lambda t: coalesce(lex[lower(t)], lower(t))), ' '), '')) AS out_sha256 FROM conversations, (SELECT {_MAP} AS lex)",
    "prose_tokens": _sql("coalesce(array_to_string(regexp_extract_all(lower(text), '[a-z0-9'']+'), ' '), '')"),
    "whitespace_tokens": _sql(f"coalesce(array_to_string({_TOK}, ' '), '')"),
    "detect_language": f"SELECT doc_id, detected FROM ({_LANG})",
    "language_confusion": f"SELECT lang, detected, count(*) AS n FROM ({_LANG}) GROUP BY ALL",
    "rewrite_gate": _gate_sql(_EDIT),
    "rewrite_ladder": f"WITH q AS ({_gate_sql(_EDIT)}) SELECT doc_id, sha256(CASE WHEN accepted THEN {_EDIT} ELSE text END) AS out_sha256, accepted, CASE WHEN accepted THEN 'accepted' ELSE 'meaning changed too much; normalised text returned' END AS message FROM documents JOIN q USING (doc_id)",
    "roundtrip_gate": _gate_sql(_TRIP),
}
