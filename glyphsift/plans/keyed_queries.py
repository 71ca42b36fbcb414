"""Keyed tests over the tokens of documents, with a demo key of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsift.functions import unicode_tables as U
from glyphsift.functions.text import whitespace_tokens
from glyphsift.operators import keyed as K
from glyphsift.sources.tables import table

KEY = "demo"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", whitespace_tokens(F.col("text")).alias("tokens"))


def green_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.GreenList(KEY).detect(_docs(spark, sf_dir))
    return out.select("doc_id", F.col("green").cast("long").alias("green"), F.col("scored").cast("long").alias("scored"), F.round("z", 6).alias("z"), "alarm")


def green_list_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored over words that begin with t only; others are context."""
    c = _docs(spark, sf_dir).select("doc_id", K.GreenList(KEY).count(F.col("tokens"), lambda t: F.startswith(t, F.lit("t"))).alias("c"))
    return c.select("doc_id", F.col("c.green").cast("long").alias("green"), F.col("c.scored").cast("long").alias("scored"))


def tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = K.Tournament(KEY)
    out = _docs(spark, sf_dir).withColumn("total", t.total(F.col("tokens"))).withColumn("n", F.size("tokens").cast("long"))
    mean = F.col("total") / K.FULL / F.greatest("n", F.lit(1))
    return out.select("doc_id", "n", "total", F.when(F.col("n") > 0, F.round((mean - 0.5) / F.sqrt(F.lit(1 / 12) / F.greatest("n", F.lit(1))), 6)).otherwise(0.0).alias("z"))


def _scheme(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = _docs(spark, sf_dir).select("doc_id", K.ContextScheme(kind, KEY).count(F.col("tokens")).alias("c"))
        return c.select("doc_id", F.col("c.green").cast("long").alias("green"), F.col("c.scored").cast("long").alias("scored"))

    return run


def multi_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message bits estimated over all documents of a source."""
    docs = table(spark, sf_dir, "documents").select("source", whitespace_tokens(F.col("text")).alias("tokens"))
    out = K.MultiBit(KEY).estimate(K.positions(docs, F.col("tokens"), "source"), "source")
    return out.select("source", F.col("bit").cast("long").alias("bit"), "green0", "green1", F.col("value").cast("long").alias("value"))


_TOK = f"list_filter(regexp_split_to_array(text, '[{U.PY_SPACE}]+'), lambda x: x <> '')"
_T = f"""t AS (SELECT doc_id, source, tok, pos, coalesce(lag(tok) OVER w, '<s>') AS prev, lag(tok, 2) OVER w AS p2, lag(tok, 3) OVER w AS p3 FROM (
 SELECT doc_id, source, unnest(ts) AS tok, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT doc_id, source, {_TOK} AS ts FROM documents)) WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""


def _h(*parts: str) -> str:
    return "('0x'||substr(sha256(" + "||'|'||".join(parts) + "),1,8))::UBIGINT::BIGINT"


def _green(cond: str, where: str = "true") -> str:
    return f"WITH {_T} SELECT d.doc_id, CAST(coalesce(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) FILTER ({where}), 0) AS BIGINT) AS green, CAST(count(tok) FILTER ({where}) AS BIGINT) AS scored FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id"


_LIMIT = "0.25 * 4294967296"
_PREV = f"{_h(f"'{KEY}'", 'prev', 'tok')} < {_LIMIT}"
_WINDOW = f"{_h(f"'{KEY}'", "CASE WHEN pos = 0 THEN '<s>' ELSE array_to_string(list_sort(list_filter([prev, p2, p3], lambda x: x IS NOT NULL AND NOT (pos = 0))), '+') END", 'tok')} < {_LIMIT}"
_MINH = f"least({_h(f"'{KEY}'", 'tok')}, CASE WHEN pos > 0 THEN {_h(f"'{KEY}'", 'prev')} ELSE 4294967296 END, coalesce({_h(f"'{KEY}'", 'p2')}, 4294967296), coalesce({_h(f"'{KEY}'", 'p3')}, 4294967296))"
_SELF = f"{_h(f"'{KEY}'", f'CAST({_MINH} AS VARCHAR)', 'tok')} < {_LIMIT}"
_Z = "CASE WHEN scored > 0 THEN (green - 0.25 * scored) / sqrt(scored * 0.25 * 0.75) ELSE 0 END"

QUERIES = {
    "keyed_green_list": green_list,
    "keyed_green_list_vocab": green_list_vocab,
    "keyed_tournament": tournament,
    "keyed_context_unigram": _scheme("unigram"),
    "keyed_context_prev": _scheme("prev"),
    "keyed_context_window": _scheme("window"),
    "keyed_context_selfhash": _scheme("selfhash"),
    "keyed_multi_bit": multi_bit,
}
SQL = {
    "keyed_green_list": f"SELECT doc_id, green, scored, round(({_Z})::DOUBLE, 6) AS z, {_Z} >= 4.0 AS alarm FROM ({_green(_PREV)})",
    "keyed_green_list_vocab": _green(_PREV, "starts_with(tok, 't')"),
    "keyed_tournament": f"WITH {_T}, s AS (SELECT doc_id, count(*) AS n, CAST(sum({_h(f"'{KEY}'", 'prev', 'tok')}) AS BIGINT) AS total FROM t GROUP BY doc_id) SELECT doc_id, coalesce(n, 0) AS n, coalesce(total, 0) AS total, CASE WHEN n > 0 THEN round((total::DOUBLE / 4294967296.0::DOUBLE / n - 0.5::DOUBLE) / sqrt((1.0::DOUBLE / 12) / n), 6) ELSE 0.0 END AS z FROM documents LEFT JOIN s USING (doc_id)",
    "keyed_context_unigram": _green(f"{_h(f"'{KEY}'", "''", 'tok')} < {_LIMIT}"),
    "keyed_context_prev": _green(_PREV),
    "keyed_context_window": _green(_WINDOW),
    "keyed_context_selfhash": _green(_SELF),
    "keyed_multi_bit": f"WITH {_T}, g AS (SELECT source, pos % 16 AS bit, {_h(f"'{KEY}'", 'CAST(pos % 16 AS VARCHAR)', "'0'", 'prev', 'tok')} < {_LIMIT} AS a, {_h(f"'{KEY}'", 'CAST(pos % 16 AS VARCHAR)', "'1'", 'prev', 'tok')} < {_LIMIT} AS b FROM t) SELECT source, CAST(bit AS BIGINT) AS bit, CAST(sum(a::INT) AS BIGINT) AS green0, CAST(sum(b::INT) AS BIGINT) AS green1, CAST(sum(b::INT) > sum(a::INT) AS BIGINT) AS value FROM g GROUP BY source, bit",
}
