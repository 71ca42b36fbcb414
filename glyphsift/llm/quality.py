"""Quality rules with host-level verdicts (operator 3).  DataFrame functions only.

Method: each document is measured in its row.  Rule failures are summed by
source (its host or domain), and each source's failure rate is shrunk towards
the corpus with a beta prior whose two parameters are fitted to the sources'
own rates (method of moments): a source of few documents stays near the corpus'
rate.  A source whose shrunk rate is above ``host_limit`` is distrusted, and the
verdict is joined back: in a distrusted source a document has to pass the
stricter rules as well, so its clean documents stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsift.sources.tables import table

from .common import stored, words

WINDOW = 8


def repeated_words(hashes: Column, n: int = WINDOW) -> Column:
    """The windows of ``n`` word hashes: ``array<long>``, empty for fewer words."""
    at = F.when(F.size(hashes) >= n, F.sequence(F.lit(1), F.size(hashes) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(hashes, i, n)))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, source`` and the counts of each row's text."""
    base = docs.select("doc_id", F.col("source").alias("__source"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    a = base.select(
        "doc_id",
        "__source",
        words(F.col("__text")).alias("__w"),
        F.length(F.regexp_replace("__text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("__text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("__lines"),
    )
    b = a.select(
        "doc_id",
        "__source",
        "n_symbols",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"),
    )
    c = b.withColumn("__win", repeated_words(F.col("__h"))).drop("__h")
    # most texts repeat no window: only the others are sorted
    pairs = F.when(F.size(F.array_distinct("__win")) < F.size("__win"), F.array_sort(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = c.withColumn("__s", pairs).drop("__win")
    twice = F.filter("__s", lambda x, j: (F.get("__s", j - 1)["h"] == x["h"]) | (F.get("__s", j + 1)["h"] == x["h"]))
    e = d.withColumn("__at", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("__s")
    # a start covers up to the next one, 8 words at most; least() passes over the null after the last
    covered = F.aggregate(F.zip_with(F.slice("__at", 2, F.greatest(F.size("__at"), F.lit(1))), F.col("__at"), lambda nxt, x: F.least(nxt - x, F.lit(WINDOW))), F.lit(0).cast("long"), lambda s, x: s + x)
    return e.withColumn("n_repeat_words", F.when(F.size("__at") > 0, covered).otherwise(F.lit(0).cast("long"))).drop("__at")


def host_rates(base: DataFrame) -> DataFrame:
    """``__source, __rate``: each source's failure rate under the fitted beta prior."""
    hosts = base.groupBy("__source").agg(F.count("*").alias("__n"), F.sum(F.col("__fails").cast("long")).alias("__k"))
    rate = F.col("__k") / F.col("__n")
    whole = hosts.agg(F.sum("__n").alias("n"), F.sum("__k").alias("k"), F.count("*").alias("m"), F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"), F.avg(1 / F.col("__n")).alias("inv")).first()
    if not whole["n"]:
        return hosts.withColumn("__rate", F.lit(0.0))
    # corpus rate; the variance between sources beyond what counting alone makes
    p = min(max(whole["k"] / whole["n"], 1e-6), 1 - 1e-6)
    between = max((whole["var"] or 0.0) - p * (1 - p) * whole["inv"], 1e-6)
    strength = min(max(p * (1 - p) / between - 1, 1.0), 1e6)
    return hosts.withColumn("__rate", (F.col("__k") + p * strength) / (F.col("__n") + strength))


def judge(docs: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """Counts, ``base_failed`` and ``kept``, one row per input row; more columns: ``host_rate``, ``host_failed``.

    Null text has no words and fails the base rule; a null source is a source
    of its own; repeated rows count as often as they stand; an empty table
    gives no rows.  Windows are compared by 64-bit hashes.
    """
    base = measured(docs)
    few = F.col("n_words") < 20
    failed = few | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    strict = failed | (10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > 3 * F.col("__n_lines")) | (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))
    base = stored(base.withColumns({"base_failed": failed, "__fails": strict}), "quality")
    rates = stored(host_rates(base), "host-rates")
    bad = F.coalesce(F.col("__rate"), F.lit(0.0)) > host_limit
    return base.join(rates.select(F.col("__source").alias("__host"), "__rate"), F.col("__source").eqNullSafe(F.col("__host")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~(bad & F.col("__fails"))).alias("kept"), F.col("__rate").alias("host_rate"), bad.alias("host_failed")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win), range(8) r(j) WHERE c > 1 GROUP BY doc_id),
ln AS (SELECT *, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM ln LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS fails FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(fails::INT)::DOUBLE AS k FROM f GROUP BY source),
a AS (SELECT greatest(1e-6, least(sum(k) / sum(n), 1 - 1e-6)) AS p, coalesce(var_samp(k / n), 0) AS v, avg(1 / n) AS inv FROM h),
s AS (SELECT p, least(greatest(p * (1 - p) / greatest(v - p * (1 - p) * inv, 1e-6) - 1, 1), 1e6) AS s FROM a),
r AS (SELECT source, (k + p * s) / (n + s) > 0.5 AS bad FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (bad AND fails) AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""
