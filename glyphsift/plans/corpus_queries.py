"""Corpus statistics, similarity and calibration over the tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphsift.functions.text import prose_tokens
from glyphsift.operators import calibration as C
from glyphsift.operators import keyless as U
from glyphsift.operators import partition as P
from glyphsift.operators import similarity as S
from glyphsift.operators.rewrite import reorder_reverse
from glyphsift.plans.rewrite_queries import _GRAM, _SENT_REV, _WGRAM
from glyphsift.sources.shared import stored
from glyphsift.sources.tables import table

SLOTS, K, PERMUTATIONS = 40, 4, 300


def _tokens(spark: SparkSession, sf_dir: str, arm: str = "lang") -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col(arm).alias("arm"), "doc_id", F.posexplode(prose_tokens(F.col("text"))).alias("pos", "tok"))


def compare_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.compare_arms(_tokens(spark, sf_dir), "fr", "en")
    return out.select(F.round("l1", 6).alias("l1"), F.round("baseline", 6).alias("baseline"), F.round("ratio", 6).alias("ratio"), "flagged")


def corpus_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.corpus_test(_tokens(spark, sf_dir, "source"), "src1", "src2")
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("green_tokens", "cand_green", "cand_n", "ref_green", "ref_n")], F.round("z", 6).alias("z"))


def _bigrams(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    """``columns..., ctx, tok``, taken within each text."""
    docs = table(spark, sf_dir, "documents").select(*columns, F.explode(U.bigrams_in(prose_tokens(F.col("text")))).alias("__b"))
    return docs.select("*", "__b.ctx", "__b.tok").drop("__b")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(U.pair_counts(_bigrams(spark, sf_dir)), "pairs")  # read more than once


def green_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.green_by_context(_pairs(spark, sf_dir))


def green_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _pairs(spark, sf_dir)
    out = U.green_fraction(b, stored(U.green_by_context(b), "green"))
    return out.select(F.col("green").cast("long").alias("green"), F.col("scored").cast("long").alias("scored"), F.round("z", 6).alias("z"))


def prose_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-token bias of all documents, with the operator's 200 permutations."""
    out = U.prose_gap(_bigrams(spark, sf_dir, U.half("prose", F.col("doc_id")).alias("test")))
    return out.select("n_contexts", *[F.round(c, 6).alias(c) for c in ("z", "null_mean", "gap", "p")])


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A choice matrix: a text's tokens are dealt to the slots in turn; a slot's variant is the sum of their k-way hashes."""
    t = _tokens(spark, sf_dir)
    each = t.groupBy(F.col("doc_id").alias("sample_id"), F.pmod("pos", F.lit(SLOTS)).cast("int").alias("slot")).agg(F.sum(F.pmod(U.draw("v", F.col("tok")), F.lit(K))).alias("__v"))
    return each.select("sample_id", "slot", F.pmod("__v", F.lit(K)).cast("int").alias("variant"))


def estimate_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.estimate_partition(choices(spark, sf_dir), K).select(F.col("slot").cast("long").alias("slot"), F.col("variant").cast("long").alias("variant"))


def partition_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stored(choices(spark, sf_dir), "choices")  # read more than once
    out = P.aggregate_z(c, P.estimate_partition(c, K), K, SLOTS)
    # without a green cell hits have no variance: no number, as in the SQL, where the operator has 0
    z = F.when((F.col("gamma") > 0) & (F.col("n") > 0), F.round("z", 6)).otherwise(F.lit(float("nan")))
    return out.select(F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), "n", F.round("gamma", 6).alias("gamma"), z.alias("z"))


def steal_and_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.steal_and_test(choices(spark, sf_dir), K, SLOTS, permutations=PERMUTATIONS)
    return out.select(F.round("z", 6).alias("z"), F.round("null_mean", 6).alias("null_mean"), F.round("p", 6).alias("p"), F.round("gap", 6).alias("gap"), "detected")


def _summary(gaps: DataFrame) -> DataFrame:
    return P.style_baseline(gaps).select(F.col("n").cast("long").alias("n"), *[F.round(c, 6).alias(c) for c in ("mean", "stdev", "p50", "p90", "p95", "max")])


def _by_source(spark: SparkSession, sf_dir: str, chosen: DataFrame) -> DataFrame:
    return chosen.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "source"), "sample_id")


def bootstrap_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style baseline: bootstrap gaps of each source's texts (120 draws, 60 permutations), pooled."""
    return _summary(P.bootstrap_gaps(_by_source(spark, sf_dir, choices(spark, sf_dir)), K, SLOTS, source=None))


def calibrated_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as a candidate against the pooled baseline of the sources."""
    chosen = stored(choices(spark, sf_dir), "choices")  # read four times
    gap = P.steal_and_test(chosen, K, SLOTS, permutations=100).select(F.col("gap").alias("__c"))
    base = P.bootstrap_gaps(_by_source(spark, sf_dir, chosen), K, SLOTS, source=None).crossJoin(gap)  # one row
    out = base.agg(F.first("__c").alias("gap"), ((F.sum((F.col("gap") >= F.col("__c")).cast("int")) + 1) / (F.count("*") + 1)).alias("fpr"))
    return out.select(F.round("gap", 6).alias("gap"), F.round("fpr", 6).alias("fpr"), (F.col("fpr") <= 0.05).alias("exceeds"))


def prose_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style baseline of prose: bootstrap gaps of each source (80 draws, 40 permutations), pooled."""
    return _summary(U.prose_bootstrap(table(spark, sf_dir, "documents").select("source", "doc_id", prose_tokens(F.col("text")).alias("tokens"))))


def active_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as a queried model, user turns as its control."""
    t = table(spark, sf_dir, "conversations").select(F.col("role").alias("arm"), F.col("conv_id").alias("doc_id"), F.explode(prose_tokens(F.col("text"))).alias("tok"))
    return C.active_presence(t, "assistant", "user").select(F.round("l1", 6).alias("l1"), F.round("baseline", 6).alias("baseline"), F.round("ratio", 6).alias("ratio"), "present")


def context_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-way choices of users in contexts, by event type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("pair"), F.pmod("user_id", F.lit(12)).cast("string").alias("context"), F.when(F.pmod("event_id", F.lit(7)) < 3, "a").when(F.pmod("event_id", F.lit(7)) < 6, "b").alias("choice"))
    out = U.context_signature(e)
    return out.select("pair", *[F.round(c, 6).alias(c) for c in ("concentration", "balance", "score")])


def residual_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference between the turns of a conversation, by role."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "role", F.col("turn").alias("sample_id"), F.explode(prose_tokens(F.col("text"))).alias("tok"))
    return U.residual_variability(t, ["conv_id", "role"]).select("conv_id", "role", F.round("variability", 6).alias("variability"))


def suite_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variability of the assistant's turns against the user's, for each conversation."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("task"), F.col("role").alias("arm"), F.col("turn").alias("sample_id"), F.explode(prose_tokens(F.col("text"))).alias("tok"))
    return U.suite_probe(t, "assistant", "user").select("task", F.round("candidate", 6).alias("candidate"), F.round("control", 6).alias("control"), F.round("excess", 6).alias("excess"), "flagged")


def dense_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the first of its label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ref = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("__r"))
    return e.join(ref, "label").select("vec_id", F.round(S.dense_cosine(F.col("embedding"), F.col("__r")), 5).alias("cosine"))


def separation_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a text's length separates the labelled qualities."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return S.separation_auc(rows.select(F.when(F.col("quality") == 1, "preserved").otherwise("changed").alias("label"), F.col("n_chars").cast("double").alias("score"))).select(F.round("auc", 6).alias("auc"))


def _labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_id, lang, label, before, after``: each labelled text with its sentences reversed, and with the next one of its language."""
    rated = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    docs = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang", "text").join(rated, "doc_id")
    kept = docs.select((2 * F.col("doc_id")).alias("pair_id"), "lang", F.lit("preserved").alias("label"), F.col("text").alias("before"), reorder_reverse(F.col("text")).alias("after"))
    # who comes next is told by ids alone, so no task holds the texts of a language
    ids = docs.select("lang", "doc_id").withColumn("__next", F.lead("doc_id").over(Window.partitionBy("lang").orderBy("doc_id"))).where("__next is not null")
    other = docs.join(ids.select("doc_id", "__next"), "doc_id").join(docs.select(F.col("doc_id").alias("__next"), F.col("text").alias("after")), "__next")
    return kept.unionByName(other.select((2 * F.col("doc_id") + 1).alias("pair_id"), "lang", F.lit("changed").alias("label"), F.col("text").alias("before"), "after"))


def language_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold of each language by which at most 5 % of changed pairs pass, and what it lets through."""
    scored = _labelled_pairs(spark, sf_dir).select("lang", "label", S.score(F.col("before"), F.col("after")).alias("score"))
    out = S.language_thresholds(stored(scored, "pair-scores"), 0.05)  # read more than once
    return out.select("lang", *[F.round(c, 5).alias(c) for c in ("threshold", "true_accept", "false_accept")], "n_preserved", "n_changed")


def reorder_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reversing the sentences leaves of a text's meaning, by the gate at 0.5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("before"), reorder_reverse(F.col("text")).alias("after"))
    return S.fidelity(docs, "doc_id").select("doc_id", F.round("score", 6).alias("score"), "accepted")


_TOKS = "SELECT {arm} AS arm, doc_id, unnest(ts) AS tok, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9'']+') AS ts FROM documents)"


def _draw(*parts: str) -> str:
    return "('0x'||substr(sha256(" + "||'|'||".join(parts) + "),1,8))::UBIGINT::BIGINT"


def _l1(a: str, b: str) -> str:
    return f"(SELECT sum(abs(coalesce(x.p, 0) - coalesce(y.p, 0))) FROM (SELECT tok, p FROM {a}) x FULL OUTER JOIN (SELECT tok, p FROM {b}) y USING (tok))"


_SHARE = "SELECT tok, count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE AS p FROM t WHERE {w} GROUP BY tok"
_HALF = f"{_draw("'{seed}'", "'half'", 'CAST(doc_id AS VARCHAR)')} % 2"
_BI = f"t AS ({_TOKS.format(arm='lang')}), b AS (SELECT * FROM (SELECT doc_id, lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS ctx, tok FROM t) WHERE ctx IS NOT NULL)"
_GREEN = """p AS (SELECT ctx, tok, count(*) AS n FROM b GROUP BY ALL), g AS (SELECT ctx, tok FROM (SELECT ctx, tok, n, sum(n) OVER (PARTITION BY ctx) AS cn, sum(n) OVER (PARTITION BY tok) AS tn, sum(n) OVER () AS al FROM p)
 WHERE cn >= 4 AND n >= 3 AND n::DOUBLE / cn::DOUBLE > 1.5::DOUBLE * tn::DOUBLE / al::DOUBLE)"""
_CH = f"t AS ({_TOKS.format(arm='lang')}), c AS (SELECT doc_id AS sample_id, pos % {SLOTS} AS slot, CAST(sum({_draw("'v'", 'tok')} % {K}) AS BIGINT) % {K} AS variant FROM t GROUP BY ALL)"
_EST = "SELECT slot, variant FROM (SELECT slot, variant, count(*) AS n, sum(count(*)) OVER (PARTITION BY slot) AS s FROM {c} GROUP BY slot, variant) WHERE n::DOUBLE / s::DOUBLE > 1.15::DOUBLE / 4"
_PAIRS = """tk AS (SELECT conv_id, role, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS tok FROM conversations), n AS (SELECT conv_id, role, turn, tok, count(*) AS n FROM tk GROUP BY ALL), z AS (SELECT conv_id, role, turn, sum(n) AS size FROM n GROUP BY ALL),
 pr AS (SELECT a.conv_id, a.role, a.turn AS x, b.turn AS y, a.size + b.size AS size FROM z a JOIN z b ON a.conv_id = b.conv_id AND a.role = b.role AND a.turn < b.turn),
 m AS (SELECT pr.conv_id, pr.role, x, y, pr.size, coalesce((SELECT sum(least(p.n, q.n)) FROM n p JOIN n q ON p.tok = q.tok WHERE p.conv_id = pr.conv_id AND q.conv_id = pr.conv_id AND p.role = pr.role AND q.role = pr.role AND p.turn = x AND q.turn = y), 0) AS common FROM pr),
 v AS (SELECT conv_id, role, avg((size - 2 * common)::DOUBLE / size::DOUBLE) AS variability FROM m GROUP BY ALL)"""
_SIG = "x AS (SELECT event_type AS pair, CAST(user_id % 12 AS VARCHAR) AS context, event_id % 7 AS r FROM events), c AS (SELECT pair, context, sum(CASE WHEN r < 3 THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN r < 6 THEN 1 ELSE 0 END)::DOUBLE AS p FROM x GROUP BY ALL HAVING sum(CASE WHEN r < 6 THEN 1 ELSE 0 END) > 0), q AS (SELECT pair, avg(2 * abs(p - 0.5::DOUBLE)) AS c, avg(CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS m FROM c GROUP BY pair), s AS (SELECT pair, c AS concentration, 4 * m * (1 - m) AS balance, c * 4 * m * (1 - m) AS score FROM q)"

def _poisson(*parts: str) -> str:
    """Poisson (1/2) by hash: thresholds of the distribution function on 32 bits."""
    below, term = [], math.exp(-0.5)
    for k in range(10):
        below.append((below[-1] if below else 0.0) + term)
        term *= 0.5 / (k + 1)
    return f"len(list_filter([{', '.join(str(math.ceil(c * 4294967296.0)) for c in below)}], lambda c: {_draw(*parts)} >= c))"


def _gaps(permutations: int, seed: str) -> str:
    """CTEs from cnt(g, ctx, tok, s, t) to gp(g, nc, z, m, gap, p)."""
    z = lambda h: f"CASE WHEN n > 0 THEN ({h} - gm * n) / sqrt(greatest(n, 1) * gm * (1 - gm)) ELSE 0 END"
    return f"""w0 AS (SELECT g, sum(s) AS al, sum(t) AS te FROM cnt GROUP BY g), pr AS (SELECT g, ctx, tok, s, CASE WHEN te = 0 THEN s ELSE t END AS t FROM cnt JOIN w0 USING (g)),
 st AS (SELECT *, sum(s) OVER (PARTITION BY g, ctx) AS cn, sum(s) OVER (PARTITION BY g, tok) AS tn, sum(s) OVER (PARTITION BY g) AS al FROM pr WHERE s > 0),
 gr AS (SELECT g, ctx, tok, s, t FROM st WHERE cn >= 4 AND s >= 3 AND s::DOUBLE / cn::DOUBLE > 1.5::DOUBLE * tn::DOUBLE / al::DOUBLE), ky AS (SELECT DISTINCT g, ctx FROM gr), ow AS (SELECT pr.* FROM pr SEMI JOIN ky USING (g, ctx)),
 sc AS (SELECT g, sum(s) AS ss, sum(t)::DOUBLE AS n FROM ow GROUP BY g), re AS (SELECT g, sum(s) AS hs, sum(t) AS h, count(DISTINCT ctx) AS nc FROM gr GROUP BY g),
 rk AS (SELECT g, p, ctx, row_number() OVER (PARTITION BY g, p ORDER BY ctx) AS a, row_number() OVER (PARTITION BY g, p ORDER BY {_draw(f"'{seed}'", 'CAST(p AS VARCHAR)', 'ctx')}, ctx) AS b FROM ky, range({permutations}) r(p)),
 dl AS (SELECT x.g, x.p, x.ctx AS i, y.ctx AS j FROM rk x JOIN rk y ON x.g = y.g AND x.p = y.p AND x.b = y.a),
 nu AS (SELECT d.g, d.p, sum(o.t) AS nh FROM gr JOIN dl d ON gr.g = d.g AND gr.ctx = d.i JOIN ow o ON o.g = d.g AND o.ctx = d.j AND o.tok = gr.tok GROUP BY ALL),
 ob AS (SELECT g, nc, h::DOUBLE AS h, n, least(0.5::DOUBLE, greatest(0.01::DOUBLE, coalesce(hs::DOUBLE / nullif(ss, 0)::DOUBLE, 0.1::DOUBLE))) AS gm FROM re JOIN sc USING (g)),
 zz AS (SELECT o.g, nc, {z('h')} AS z, {z('coalesce(nh, 0)::DOUBLE')} AS nz FROM (SELECT * FROM ob, range({permutations}) r(p)) o LEFT JOIN nu ON nu.g = o.g AND nu.p = o.p),
 gp0 AS (SELECT g, any_value(nc) AS nc, any_value(z) AS z, avg(nz) AS m, (count(*) FILTER (nz >= z) + 1)::DOUBLE / (count(*) + 1)::DOUBLE AS p FROM zz GROUP BY g),
 gp AS (SELECT g, coalesce(nc, 0) AS nc, CASE WHEN nc >= 2 THEN z ELSE 0 END AS z, CASE WHEN nc >= 2 THEN m ELSE 0 END AS m, CASE WHEN nc >= 2 THEN z - m ELSE 0 END AS gap, CASE WHEN nc >= 2 THEN p ELSE 1 END AS p FROM w0 LEFT JOIN gp0 USING (g))"""


_BASELINE = "SELECT count(*) AS n, " + ", ".join(f"round({v}, 6) AS {c}" for c, v in [("mean", "avg(gap)"), ("stdev", "stddev_pop(gap)"), *[(f"p{int(100 * q)}", f"list_sort(list(gap))[least(count(*) - 1, CAST(floor({q}::DOUBLE * count(*)) AS BIGINT)) + 1]") for q in (0.5, 0.9, 0.95)], ("max", "max(gap)")]) + " FROM "
_BOOT = f"""{_CH}, dr AS (SELECT sample_id, b, {_poisson("'boot0'", "'steal'", 'CAST(sample_id AS VARCHAR)', 'CAST(b AS VARCHAR)')} AS ws, {_poisson("'boot0'", "'test'", 'CAST(sample_id AS VARCHAR)', 'CAST(b AS VARCHAR)')} AS wt FROM (SELECT DISTINCT sample_id FROM c), range(120) r(b)),
 cs AS (SELECT c.*, source FROM c JOIN documents d ON d.doc_id = c.sample_id), ce AS (SELECT source, b, slot, variant, CAST(sum(ws) AS BIGINT) AS s, CAST(sum(wt) AS BIGINT) AS t FROM cs JOIN dr USING (sample_id) WHERE ws + wt > 0 GROUP BY ALL),
 cg AS (SELECT *, coalesce(s::DOUBLE / nullif(sum(s) OVER (PARTITION BY source, b, slot), 0)::DOUBLE > 1.15::DOUBLE / {K}, false) AS green FROM ce),
 oe AS (SELECT source, b, count(*) FILTER (green)::DOUBLE / {K * SLOTS} AS gm, sum(t)::DOUBLE AS n, coalesce(sum(t) FILTER (green), 0)::DOUBLE AS h FROM cg GROUP BY ALL),
 pe AS (SELECT b, p, slot, row_number() OVER (PARTITION BY b, p ORDER BY {_draw("'boot0'", 'CAST(b AS VARCHAR)', 'CAST(p AS VARCHAR)', 'CAST(slot AS VARCHAR)')}, slot) - 1 AS dest FROM range(120) r(b), range(60) q(p), range({SLOTS}) u(slot)),
 nh AS (SELECT g.source, g.b, pe.p, sum(x.t)::DOUBLE AS nh FROM cg g JOIN pe ON pe.b = g.b AND pe.slot = g.slot JOIN cg x ON x.source = g.source AND x.b = g.b AND x.slot = pe.dest AND x.variant = g.variant WHERE g.green GROUP BY ALL),
 bz AS (SELECT o.source, o.b, CASE WHEN gm > 0 AND gm < 1 AND n > 0 THEN (h - gm * n) / sqrt(n * gm * (1 - gm)) ELSE 0 END AS z, CASE WHEN gm > 0 AND gm < 1 AND n > 0 THEN (coalesce(nh, 0) - gm * n) / sqrt(n * gm * (1 - gm)) ELSE 0 END AS nz FROM (SELECT * FROM oe, range(60) q(p)) o LEFT JOIN nh ON nh.source = o.source AND nh.b = o.b AND nh.p = o.p),
 bg AS (SELECT source, b, CASE WHEN k >= 4 THEN coalesce(gap, 0) ELSE 0 END AS gap FROM (SELECT source, b, k FROM (SELECT source, count(DISTINCT sample_id) AS k FROM cs GROUP BY source), range(120) r(b)) LEFT JOIN (SELECT source, b, any_value(z) - avg(nz) AS gap FROM bz GROUP BY ALL) USING (source, b))"""
_SPLIT = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


def _similarity(pairs: str) -> str:
    """CTE sim(id, score) of pairs(id, a, b): the greater of the cosines of character and word grams."""
    return f"""sp AS (SELECT *, {_SPLIT('a')} AS wa, {_SPLIT('b')} AS wb, string_split(lower(a), '') AS ca, string_split(lower(b), '') AS cb FROM {pairs}),
 sg AS (SELECT id, 'c' AS m, 1 AS s, unnest({_GRAM.format(x='ca')}) AS g FROM sp UNION ALL SELECT id, 'c', 2, unnest({_GRAM.format(x='cb')}) FROM sp UNION ALL SELECT id, 'w', 1, unnest({_WGRAM.format(w='wa')}) FROM sp UNION ALL SELECT id, 'w', 2, unnest({_WGRAM.format(w='wb')}) FROM sp),
 sn AS (SELECT id, m, g, count(*) FILTER (s = 1) AS na, count(*) FILTER (s = 2) AS nb FROM sg GROUP BY ALL),
 sim AS (SELECT id, max(coalesce(v, 0)) AS score FROM (SELECT id, m, CAST(sum(na * nb) AS DOUBLE) / sqrt(nullif(CAST(sum(na * na) AS DOUBLE) * CAST(sum(nb * nb) AS DOUBLE), 0)) AS v FROM sn GROUP BY id, m) GROUP BY id)"""


QUERIES = {
    "compare_arms": compare_arms, "corpus_test": corpus_test, "green_by_context": green_by_context, "green_fraction": green_fraction, "prose_gap": prose_gap,
    "estimate_partition": estimate_partition, "partition_z": partition_z, "steal_and_test": steal_and_test, "bootstrap_baseline": bootstrap_baseline, "prose_baseline": prose_baseline, "active_presence": active_presence,
    "context_signature": context_signature, "residual_variability": residual_variability, "suite_probe": suite_probe,
    "dense_cosine": dense_cosine, "separation_auc": separation_auc, "language_thresholds": language_thresholds, "reorder_fidelity": reorder_fidelity, "calibrated_candidate": calibrated_candidate,
}
_PROSE = f"{_BI}, h AS (SELECT *, {_HALF.format(seed='prose')} AS h FROM b), cnt AS (SELECT 0 AS g, ctx, tok, CAST(sum(1 - h) AS BIGINT) AS s, CAST(sum(h) AS BIGINT) AS t FROM h GROUP BY ctx, tok), {_gaps(200, 'prose')}"
_PROSE_BOOT = f"""{_BI}, dr AS (SELECT doc_id, source, r.b AS bt, {_poisson("'boot'", "'steal'", 'CAST(doc_id AS VARCHAR)', 'CAST(r.b AS VARCHAR)')} AS ws, {_poisson("'boot'", "'test'", 'CAST(doc_id AS VARCHAR)', 'CAST(r.b AS VARCHAR)')} AS wt FROM documents, range(80) r(b)),
 bc AS (SELECT doc_id, ctx, tok, count(*) AS n FROM b GROUP BY ALL), cnt AS (SELECT source||'|'||bt AS g, ctx, tok, CAST(sum(n * ws) AS BIGINT) AS s, CAST(sum(n * wt) AS BIGINT) AS t FROM bc JOIN dr USING (doc_id) WHERE ws + wt > 0 GROUP BY ALL), {_gaps(40, 'boot')}"""
SQL = {
    "prose_gap": f"WITH {_PROSE} SELECT nc AS n_contexts, round(z, 6) AS z, round(m, 6) AS null_mean, round(gap, 6) AS gap, round(p, 6) AS p FROM gp",
    "prose_baseline": f"WITH {_PROSE_BOOT} {_BASELINE} gp",
    "bootstrap_baseline": f"WITH {_BOOT} {_BASELINE} bg",
    "reorder_fidelity": f"WITH pp AS (SELECT doc_id AS id, text AS a, {_SENT_REV} AS b FROM documents), {_similarity('pp')} SELECT doc_id, round(coalesce(score, 0), 6) AS score, coalesce(score, 0) >= 0.5 AS accepted FROM documents LEFT JOIN sim ON id = doc_id",
    "language_thresholds": f"""WITH d AS (SELECT doc_id, lang, text, lead(text) OVER (PARTITION BY lang ORDER BY doc_id) AS nxt FROM documents WHERE lang IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels)),
 pp AS (SELECT 2 * doc_id AS id, lang, 'preserved' AS label, text AS a, {_SENT_REV} AS b FROM d UNION ALL SELECT 2 * doc_id + 1, lang, 'changed', text, nxt FROM d WHERE nxt IS NOT NULL), {_similarity('pp')},
 sc AS (SELECT lang, label, coalesce(score, 0) AS score FROM pp LEFT JOIN sim USING (id)), k AS (SELECT lang, list_sort(list(score) FILTER (label = 'changed')) AS c, count(*) FILTER (label = 'preserved') AS np FROM sc GROUP BY lang),
 th AS (SELECT lang, np, len(c) AS nc, CASE WHEN c IS NULL THEN 0 WHEN CAST(floor(0.05::DOUBLE * len(c)) AS BIGINT) = 0 THEN c[len(c)] * (1 + 2.3e-16::DOUBLE) ELSE c[len(c) - CAST(floor(0.05::DOUBLE * len(c)) AS BIGINT) + 1] END AS t FROM k)
 SELECT lang, round(any_value(t), 5) AS threshold, round(coalesce(avg(CASE WHEN score >= t THEN 1.0::DOUBLE ELSE 0 END) FILTER (label = 'preserved'), 0), 5) AS true_accept, round(coalesce(avg(CASE WHEN score >= t THEN 1.0::DOUBLE ELSE 0 END) FILTER (label = 'changed'), 0), 5) AS false_accept, any_value(np) AS n_preserved, coalesce(any_value(nc), 0) AS n_changed FROM sc JOIN th USING (lang) GROUP BY lang""",
    "active_presence": f"WITH t AS (SELECT role AS arm, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS tok, {_draw("'active'", "'half'", 'CAST(conv_id AS VARCHAR)')} % 2 AS h FROM conversations), f AS ({_SHARE.format(w="arm = 'assistant'")}), e AS ({_SHARE.format(w="arm = 'user'")}), e0 AS ({_SHARE.format(w="arm = 'user' AND h = 0")}), e1 AS ({_SHARE.format(w="arm = 'user' AND h = 1")}), r AS (SELECT {_l1('f', 'e')} AS l1, {_l1('e0', 'e1')} AS baseline) SELECT round(l1, 6) AS l1, round(baseline, 6) AS baseline, round(l1 / greatest(baseline, 1e-9), 6) AS ratio, l1 / greatest(baseline, 1e-9) >= 2.0 AS present FROM r",
    "compare_arms": f"WITH t0 AS ({_TOKS.format(arm='lang')}), t AS (SELECT *, {_HALF.format(seed='compare')} AS h FROM t0), f AS ({_SHARE.format(w="arm = 'fr'")}), e AS ({_SHARE.format(w="arm = 'en'")}), e0 AS ({_SHARE.format(w="arm = 'en' AND h = 0")}), e1 AS ({_SHARE.format(w="arm = 'en' AND h = 1")}), r AS (SELECT {_l1('f', 'e')} AS l1, {_l1('e0', 'e1')} AS baseline) SELECT round(l1, 6) AS l1, round(baseline, 6) AS baseline, round(l1 / greatest(baseline, 1e-9), 6) AS ratio, l1 / greatest(baseline, 1e-9) >= 2.0 AS flagged FROM r",
    "corpus_test": f"""WITH t0 AS ({_TOKS.format(arm='source')}), t AS (SELECT *, {_HALF.format(seed='corpus')} AS h FROM t0 WHERE arm IN ('src1', 'src2')),
 c AS (SELECT tok, count(*) AS c FROM t WHERE h = 0 AND arm = 'src1' GROUP BY tok), r AS (SELECT tok, count(*) AS r FROM t WHERE h = 0 AND arm = 'src2' GROUP BY tok),
 g AS (SELECT tok FROM c LEFT JOIN r USING (tok) WHERE c >= 5 AND c::DOUBLE / (SELECT sum(c) FROM c)::DOUBLE / ((coalesce(r, 0) + 0.5::DOUBLE) / ((SELECT sum(r) FROM r)::DOUBLE + 0.5::DOUBLE * (SELECT count(*) FROM r))) >= 1.3::DOUBLE),
 s AS (SELECT (SELECT count(*) FROM g) AS green_tokens, count(*) FILTER (arm = 'src1' AND tok IN (FROM g)) AS cand_green, count(*) FILTER (arm = 'src1') AS cand_n, count(*) FILTER (arm = 'src2' AND tok IN (FROM g)) AS ref_green, count(*) FILTER (arm = 'src2') AS ref_n FROM t WHERE h = 1)
 SELECT *, round((cand_green::DOUBLE / cand_n - ref_green::DOUBLE / ref_n) / sqrt((cand_green + ref_green)::DOUBLE / (cand_n + ref_n) * (1 - (cand_green + ref_green)::DOUBLE / (cand_n + ref_n)) * (1.0::DOUBLE / cand_n + 1.0::DOUBLE / ref_n)), 6) AS z FROM s""",
    "green_by_context": f"WITH {_BI}, {_GREEN} SELECT * FROM g",
    "green_fraction": f"WITH {_BI}, {_GREEN}, s AS (SELECT count(*) FILTER ((ctx, tok) IN (SELECT (ctx, tok) FROM g)) AS green, count(*) AS scored FROM b WHERE ctx IN (SELECT ctx FROM g)) SELECT green, scored, round((green - 0.25::DOUBLE * scored) / sqrt(scored * 0.25::DOUBLE * 0.75::DOUBLE), 6) AS z FROM s",
    "estimate_partition": f"WITH {_CH} {_EST.format(c='c')}",
    "partition_z": f"WITH {_CH}, g AS ({_EST.format(c='c')}), s AS (SELECT count(*) FILTER ((slot, variant) IN (SELECT (slot, variant) FROM g)) AS hits, count(*) AS n, (SELECT count(*) FROM g)::DOUBLE / {SLOTS * K} AS gamma FROM c) SELECT hits, n, round(gamma, 6) AS gamma, round((hits - gamma * n) / sqrt(n * gamma * (1 - gamma)), 6) AS z FROM s",
    "steal_and_test": f"""WITH {_CH}, k AS (SELECT *, {_draw("'partition'", "'split'", 'CAST(sample_id AS VARCHAR)')} >= 2147483648 AS test FROM c), tr AS (SELECT * FROM k WHERE NOT test), g AS ({_EST.format(c='tr')}),
 n AS (SELECT slot, variant, count(*) AS n FROM k WHERE test GROUP BY ALL), o AS (SELECT p, slot, row_number() OVER (PARTITION BY p ORDER BY {_draw("'partition'", 'CAST(p AS VARCHAR)', 'CAST(slot AS VARCHAR)')}, slot) - 1 AS dest FROM range({PERMUTATIONS}) a(p), range({SLOTS}) s(slot)),
 h AS (SELECT p, coalesce(sum(n), 0)::DOUBLE AS h FROM o LEFT JOIN g USING (slot) LEFT JOIN n ON n.slot = o.dest AND n.variant = g.variant GROUP BY p),
 r AS (SELECT (SELECT sum(n) FROM n JOIN g USING (slot, variant))::DOUBLE AS rl, (SELECT sum(n) FROM n)::DOUBLE AS t, (SELECT count(*) FROM g)::DOUBLE / {SLOTS * K} AS gm),
 z AS (SELECT (h - gm * t) / sqrt(t * gm * (1 - gm)) AS zn, (rl - gm * t) / sqrt(t * gm * (1 - gm)) AS z FROM h, r)
 SELECT round(z, 6) AS z, round(avg(zn), 6) AS null_mean, round((count(*) FILTER (zn >= z) + 1)::DOUBLE / (count(*) + 1), 6) AS p, round(z - avg(zn), 6) AS gap, (count(*) FILTER (zn >= z) + 1)::DOUBLE / (count(*) + 1) <= 0.05 AS detected FROM z GROUP BY z""",
    "context_signature": f"WITH {_SIG}, o AS (SELECT * FROM s UNION ALL SELECT NULL, avg(concentration), avg(balance), avg(score) FROM s) SELECT pair, round(concentration, 6) AS concentration, round(balance, 6) AS balance, round(score, 6) AS score FROM o",
    "residual_variability": f"WITH {_PAIRS} SELECT conv_id, role, round(variability, 6) AS variability FROM v",
    "suite_probe": f"WITH {_PAIRS}, w AS (SELECT conv_id AS task, max(variability) FILTER (role = 'assistant') AS a, max(variability) FILTER (role = 'user') AS u FROM v GROUP BY conv_id) SELECT task, round(a, 6) AS candidate, round(u, 6) AS control, round(a - u, 6) AS excess, a - u >= 0.02 AS flagged FROM w",
    "dense_cosine": "WITH f AS (SELECT label, arg_min(embedding, vec_id) AS r FROM embeddings GROUP BY label) SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(r, lambda x: x::DOUBLE)), 5) AS cosine FROM embeddings JOIN f USING (label)",
    "separation_auc": "WITH s AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)) SELECT round(avg(CASE WHEN a.n_chars > b.n_chars THEN 1.0::DOUBLE WHEN a.n_chars = b.n_chars THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS auc FROM s a, s b WHERE a.quality = 1 AND b.quality <> 1",
}
