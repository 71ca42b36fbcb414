"""Synthetic data, transforms of token sequences, arenas and robustness tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsift.functions import unicode_tables as U
from glyphsift.functions.text import let, whitespace_tokens
from glyphsift.operators import generators as G
from glyphsift.operators import keyed, partition, registry
from glyphsift.operators.rewrite import LEXICON
from glyphsift.operators.similarity import SPECS
from glyphsift.plans import robustness as R
from glyphsift.sources import files
from glyphsift.sources.tables import table

KEY, SLOTS, K = "arena", 40, 4


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", whitespace_tokens(F.col("text")).alias("tokens"))


def _joined(value, key: str = "doc_id"):
    """Digest of the tokens after a transform."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _docs(spark, sf_dir).select("doc_id", F.sha2(F.array_join(value(F.col("tokens")), " "), 256).alias("out_sha256"))

    return run


def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.control(spark, 24, 180, 250).select("arm", "seq_id", F.array_join("tokens", " ").alias("tokens"))


def substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.substituted(F.col("tokens"), F.col("doc_id"), 400, 0.2)
    # through a generator, as a filter would go below the projection and run all of it once more
    row = let(out, lambda ts: F.struct(F.size(ts).cast("long").alias("n"), F.sha2(F.array_join(ts, " "), 256).alias("out_sha256")))
    return _docs(spark, sf_dir).select("doc_id", F.explode_outer(F.array(row)).alias("r")).where("r.n > 0").select("doc_id", "r.n", "r.out_sha256")


def overlap_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a text loses of its multiset of tokens without its first half."""
    docs = _docs(spark, sf_dir).select("doc_id", "tokens", F.slice("tokens", F.floor(F.size("tokens") / 2).cast("int") + 1, F.greatest(F.size("tokens"), F.lit(1))).alias("after"))
    return G.overlap_cost(docs, "doc_id", "tokens", "after").select("doc_id", F.round("cost", 6).alias("cost"))


def keyed_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.keyed_partition(spark, KEY, SLOTS, K).select(F.col("slot").cast("long").alias("slot"), F.col("variant").cast("long").alias("variant"), "green")


def arena_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = partition.keyed_partition(spark, KEY, SLOTS, K)
    return partition.arena_samples(part, 24, 2.0, "s").groupBy("slot", "variant").agg(F.count("*").alias("n")).select(F.col("slot").cast("long").alias("slot"), F.col("variant").cast("long").alias("variant"), "n")


def partition_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = partition.keyed_partition(spark, KEY, SLOTS, K)
    est = partition.estimate_partition(partition.arena_samples(part, 24, 2.0, "s"), K)
    return partition.partition_recovery(est, part).select(F.round("recovery", 6).alias("recovery"))


def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    budgets = spark.createDataFrame([(b,) for b in (1000, 4000, 8000, 24000)], "budget int")
    return registry.select_for(registry.models(spark), budgets)


def multi_bit_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 16-bit message written into sequences and read back."""
    message = tuple(i * 5 % 3 % 2 for i in range(16))
    seqs = G.sequences(spark, G.Recipe(kind="multibit", vocab=200, length=480, delta=3.0, message=message), 4)
    est = keyed.MultiBit("demo").estimate(keyed.positions(seqs, F.col("tokens"), "seq_id"), "seq_id")
    return keyed.bit_accuracy(est, spark.createDataFrame(list(enumerate(message)), "bit int, value int"))


def code_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choice matrix of code-like samples made from parts."""
    from glyphsift.operators.code_forms import featurize

    word = lambda i: F.when(F.pmod(F.col("p_partkey"), F.lit(i + 2)) == 0, F.lit(f"b{i}")).otherwise(F.lit(f"a{i}"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("task"), F.floor(F.col("p_partkey") / 48).cast("string")).alias("task"), F.col("p_partkey").cast("long").alias("sample_id"), F.array(*[word(i) for i in range(12)]).alias("tokens"))
    return featurize(rows)


def reference_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reference tables say of the documents: words by pivot, look-alikes folded, thresholds of the languages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    lexicon = files.lexicon(spark).select("pivot", "back", F.explode("words").alias("word"))
    by_pivot = words.join(F.broadcast(lexicon), "word").groupBy("pivot").agg(F.count("*").alias("n"), F.max("back").alias("says"))
    specs = docs.groupBy(F.col("lang").alias("pivot")).agg(F.count("*").alias("n")).join(F.broadcast(files.language_specs(spark).select(F.col("lang").alias("pivot"), F.col("threshold").cast("string").alias("says"))), "pivot")
    signs = table(spark, sf_dir, "pages").select(F.explode(F.split("html", "")).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    folded = signs.join(F.broadcast(files.confusables(spark).select(F.col("latin").alias("ch")).distinct()), "ch").select(F.col("ch").alias("pivot"), "n", F.lit("has look-alikes").alias("says"))
    out = by_pivot.select(F.lit("lexicon").alias("table_name"), F.col("pivot").alias("entry"), "n", "says")
    out = out.unionByName(specs.select(F.lit("language_specs").alias("table_name"), F.col("pivot").alias("entry"), "n", "says"))
    return out.unionByName(folded.select(F.lit("confusables").alias("table_name"), F.col("pivot").alias("entry"), "n", "says"))


_TOK = f"list_filter(regexp_split_to_array(text, '[{U.PY_SPACE}]+'), lambda x: x <> '')"


def _draw(*parts: str) -> str:
    return "('0x'||substr(sha256(" + "||'|'||".join(parts) + "),1,8))::UBIGINT::BIGINT"


def _sql(value: str) -> str:
    return f"SELECT doc_id, sha256(coalesce(array_to_string({value}, ' '), '')) AS out_sha256 FROM (SELECT doc_id, {_TOK} AS ts FROM documents)"


_UNITS = "flatten(list_reverse(list_transform(range(0, len(ts), {g}), lambda i: ts[i + 1 : i + {g}])))"
#: Units of four in the order of r, a place for each unit x of n.
_PLACED = "flatten(list_transform(list_sort(list_transform(range(0, (len(ts) + 3) // 4), lambda x: struct_pack(r := ({r}), x := x))), lambda y: ts[y.x * 4 + 1 : y.x * 4 + 4]))"
_PART = f"p AS (SELECT s AS slot, v AS variant, {_draw(f"'{KEY}'", 'CAST(s AS VARCHAR)', 'CAST(v AS VARCHAR)')} < 0.4 * 4294967296 AS green FROM range({SLOTS}) a(s), range({K}) b(v))"
_ARENA = f"{_PART}, c AS (SELECT slot, variant, sum(w) OVER (PARTITION BY slot ORDER BY variant) AS hi, sum(w) OVER (PARTITION BY slot) AS al FROM (SELECT *, pow(1.6::DOUBLE, -variant) * CASE WHEN green THEN exp(2.0::DOUBLE) ELSE 1 END AS w FROM p)), sm AS (SELECT i AS sample_id, slot, coalesce(min(variant) FILTER (hi > u * al), 0) AS variant FROM (SELECT i, c.*, {_draw("'s'", 'CAST(i AS VARCHAR)', 'CAST(slot AS VARCHAR)')}::DOUBLE / 4294967296.0::DOUBLE AS u FROM c, range(24) r(i)) GROUP BY i, slot)"
_MODELS = ", ".join(f"('{f}', '{n}', {p}::DOUBLE, {c})" for f, n, p, c in registry.MODELS)

QUERIES = {
    "make_vocab": lambda spark, d: G.make_vocab(spark, 400),
    "control_sequences": control,
    "substitute_tokens": substitute,
    "reorder_units": _joined(lambda t: G.reorder_units(t, 12)),
    "strategy_reverse": _joined(G.Strategy("reverse", 4).apply),
    "strategy_block_reverse": _joined(G.Strategy("block_reverse", 4, 3).apply),
    "strategy_stride": _joined(G.Strategy("stride", 4, 3).apply),
    "strategy_rotate": _joined(G.Strategy("rotate", 4, 3).apply),
    "overlap_cost": overlap_cost,
    "keyed_partition": keyed_partition,
    "arena_samples": arena_samples,
    "partition_recovery": partition_recovery,
    "model_registry": model_registry,
    "reference_tables": reference_tables,
    "multi_bit_accuracy": multi_bit_accuracy,
    "code_features": code_features,
    "marked_sequences": lambda spark, d: G.sequences(spark, G.Recipe(), 24),
    "tournament_sequences": lambda spark, d: G.sequences(spark, G.Recipe(kind="tournament"), 24),
    "scheme_benchmark": lambda spark, d: R.scheme_benchmark(spark),
    "benchmark_table": lambda spark, d: R.benchmark_table(R.scheme_benchmark(spark)),
    "detection_rates": lambda spark, d: R.detection_rates(spark),
    "reorder_effects": lambda spark, d: R.reorder_effects(spark),
    "reorder_degradation": lambda spark, d: R.reorder_degradation(spark, "prev", 12),
    "game_payoff": lambda spark, d: R.game_payoff(spark),
    "strategy_grid": lambda spark, d: R.strategy_grid(spark),
}
SQL = {
    "make_vocab": "SELECT i AS id, 'w'||i AS tok FROM range(400) r(i)",
    "control_sequences": f"SELECT 'control' AS arm, i AS seq_id, array_to_string(list_transform(range(180), lambda p: 'w'||({_draw("'control'", 'CAST(i AS VARCHAR)', 'CAST(p AS VARCHAR)')} % 250)), ' ') AS tokens FROM range(24) r(i)",
    "substitute_tokens": f"""WITH t AS (SELECT doc_id, unnest(ts) AS tok, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT doc_id, {_TOK} AS ts FROM documents)),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_draw("'sub'", 'CAST(doc_id AS VARCHAR)', 'CAST(pos AS VARCHAR)')}, pos) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM t)
 SELECT doc_id, count(*) AS n, sha256(string_agg(CASE WHEN rn <= round_even(n * 0.2::DOUBLE, 0) THEN 'w'||({_draw("'sub'", "'to'", 'CAST(doc_id AS VARCHAR)', 'CAST(pos AS VARCHAR)')} % 400) ELSE tok END, ' ' ORDER BY pos)) AS out_sha256 FROM r GROUP BY doc_id""",
    "reorder_units": _sql(_UNITS.format(g=12)),
    "strategy_reverse": _sql(_UNITS.format(g=4)),
    "strategy_block_reverse": _sql(_PLACED.format(r="x // 3 * 3 + least(x // 3 * 3 + 3, ((len(ts) + 3) // 4)) - 1 - x")),
    "strategy_stride": _sql(_PLACED.format(r="x % 3 * ((len(ts) + 3) // 4) + x")),
    "strategy_rotate": _sql(_PLACED.format(r="(x - 3 % ((len(ts) + 3) // 4) + ((len(ts) + 3) // 4)) % ((len(ts) + 3) // 4)")),
    "overlap_cost": f"WITH d AS (SELECT doc_id, {_TOK} AS ts FROM documents), b AS (SELECT doc_id, tok, count(*) AS nb FROM (SELECT doc_id, unnest(ts) AS tok FROM d) GROUP BY ALL), a AS (SELECT doc_id, tok, count(*) AS na FROM (SELECT doc_id, unnest(ts[len(ts) // 2 + 1 :]) AS tok FROM d) GROUP BY ALL) SELECT doc_id, round(1 - sum(least(nb, coalesce(na, 0)))::DOUBLE / sum(nb)::DOUBLE, 6) AS cost FROM b LEFT JOIN a USING (doc_id, tok) GROUP BY doc_id",
    "keyed_partition": f"WITH {_PART} SELECT * FROM p",
    "arena_samples": f"WITH {_ARENA} SELECT slot, variant, count(*) AS n FROM sm GROUP BY ALL",
    "partition_recovery": f"WITH {_ARENA}, g AS (SELECT slot, variant FROM (SELECT slot, variant, count(*) AS n, sum(count(*)) OVER (PARTITION BY slot) AS s FROM sm GROUP BY slot, variant) WHERE n::DOUBLE / s::DOUBLE > 1.15::DOUBLE / 4) SELECT round(avg(CASE WHEN green = ((slot, variant) IN (SELECT (slot, variant) FROM g)) THEN 1.0::DOUBLE ELSE 0 END), 6) AS recovery FROM p",
    "model_registry": f"WITH m(function, name, params, context) AS (VALUES {_MODELS}), b(budget) AS (VALUES (1000), (4000), (8000), (24000)), x AS (SELECT *, CAST(floor(620 * params + 1500 + 0.1::DOUBLE * context) AS INT) AS need FROM m, b) SELECT function, budget, coalesce(arg_max(name, params) FILTER (need <= budget), arg_min(name, params)) AS name, count(*) FILTER (need <= budget) > 0 AS fits FROM x GROUP BY function, budget",
    "reference_tables": f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), l(pv, back, word) AS (VALUES {', '.join(f"('{p}', '{w[-1]}', '{x}')" for p, w in LEXICON.items() for x in w)}),
 s(lang, t) AS (VALUES {', '.join(f"('{r[0]}', '{r[2]}')" for r in SPECS)}), c(ch) AS (VALUES {', '.join(f"('{x}')" for x in sorted(set(U.CONFUSABLES.values())))}), h AS (SELECT unnest(string_split(html, '')) AS ch FROM pages)
 SELECT 'lexicon' AS table_name, pv AS entry, count(*) AS n, max(back) AS says FROM w JOIN l USING (word) GROUP BY pv
 UNION ALL SELECT 'language_specs', lang, count(*), any_value(t) FROM documents JOIN s USING (lang) GROUP BY lang UNION ALL SELECT 'confusables', ch, count(*), 'has look-alikes' FROM h JOIN c USING (ch) GROUP BY ch""",
}
