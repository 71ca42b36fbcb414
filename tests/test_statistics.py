"""Rewriting, keyed and keyless statistics, partitions, generators and searches."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from glyphsift.functions import text as T
from glyphsift.operators import calibration, code_forms, generators, keyed, keyless, ladder, partition, registry, similarity
from glyphsift.operators import rewrite as R
from glyphsift.plans import robustness


def one(spark, text, value):
    return spark.createDataFrame([(text,)], "text string").select(value(F.col("text")).alias("v")).first().v


def test_involutions(spark):
    text = "Hello world. It is fine! Really?"
    assert one(spark, text, lambda t: R.reorder_reverse(R.reorder_reverse(t))) == text
    assert one(spark, text, lambda t: R.reverse_words(R.reverse_words(t))) == text
    assert one(spark, text, R.reorder_reverse) == "Really? It is fine! Hello world."


def test_edits(spark):
    assert one(spark, "It does not — “do not”…  isn’t", R.token_edits) == "It doesn't - \"don't\"... isn't"
    assert one(spark, "undo nothing", R.token_edits) == "undo nothing"
    assert one(spark, "KID Kid kid house", R.roundtrip_translate) == "CHILD Child child house"
    assert one(spark, "key sk-abcdefghijklmnop1 token: abc", T.redact_secrets) == "key [REDACTED-SECRET] [REDACTED-SECRET]"


@pytest.mark.parametrize(("text", "lang"), [("the cat and the dog", "en"), ("el perro y la casa", "es"), ("le chat et les chiens", "fr"), ("der Hund und die Katze", "de"), ("漢字", "zh"), ("漢字かな", "ja"), ("한국어", "ko"), ("مرحبا", "ar"), ("שלום", "he"), ("привет", "ru"), ("नमस्ते", "hi"), ("123", "und"), ("zzz", "en")])
def test_languages(spark, text, lang):
    assert one(spark, text, R.detect_language) == lang


def test_code_forms(spark):
    a = "int add(int x, int y) { /* sum */ return x + y; }"
    b = "int plus(int a, int b) { return a + b; } // done"
    assert one(spark, a, R.canonicalize_c) == one(spark, b, R.canonicalize_c) == "int v0 ( int v1 , int v2 ) { return v1 + v2 ; }"
    py = ["def f(a, b):\n    return a + b  # x", "```python\ndef g(x, y):\n    return x + y\n```", "def broken(:"]
    got = [r.v for r in spark.createDataFrame([(c,) for c in py], "c string").select(code_forms.canonicalize_python("c").alias("v")).collect()]
    assert got[0] == got[1] and got[2] == "def broken(:"
    assert one(spark, "x = b > a and c * a", code_forms.structural_normalize) == one(spark, "x = a * c and a < b", code_forms.structural_normalize)


def test_code_forms_of_names(spark):
    """Only names that the code binds are renamed; fences go, what they hold stays; order that means nothing is one."""
    assert code_forms.canonical("def f(x):\n    return len(x)") != code_forms.canonical("def f(x):\n    return sum(x)")
    assert code_forms.canonical("import os\ny = os.path.join(a, b)") == "import os\nv0 = os.path.join(a, b)"
    assert code_forms.canonical("def f(a, *r, k=1, **o):\n    t = a\n    return t, r, k, o") == "def v0(v1, *v3, v2=1, **v4):\n    v5 = v1\n    return (v5, v3, v2, v4)"
    assert code_forms.canonical("a b  c # gone\n\td") == "a b c d"
    assert code_forms.unfenced("```python\nx = 1\n```\ntext\n```\ny = 2\n```") == "x = 1\ntext\ny = 2"
    same = [("b == a", "a == b"), ("b != a", "a != b"), ("b >= a", "a <= b"), ("y or x", "x or y"), ("b | a", "a | b")]
    assert all(code_forms.structural(x) == code_forms.structural(y) for x, y in same)
    for kept in ("b - a", "a < b < c", "this is # not code"):
        assert code_forms.structural(kept) == kept
    rows = [("t", 0, "def f(a):\n    return len(a)"), ("t", 1, "def g(b):\n    return len(b)"), ("u", 0, "x = 1"), ("u", 1, "x = 1 + 1")]
    got = {r.task: r.variability for r in code_forms.code_variability(spark.createDataFrame(rows, "task string, sample_id long, code string")).collect()}
    assert got["t"] == 0 and got["u"] == pytest.approx(2 / 8)
    assert one(spark, "```c\nint f(int a) { return a; }\n```", lambda c: code_forms.canonicalize_for("c", c)) == "int v0 ( int v1 ) { return v1 ; }"


def test_featurize(spark):
    rows = [("t", i, ["a", "b", "c"]) for i in range(3)] + [("t", 3, ["a", "x", "c"]), ("t", 4, ["a", "c"])]
    got = {(r.sample_id, r.slot): r.variant for r in code_forms.featurize(spark.createDataFrame(rows, "task string, sample_id long, tokens array<string>")).collect()}
    assert got == {(0, 1): 1, (1, 1): 1, (2, 1): 1, (3, 1): 2, (4, 1): 0}


def test_green_list(spark):
    toks = ["a", "b", "c", "a"]
    prev = ["<s>", *toks]
    want = sum(int.from_bytes(hashlib.sha256(f"k|{p}|{t}".encode()).digest()[:4], "big") < 0.25 * 2**32 for p, t in zip(prev, toks))
    df = spark.createDataFrame([(toks,), ([],)], "tokens array<string>")
    got = keyed.GreenList("k").detect(df).collect()
    assert (got[0].green, got[0].scored) == (want, 4) and (got[1].scored, got[1].z) == (0, 0.0)
    assert got[0].fpr == pytest.approx(0.5 * math.erfc(4 / math.sqrt(2)))


@pytest.mark.parametrize("kind", ["unigram", "prev", "window", "selfhash", "tournament"])
def test_marks_are_found(spark, kind):
    seqs = generators.sequences(spark, generators.Recipe(kind=kind, length=200, vocab=250), 4)
    right = seqs.select(F.min(robustness.score(kind, "demo", F.col("tokens")))).first()[0]
    wrong = seqs.select(F.max(F.abs(robustness.score(kind, "other", F.col("tokens"))))).first()[0]
    assert right > 4 and (wrong < 6 if kind == "unigram" else wrong < 4.5)


def test_rates(spark):
    r = robustness.detection_rates(spark, samples=12)
    r = r.first()
    assert r.tpr >= 0.95 and r.fpr <= 0.05 and r.removal >= 0.3
    effects = {x.effect: x for x in robustness.reorder_effects(spark, samples=3).collect()}
    assert effects["reverse"].z_before > 15 and effects["reverse"].z_after < 3 and effects["dictionary"].z_after < 0.7 * effects["dictionary"].z_before


def test_message(spark):
    message = (1, 0, 1, 1, 0, 0, 1, 0)
    seqs = generators.sequences(spark, generators.Recipe(kind="multibit", vocab=200, length=320, delta=3.0, message=message), 1)
    est = keyed.MultiBit("demo", 8).estimate(keyed.positions(seqs, F.col("tokens"), "seq_id"), "seq_id")
    assert keyed.bit_accuracy(est, spark.createDataFrame(list(enumerate(message)), "bit int, value int")).first().accuracy == 1.0


def test_partition(spark):
    part = partition.keyed_partition(spark, "p", 80, 4)
    marked, plain = (partition.arena_samples(part, 40, d, f"s{d}") for d in (2.0, 0.0))
    even = partition.arena_samples(part, 40, 0.0, "e", style=1.0)
    assert partition.steal_and_test(marked, 4, 80).first().gap > 5
    assert abs(partition.steal_and_test(plain, 4, 80).first().gap) < 3 and abs(partition.steal_and_test(even, 4, 80).first().gap) < 3
    assert partition.partition_recovery(partition.estimate_partition(marked, 4), part).first().recovery >= 0.7
    base = partition.bootstrap_gaps(even, 4, 80, n_boot=10, permutations=20)
    assert partition.score_against_baseline(base, 50.0).first().fpr == pytest.approx(1 / 11)
    assert partition.score_against_baseline(base.limit(0), 1.0).first().fpr == 1.0


def test_prose_gap(spark):
    toks = lambda df: df.select(F.col("seq_id").alias("doc_id"), F.posexplode("tokens").alias("pos", "tok"))
    marked = generators.sequences(spark, generators.Recipe(vocab=60, length=800), 16)
    plain = generators.control(spark, 16, 800, 60)
    gap = lambda df: keyless.prose_gap(keyless.bigrams_of(toks(df)), permutations=40).first()
    assert gap(marked).gap > 20 and gap(marked).p < 0.05
    assert abs(gap(plain).gap) < 5
    few = keyless.prose_gap(keyless.bigrams_of(toks(plain.limit(1))).where("ctx = 'w1'"), permutations=10).first()
    assert (few.gap, few.z, few.p) == (0.0, 0.0, 1.0)


def test_poisson_half(spark):
    n = [r[0] for r in spark.range(4000).select(keyless.poisson_half("x", F.col("id"))).collect()]
    for k, p in enumerate([0.6065, 0.3033, 0.0758]):
        assert abs(n.count(k) / 4000 - p) < 0.03


def test_language_thresholds(spark):
    rows = [("en", "changed", i / 100) for i in range(100)] + [("en", "preserved", 0.5 + i / 100) for i in range(50)] + [("de", "changed", 0.3), ("de", "changed", 0.2), ("de", "preserved", 0.3), ("fr", "preserved", 0.1)]
    got = {r.lang: r for r in similarity.language_thresholds(spark.createDataFrame(rows, "lang string, label string, score double"), 0.05).collect()}
    for lang in ("en", "de", "fr"):
        assert got[lang].threshold == similarity.threshold_at_false_accept([s for x, label, s in rows if x == lang and label == "changed"], 0.05)
    assert got["en"].false_accept == pytest.approx(0.05) and got["de"].true_accept == 0 and got["fr"].true_accept == 1


def test_similarity(spark):
    pairs = spark.createDataFrame([(0, "the cat sat on the mat", "the cat sat on a mat"), (1, "the cat sat", "wholly other words"), (2, "", "x"), (3, "same", "same")], "pair_id long, before string, after string")
    got = {r.pair_id: r.score for r in similarity.similarity(pairs).collect()}
    assert got[3] == pytest.approx(1) and got[0] > 0.6 > got[1] and got[2] == 0
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([], [])], "a array<double>, b array<double>")
    assert [r.c for r in v.select(similarity.dense_cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0]
    s = spark.createDataFrame([("preserved", 0.9), ("preserved", 0.5), ("changed", 0.5), ("changed", 0.1)], "label string, score double")
    assert similarity.separation_auc(s).first().auc == 0.875
    assert similarity.threshold_at_false_accept([0.1, 0.4], 0.0) > 0.4 and similarity.threshold_for("en-US") == 0.6 and similarity.threshold_for("xx") == 0.25


@pytest.mark.parametrize("kind", ["identity", "reverse", "block_reverse", "stride", "rotate"])
@pytest.mark.parametrize("n", [1, 4, 11])
def test_strategies(spark, kind, n):
    s = generators.Strategy(kind, 1, 3)
    units = [f"u{i}" for i in range(n)]
    written = [units[i] for i in s.order(n)]
    assert s.restore(written) == units
    assert spark.createDataFrame([(units,)], "t array<string>").select(s.apply(F.col("t")).alias("v")).first().v == written


def test_game():
    p, q, v = robustness.fictitious_play([[1.0, -1.0], [-1.0, 1.0]])
    assert robustness.is_mixed(p) and robustness.is_mixed(q) and abs(v) < 0.05
    p, _, v = robustness.fictitious_play([[0.2, 0.3], [0.9, 0.8]])
    assert not robustness.is_mixed(p) and abs(v - 0.3) < 0.05


def test_searches(spark):
    best, history = robustness.evolve(spark, generations=3, population=4)
    assert history == sorted(history) and best is not None
    rounds = robustness.coevolve(spark, rounds=2)
    assert all(r["capacity"] >= robustness.FLOOR_SLOTS for r in rounds)
    e = robustness.edit_policy(spark, 0.6)
    assert e["z_after"] < e["z_before"]


def test_edit_policies(spark):
    still, natural, uniform = robustness.evaluate_policies(spark, [robustness.EditPolicy(0.0), robustness.EditPolicy(0.9), robustness.EditPolicy(0.9, "uniform")])
    assert still["reduction"] == 0 and still["retention"] == 1 and still["base_z"] > 2
    assert natural["reduction"] > 0.3 and natural["retention"] >= 0.99 and uniform["fitness"] < -1
    best, found, history = robustness.evolve_policy(spark, generations=2, population=4)
    assert history == sorted(history) and found["retention"] >= 0.99 and best.target in ("natural", "uniform", "avoid")


def test_registry(spark):
    got = {(r["function"], r.budget): (r.name, r.fits) for r in registry.select_for(registry.models(spark), spark.createDataFrame([(100,), (9000,)], "budget int")).collect()}
    assert got[("chat", 9000)] == ("medium", True) and got[("chat", 100)] == ("tiny", False)


def test_ladder(spark):
    df = spark.createDataFrame([(0, "It is hid\u200bden and it is fine.", "en"), (1, "it is", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in ladder.rewritten(df, 2).collect()}
    assert got[0].accepted and got[0].text == "It is hidden and it's fine."
    assert not got[1].accepted and got[1].text == "it is"
    assert ladder.rewritten(df, 1).where("doc_id = 0").first().text == "It is hidden and it is fine."
    assert ladder.rewritten(df, 3, model=F.upper, threshold=0.0).where("doc_id = 1").first().text == "IT IS"
    for bad in (3, 4):
        with pytest.raises(ValueError):
            ladder.rewritten(df, bad)


def test_calibration(spark):
    even = partition.arena_samples(partition.keyed_partition(spark, "p", 40, 4), 30, 0.0, "e", style=1.0)
    marked = partition.arena_samples(partition.keyed_partition(spark, "p", 40, 4), 60, 3.0, "m", style=1.0)
    r = calibration.calibrate([even], marked, 4, 40, n_boot=20, permutations=20).first()
    assert r.exceeds and r.fpr < 0.05
    seqs = lambda df: df.select(F.col("seq_id").alias("doc_id"), "tokens")
    plain, made = generators.control(spark, 8, 300, 40), generators.sequences(spark, generators.Recipe(vocab=40, length=600), 12)
    r = calibration.calibrate_prose([seqs(plain)], seqs(made), n_boot=20, permutations=10).first()
    assert r.exceeds and r.gap > 5


def _by_brute_force(a, b):
    from collections import Counter

    def cosine(x, y):
        x, y = Counter(x), Counter(y)
        return sum(n * y[g] for g, n in x.items()) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values())) if x and y else 0.0

    chars = lambda t: [t[i : i + 3] for i in range(len(t) - 2)] or [t] * (t != "")
    words = lambda t: t.split() + [" ".join(p) for p in zip(t.split(), t.split()[1:], strict=False)]
    return max(cosine(chars(a), chars(b)), cosine(words(a), words(b)))


def test_similarity_stays_within_the_row(spark):
    texts = ["the cat sat on the mat. the dog did not", "the dog did not the cat sat", "ab", "b", "", "naïve 😀😀 café 😀", "aaaa aaaa aaaa", None]
    pairs = spark.createDataFrame([(10 * i + j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)], "pair_id long, before string, after string")
    out = similarity.similarity(pairs)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()  # no gram is shuffled
    for r in out.join(pairs, "pair_id").collect():
        assert r.score == pytest.approx(_by_brute_force(r.before or "", r.after or ""), abs=1e-12)


def test_bootstrap_adds_up_within_the_tasks(spark, monkeypatch):
    ids = ["7", "12", None]
    steal, test = keyless.bootstrap_weights("x", ids, 5)
    for name, got in (("steal", steal), ("test", test)):
        rows = spark.createDataFrame([(i, s, b) for i, s in enumerate(ids) for b in range(5)], "i int, s string, b int").select("i", "b", keyless.poisson_half("x", name, F.col("s"), F.col("b")).alias("w")).collect()
        assert all(got[r.b, r.i] == r.w for r in rows)
    made = partition.arena_samples(partition.keyed_partition(spark, "p", 6, 3), 40, 1.0, "e").withColumn("source", F.when(F.col("sample_id") < 15, "a").otherwise("b"))
    whole = {(r.source, r.b): r.gap for r in partition.bootstrap_gaps(made, 3, 6, 8, 10, source=None).collect()}
    monkeypatch.setattr(partition, "HELD", 3)  # handed on again and again
    again = {(r.source, r.b): r.gap for r in partition.bootstrap_gaps(made, 3, 6, 8, 10, source=None).collect()}
    assert whole == again and len(whole) == 16 and len(set(whole.values())) > 8


def test_bigrams_within_a_row(spark):
    df = spark.createDataFrame([(0, ["a", "b", "a", "b"]), (1, ["x"]), (2, [])], "doc_id long, tokens array<string>")
    inside = df.select("doc_id", F.explode(keyless.bigrams_in(F.col("tokens"))).alias("b")).select("doc_id", "b.ctx", "b.tok")
    assert sorted(map(tuple, inside.collect())) == [(0, "a", "b"), (0, "a", "b"), (0, "b", "a")]
    # counted pairs say the same as the bigrams themselves
    many = inside.crossJoin(spark.range(5)).drop("id").unionByName(spark.createDataFrame([(3, "q", "r"), (3, "q", "s")], "doc_id long, ctx string, tok string"))
    pairs = keyless.pair_counts(many)
    green = keyless.green_by_context(many, margin=0.2)
    assert sorted(map(tuple, keyless.green_by_context(pairs, margin=0.2).collect())) == sorted(map(tuple, green.collect())) != []
    assert keyless.green_fraction(pairs, green).first() == keyless.green_fraction(many, green).first()


def test_prose_bootstrap_agrees_with_the_counts(spark):
    made = generators.sequences(spark, generators.Recipe(vocab=30, length=120), 14).select(F.col("seq_id").alias("doc_id"), "tokens").withColumn("source", F.when(F.col("doc_id") < 5, "a").otherwise("b"))
    out = keyless.prose_bootstrap(made, n_boot=5, permutations=7)
    got = {(r.source, r.b): r.gap for r in out.collect()}
    assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString()  # no counts of draws are shuffled
    grams = made.crossJoin(spark.range(5).select(F.col("id").cast("int").alias("b"))).select("source", "b", *[keyless.poisson_half("boot", part, F.col("doc_id"), F.col("b")).alias(part) for part in ("steal", "test")], F.explode(keyless.bigrams_in(F.col("tokens"))).alias("x"))
    counts = grams.groupBy("source", "b", "x.ctx", "x.tok").agg(F.sum("steal").alias("s"), F.sum("test").alias("t"))
    want = {(r.source, r.b): r.gap for r in keyless.prose_gaps(counts, ["source", "b"], permutations=7, seed="boot").collect()}
    assert got.keys() == want.keys() and len(set(got.values())) > 5
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_keyed_counts_of_a_row(spark):
    h = lambda *p: int(hashlib.sha256("|".join(p).encode()).hexdigest()[:8], 16)
    docs = [f"t{i % 7} w{i % 5} tx{i % 3} é{i}".split() * (i % 4) for i in range(12)]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, tokens array<string>")
    for gamma in (0.25, 0.5, 0.3, 0.0, 1.0):
        g, c = keyed.GreenList("k", gamma), keyed.ContextScheme("selfhash", "k", gamma)
        starts = lambda t: F.startswith(t, F.lit("t"))
        for r in df.select("i", g.count(F.col("tokens"), starts).alias("v"), g.count(F.col("tokens"), F.filter("tokens", starts)).alias("a"), c.count(F.col("tokens")).alias("c")).collect():
            ts = docs[r.i]
            hits = [h("k", p, t) < gamma * 2**32 for p, t in zip(["<s>", *ts], ts, strict=False) if t[0] == "t"]
            own = [h("k", t) for t in ts]
            around = [h("k", str(min(own[max(0, i - 3) : i + 1])), t) < gamma * 2**32 for i, t in enumerate(ts)]
            assert tuple(r.v) == tuple(r.a) == (sum(hits), len(hits)) and tuple(r.c) == (sum(around), len(around))


def test_substitution_and_overlap_within_a_row(spark):
    df = spark.createDataFrame([(i, [f"a{j % 9}" for j in range(i)]) for i in (0, 1, 2, 3, 12, 13, 40)], "k long, tokens array<string>")
    long = generators.substitute(df.select("k", F.posexplode("tokens").alias("pos", "tok")), 50, 0.2, key="k")
    want = {}
    for r in sorted(long.collect(), key=lambda r: (r.k, r.pos)):
        want.setdefault(r.k, []).append(r.tok)
    got = {r.k: r.t for r in df.select("k", generators.substituted(F.col("tokens"), F.col("k"), 50, 0.2).alias("t")).collect()}
    assert got.pop(0) == [] and got == want
    cost = generators.overlap_cost(df.withColumn("after", F.slice("tokens", 1, 4)), "k", "tokens", "after")
    assert "hashpartitioning" not in cost._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r.cost for r in cost.collect()} == {k: 1 - min(k, 4) / k for k in (1, 2, 3, 12, 13, 40)}


def test_permutations_move_sets_of_tokens(spark):
    made = generators.sequences(spark, generators.Recipe(vocab=30, length=200), 12).select(F.col("seq_id").alias("doc_id"), F.explode(keyless.bigrams_in(F.col("tokens"))).alias("b")).select("doc_id", "b.ctx", "b.tok")
    pairs = made.groupBy("ctx", "tok").agg(F.sum(1 - keyless.half("x", F.col("doc_id"))).alias("s"), F.sum(keyless.half("x", F.col("doc_id"))).alias("t"))
    out = keyless.prose_gaps(pairs, [], permutations=9, seed="x")
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    rows = {(r.ctx, r.tok): (r.s, r.t) for r in pairs.collect()}
    share = lambda i, k: sum(v[0] for w, v in rows.items() if w[i] == k)
    total = sum(v[0] for v in rows.values())
    green = [w for w, (s, _) in rows.items() if s >= 3 and share(0, w[0]) >= 4 and s / share(0, w[0]) > 1.5 * share(1, w[1]) / total]
    keys = sorted({c for c, _ in green})
    own = [v for w, v in rows.items() if w[0] in keys]
    n, gamma = sum(v[1] for v in own), min(0.5, max(0.01, sum(rows[w][0] for w in green) / sum(v[0] for v in own)))
    z = lambda h: (h - gamma * n) / math.sqrt(n * gamma * (1 - gamma))
    null = []
    for p in range(9):
        to = dict(zip(sorted(keys, key=lambda c: (hashlib.sha256(f"x|{p}|{c}".encode()).hexdigest()[:8], c)), keys, strict=True))
        null.append(z(sum(rows.get((to[c], t), (0, 0))[1] for c, t in green)))
    r = out.first()
    assert len(keys) >= 2 and r.n_contexts == len(keys) and r.z == pytest.approx(z(sum(rows[w][1] for w in green))) and r.null_mean == pytest.approx(sum(null) / 9) and r.p == (sum(x >= r.z for x in null) + 1) / 10
