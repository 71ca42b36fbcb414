"""Keyless statistics: distributions, steal-and-test plans and resampling, as group-by and join plans.

Randomness is an order by SHA-256, so a result depends on its seed alone and any
engine with that hash repeats it; it is not the stream of any generator.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphsift.functions.text import let
from glyphsift.operators.keyed import proportion_z
from glyphsift.sources.shared import stored


def draw(*parts: Column | str) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def half(seed: str, key: Column) -> Column:
    """0 (steal) or 1 (test) for a sample."""
    return F.pmod(draw(seed, "half", key), F.lit(2)).cast("int")


# -- comparison ---------------------------------------------------------------------------


def distribution(tokens: DataFrame, by: str = "arm") -> DataFrame:
    """``by, tok, n, p``: each arm's share of each token."""
    counts = tokens.groupBy(by, "tok").agg(F.count("*").alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("__n"))
    return counts.join(totals, by).select(by, "tok", "n", (F.col("n") / F.col("__n")).alias("p"))


def l1_distance(tokens: DataFrame, a: str, b: str, by: str = "arm") -> DataFrame:
    """``l1`` between the token distributions of two arms."""
    dist = distribution(tokens, by)
    left = dist.where(F.col(by) == a).select("tok", F.col("p").alias("__a"))
    right = dist.where(F.col(by) == b).select("tok", F.col("p").alias("__b"))
    return left.join(right, "tok", "full_outer").agg(F.sum(F.abs(F.coalesce("__a", F.lit(0.0)) - F.coalesce("__b", F.lit(0.0)))).alias("l1"))


def compare_arms(tokens: DataFrame, candidate: str, control: str, sample: str = "doc_id", ratio_threshold: float = 2.0, seed: str = "compare") -> DataFrame:
    """``l1, baseline, ratio, flagged``: candidate against control, over control against itself in halves."""
    halves = tokens.where(F.col("arm") == control).withColumn("arm", half(seed, F.col(sample)).cast("string"))
    both = l1_distance(tokens, candidate, control).crossJoin(l1_distance(halves, "0", "1").select(F.col("l1").alias("baseline")))  # one row each
    ratio = F.col("l1") / F.greatest(F.coalesce("baseline", F.lit(0.0)), F.lit(1e-9))
    return both.withColumn("ratio", ratio).withColumn("flagged", F.col("ratio") >= ratio_threshold)


# -- corpus unigram estimator --------------------------------------------------------------


def steal_green_set(candidate: DataFrame, reference: DataFrame, min_count: int = 5, lift: float = 1.3) -> DataFrame:
    """``tok, lift``: tokens that the candidate uses more often than the smoothed reference."""
    c = candidate.groupBy("tok").agg(F.count("*").alias("__c"))
    r = reference.groupBy("tok").agg(F.count("*").alias("__r"))
    c_all = c.agg(F.sum("__c").alias("__cn"))
    r_all = r.agg(F.coalesce(F.sum("__r"), F.lit(0)).alias("__rn"), F.count("*").alias("__rd"))
    smoothed = (F.coalesce("__r", F.lit(0)) + 0.5) / (F.col("__rn") + 0.5 * F.greatest("__rd", F.lit(1)))
    found = c.join(r, "tok", "left").crossJoin(c_all).crossJoin(r_all)  # totals: one row each
    return found.where(F.col("__c") >= min_count).withColumn("lift", F.col("__c") / F.col("__cn") / smoothed).where(F.col("lift") >= lift).select("tok", "lift")


def corpus_test(tokens: DataFrame, candidate: str, reference: str, min_count: int = 5, lift: float = 1.3, seed: str = "corpus") -> DataFrame:
    """``green_tokens, cand_green, cand_n, ref_green, ref_n, z``: green set from one half, two-proportion z on the other."""
    split = tokens.withColumn("__half", half(seed, F.col("doc_id")))
    steal = split.where("__half = 0")
    green = steal_green_set(steal.where(F.col("arm") == candidate), steal.where(F.col("arm") == reference), min_count, lift).select("tok", F.lit(1).alias("__g"))
    test = split.where((F.col("__half") == 1) & F.col("arm").isin(candidate, reference)).groupBy("arm", "tok").agg(F.count("*").alias("__n"))
    hit = test.join(green, "tok", "left")
    is_c = F.col("arm") == candidate
    sums = hit.agg(
        F.sum(F.when(is_c & (F.col("__g") == 1), F.col("__n")).otherwise(0)).alias("cand_green"), F.sum(F.when(is_c, F.col("__n")).otherwise(0)).alias("cand_n"),
        F.sum(F.when(~is_c & (F.col("__g") == 1), F.col("__n")).otherwise(0)).alias("ref_green"), F.sum(F.when(~is_c, F.col("__n")).otherwise(0)).alias("ref_n"),
    )
    pool = (F.col("cand_green") + F.col("ref_green")) / (F.col("cand_n") + F.col("ref_n"))
    var = pool * (1 - pool) * (1 / F.col("cand_n") + 1 / F.col("ref_n"))
    z = F.when((F.col("cand_n") > 0) & (F.col("ref_n") > 0) & (pool > 0) & (pool < 1), (F.col("cand_green") / F.nullif("cand_n", F.lit(0)) - F.col("ref_green") / F.nullif("ref_n", F.lit(0))) / F.sqrt(var)).otherwise(0.0)
    return sums.withColumn("z", z).crossJoin(green.agg(F.count("*").alias("green_tokens")))


# -- prose: next-token bias by context -----------------------------------------------------


def green_by_context(bigrams: DataFrame, margin: float = 0.5, min_context: int = 4, min_obs: int = 3) -> DataFrame:
    """``ctx, tok``: tokens that follow a context more often than they occur."""
    pair = pair_counts(bigrams).withColumnRenamed("n", "__n")
    ctx = pair.groupBy("ctx").agg(F.sum("__n").alias("__cn"))
    tok = pair.groupBy("tok").agg(F.sum("__n").alias("__tn"))
    all_ = tok.agg(F.sum("__tn").alias("__all"))
    # rare pairs, which are most, and rare contexts go before the joins
    joined = pair.where(F.col("__n") >= min_obs).join(ctx.where(F.col("__cn") >= min_context), "ctx").join(tok, "tok").crossJoin(all_)  # one row
    return joined.where((F.col("__n") / F.col("__cn") > (1 + margin) * F.col("__tn") / F.col("__all"))).select("ctx", "tok")


def pair_counts(bigrams: DataFrame) -> DataFrame:
    """``ctx, tok, n`` of bigrams, each a row or (with ``n``) a row that stands for several."""
    return bigrams if "n" in bigrams.columns else bigrams.groupBy("ctx", "tok").agg(F.count("*").alias("n"))


def bigrams_in(tokens: Column) -> Column:
    """``array<struct<ctx, tok>>``: each token of a row but the first, with the one before it."""
    but_one = lambda ts: F.greatest(F.size(ts) - 1, F.lit(0))
    return let(tokens, lambda ts: F.zip_with(F.slice(ts, F.lit(1), but_one(ts)), F.slice(ts, F.lit(2), but_one(ts)), lambda c, t: F.struct(c.alias("ctx"), t.alias("tok"))))


def bigrams_of(tokens: DataFrame, sample: str = "doc_id") -> DataFrame:
    """``sample, ctx, tok`` from ``sample, pos, tok``."""
    w = Window.partitionBy(sample).orderBy("pos")
    return tokens.select(sample, F.lag("tok").over(w).alias("ctx"), "tok").where(F.col("ctx").isNotNull())


#: What stands between tokens on their way to Python; no token has it.
BETWEEN = "\x1f"


def _met(by: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``by..., __p, __nh``: what each permutation meets, added up within a task.

    Rows are sorted by context: first (``__p`` of -1) its own tokens and counts,
    then the token sets that the permutations move there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts, sums, kinds = None, {}, Counter(), []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            for *key, p, tokens, ts in zip(*(batch.column(c).to_pylist() for c in (*by, "__j", "__p", "__toks", "__ts")), strict=True):
                if p < 0:
                    at, counts = key, dict(zip(tokens.split(BETWEEN), ts, strict=True))
                elif key == at:
                    sums[(*key[:-1], p)] += sum(counts.get(x, 0) for x in tokens.split(BETWEEN))
        if sums:
            columns = [*zip(*sums, strict=True), list(sums.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*kinds, pa.int32(), pa.int64()], strict=True)], names=[*by, "__p", "__nh"])

    return run


def prose_gaps(counts: DataFrame, by: list[str], margin: float = 0.5, min_context: int = 4, min_obs: int = 3, permutations: int = 200, seed: str = "prose") -> DataFrame:
    """``by..., n_contexts, z, null_mean, gap, p`` from ``by..., ctx, tok, s, t``: how often a pair stands in the steal and the test part.

    Green tokens of each context come from the steal part, as does the rate at
    which they occur there (``gamma``, 0.01 to 0.5).  The null deals the contexts'
    green sets to other contexts: the green rows, not the corpus, are multiplied by
    the permutations, a set of tokens (without U+001F) at a time, and each token is
    one lookup in the test part's counts.  With
    less than two contexts there is no test: gap and z are 0, p is 1.  Without a
    test part the steal part is tested.
    """
    spark = counts.sparkSession
    total = lambda df, keys, c, name: df.groupBy(*by, *keys).agg(F.sum(c).alias(name))
    on = lambda *more: [*by, *more]
    pair = counts.groupBy(*on("ctx", "tok")).agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    join = lambda x, y, *more: x.join(y, on(*more)) if on(*more) else x.crossJoin(y)  # noqa: E731  (one row each)
    pair = stored(pair, "prose-counts")
    whole = pair.groupBy(*by).agg(F.sum("s").alias("__all"), F.sum("t").alias("__tested"))
    pair = join(pair, whole).withColumn("t", F.when(F.col("__tested") == 0, F.col("s")).otherwise(F.col("t")))
    steal = pair.where("s > 0")
    # rare pairs, which are most, and rare contexts go before the joins
    cells = join(join(steal.where(F.col("s") >= min_obs), total(steal, ["ctx"], "s", "__cn").where(F.col("__cn") >= min_context), "ctx"), total(steal, ["tok"], "s", "__tn"), "tok")
    green = cells.where((F.col("s") / F.col("__cn") > (1 + margin) * F.col("__tn") / F.col("__all"))).select(*on("ctx", "tok", "s", "t"))
    green = stored(green, "prose-green")
    keys = green.select(*on("ctx")).distinct()
    own = stored(pair.join(keys, on("ctx"), "left_semi").select(*on("ctx", "tok", "s", "t")), "prose-tested")
    scored = own.groupBy(*by).agg(F.sum("s").alias("__ss"), F.sum("t").alias("__n"))
    real = green.groupBy(*by).agg(F.sum("s").alias("__hs"), F.sum("t").alias("__h"), F.count_distinct("ctx").alias("n_contexts"))
    base = join(scored, real)
    # contexts go by their place in the order; a permutation moves whole green sets, and only tokens of such sets are met
    index = stored(keys.withColumn("__j", F.row_number().over(Window.partitionBy(*by).orderBy("ctx"))), "prose-contexts")
    # the draws depend on context and permutation alone: one for each, whatever number of groups
    draws = index.select("ctx").distinct().withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))).withColumn("__u", draw(seed, F.col("__p"), F.col("ctx")))
    # each permutation is a task's work on the contexts of one group
    order = index.join(draws, "ctx").select(*on("__p"), F.col("__j").alias("__i"), "__u").withColumn("__to", F.row_number().over(Window.partitionBy(*by, "__p").orderBy("__u", "__i")))
    sets = green.join(index, on("ctx")).groupBy(*by, F.col("__j").alias("__i")).agg(F.concat_ws(BETWEEN, F.collect_list("tok")).alias("__toks"))
    moved = order.join(sets, on("__i")).select(*by, F.col("__to").alias("__j"), "__p", "__toks", F.lit(None).cast("array<bigint>").alias("__ts"))
    met = own.where("t > 0").join(green.select(*on("tok")).distinct(), on("tok"), "left_semi").join(index, on("ctx")).groupBy(*on("__j")).agg(F.collect_list(F.struct("tok", "t")).alias("__x"))
    met = met.select(*on("__j"), F.lit(-1).alias("__p"), F.concat_ws(BETWEEN, F.col("__x.tok")).alias("__toks"), F.col("__x.t").cast("array<bigint>").alias("__ts"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in green.select(*by).schema)
    hits = met.unionByName(moved).repartition(*on("__j")).sortWithinPartitions(*on("__j", "__p")).mapInArrow(_met(by), f"{kinds}__p int, __nh long")
    null = hits.groupBy(*on("__p")).agg(F.sum("__nh").alias("__nh"))
    grid = whole.select(*by).withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))) if by else spark.range(permutations).select(F.col("id").cast("int").alias("__p"))
    gamma = F.least(F.lit(0.5), F.greatest(F.lit(0.01), F.coalesce(F.col("__hs") / F.nullif("__ss", F.lit(0)), F.lit(0.1))))
    z = lambda h: F.when(F.col("__n") > 0, (h - F.col("__g") * F.col("__n")) / F.sqrt(F.greatest("__n", F.lit(1)) * F.col("__g") * (1 - F.col("__g")))).otherwise(0.0)
    one = base.withColumn("__g", gamma).withColumn("__z", z(F.col("__h")))
    each = join(grid.join(null, on("__p"), "left"), one).withColumn("__nz", z(F.coalesce("__nh", F.lit(0))))
    out = each.groupBy(*by).agg(F.first("n_contexts").alias("n_contexts"), F.first("__z").alias("z"), F.avg("__nz").alias("null_mean"), ((F.sum((F.col("__nz") >= F.col("__z")).cast("int")) + 1) / (F.count("*") + 1)).alias("p"))
    # groups without any green token have no row yet
    out = whole.select(*by).join(out, by, "left") if by else out
    tested = F.coalesce(F.col("n_contexts") >= 2, F.lit(False))
    return out.select(*by, F.coalesce("n_contexts", F.lit(0)).alias("n_contexts"), *[F.when(tested, F.col(c)).otherwise(0.0).alias(c) for c in ("z", "null_mean")], F.when(tested, F.col("z") - F.col("null_mean")).otherwise(0.0).alias("gap"), F.when(tested, F.col("p")).otherwise(1.0).alias("p"))


def prose_gap(bigrams: DataFrame, sample: str = "doc_id", margin: float = 0.5, min_context: int = 4, min_obs: int = 3, permutations: int = 200, seed: str = "prose") -> DataFrame:
    """``n_contexts, z, null_mean, gap, p`` of one corpus (``sample, ctx, tok``), split into halves by sample, or by a column ``test`` (:func:`half`) of the bigrams."""
    test = F.col("test") if "test" in bigrams.columns else half(seed, F.col(sample))
    counts = bigrams.groupBy("ctx", "tok").agg(F.sum(1 - test).alias("s"), F.sum(test).alias("t"))
    return prose_gaps(counts, [], margin, min_context, min_obs, permutations, seed)


def poisson_bounds() -> list[int]:
    """Poisson (1/2) by its distribution function on 32 bits: a draw counts the bounds that it reaches."""
    below, term = [], math.exp(-0.5)
    for k in range(10):
        below.append((below[-1] if below else 0.0) + term)
        term *= 0.5 / (k + 1)
    return [math.ceil(c * 4294967296.0) for c in below]


def poisson_half(*parts: Column | str) -> Column:
    """A number with a Poisson distribution of mean 1/2, by hash.

    A bootstrap draw with replacement takes each sample a Poisson (1) number of
    times; dealt to two halves, each half gets an independent one of mean 1/2.
    """
    u = draw(*parts)
    return F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in poisson_bounds()]), lambda c: u >= c))


def bootstrap_weights(seed: str, samples: list[str | None], n_boot: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each draw takes each sample into the steal and into the test part: the numbers of :func:`poisson_half`, draws by samples."""
    draws, bounds = [f"|{b}".encode() for b in range(n_boot)], np.array(poisson_bounds())

    def part(name: str) -> np.ndarray:
        heads = [hashlib.sha256("|".join(x for x in (seed, name, s) if x is not None).encode()) for s in samples]
        u = np.empty((n_boot, len(samples)), ">u4")
        for i, head in enumerate(heads):
            for b, tail in enumerate(draws):
                h = head.copy()
                h.update(tail)
                u[b, i] = int.from_bytes(h.digest()[:4], "big")
        return np.searchsorted(bounds, u.astype(np.int64), side="right")

    return part("steal"), part("test")


def _code_gap(codes: np.ndarray, ctx: np.ndarray, tok: np.ndarray, s: np.ndarray, t: np.ndarray, size: int, deal: Callable[[np.ndarray], np.ndarray], margin: float, min_context: int, min_obs: int) -> float:
    """The gap of :func:`prose_gaps` for one group: ``codes`` (context * size + token, ascending) with their counts, which may be 0.

    ``deal``: contexts to their draws, contexts by permutations.
    """
    if not t.any():
        t = s
    in_ctx, of_tok = np.bincount(ctx, s, size), np.bincount(tok, s, size)
    often = np.flatnonzero((s >= min_obs) & (in_ctx[ctx] >= min_context))
    green = often[s[often] / in_ctx[ctx[often]] > (1 + margin) * of_tok[tok[often]] / s.sum()]
    keys, begin, length = np.unique(ctx[green], return_index=True, return_counts=True)
    if len(keys) < 2:
        return 0.0
    is_key = np.zeros(size, bool)
    is_key[keys] = True
    own = is_key[ctx]
    n, steals = int(t[own].sum()), int(s[own].sum())
    gamma = min(0.5, max(0.01, int(s[green].sum()) / steals if steals else 0.1))
    z = lambda h: (h - gamma * n) / math.sqrt(max(n, 1) * gamma * (1 - gamma)) if n > 0 else 0.0
    # what a permutation can hit
    is_green = np.zeros(size, bool)
    is_green[tok[green]] = True
    hit = np.flatnonzero(own & (t > 0) & is_green[tok])
    targets, counts, greens, null = codes[hit], t[hit], tok[green], []
    for u in deal(keys).T:
        order = np.argsort(u, kind="stable")  # who comes r-th goes to the r-th context
        many = length[order]
        at = np.repeat(begin[order] - np.cumsum(many) + many, many) + np.arange(len(green))
        moved = np.repeat(keys, many) * size + greens[at]  # ascending, as are the targets
        place = np.searchsorted(targets, moved)
        met = place < len(targets)
        met[met] = targets[place[met]] == moved[met]
        null.append(z(int(counts[place[met]].sum())))
    return z(int(t[green].sum())) - sum(null) / len(null)


def _corpus_gaps(n_boot: int, permutations: int, margin: float, min_context: int, min_obs: int, seed: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``source, b, gap`` from ``source, __block, __id, __tokens``, all rows of a source and block of draws in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        corpora: dict[tuple, list[tuple[np.ndarray, np.ndarray, list]]] = {}
        kind = None
        for batch in batches:
            kind, tokens = batch.schema.field("source").type, pc.split_pattern(batch.column("__tokens"), BETWEEN)
            sources = list(zip(batch.column("source").to_pylist(), batch.column("__block").to_pylist(), strict=True))
            words = tokens.flatten().dictionary_encode()
            ids = np.array([numbers.setdefault(w, len(numbers)) for w in words.dictionary.to_pylist()], np.int32)[words.indices.to_numpy()]
            sizes, samples = tokens.value_lengths().to_numpy(), batch.column("__id").to_pylist()
            for source in dict.fromkeys(sources):
                mine = np.array([x == source for x in sources])
                corpora.setdefault(source, []).append((ids[np.repeat(mine, sizes)], sizes[mine], [x for x, m in zip(samples, mine, strict=True) if m]))
        ordered, size = sorted(numbers, key=str.encode), len(numbers)
        rank = np.empty(size, np.int64)
        rank[[numbers[w] for w in ordered]] = np.arange(size)
        numbers.clear()
        heads = [f"{seed}|{p}|" for p in range(permutations)]
        known, draws = np.full(size, -1), np.empty((0, permutations), np.uint32)

        def deal(keys: np.ndarray) -> np.ndarray:
            """Draws depend on context and permutation alone."""
            nonlocal draws
            new = keys[known[keys] < 0]
            known[new] = np.arange(len(draws), len(draws) + len(new))
            made = [[int.from_bytes(hashlib.sha256((h + ordered[k]).encode()).digest()[:4], "big") for h in heads] for k in new]
            draws = np.concatenate([draws, np.array(made, np.uint32).reshape(len(new), permutations)])
            return draws[known[keys]]

        for source, block in list(corpora):
            parts = corpora.pop((source, block))
            ids, sizes, samples = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [x for p in parts for x in p[2]]
            del parts
            later = np.ones(len(ids), bool)
            later[np.cumsum(sizes) - sizes] = False
            later = np.flatnonzero(later)
            codes = rank[ids[later - 1]] * size + rank[ids[later]]
            del ids, later
            order = np.argsort(codes)
            codes, sample = codes[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes - 1)[order]
            del order
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            codes = codes[first]
            ctx, tok = codes // size, codes % size
            steal, test = (w.astype(np.uint8) for w in bootstrap_weights(seed, samples, n_boot))
            found = []
            for b in range(block, n_boot, BLOCKS):
                s, t = (np.add.reduceat(w[b][sample], first, dtype=np.int64) for w in (steal, test))
                if s.any() or t.any():
                    found.append((b, _code_gap(codes, ctx, tok, s, t, size, deal, margin, min_context, min_obs)))
            yield pa.RecordBatch.from_arrays([pa.array([source] * len(found), kind), pa.array([b for b, _ in found], pa.int32()), pa.array([g for _, g in found], pa.float64())], names=["source", "b", "gap"])

    return run


#: Partitions over which sources and blocks are dealt, so that few meet in one; tasks that share the draws of a source.
DEALT, BLOCKS = 200, 2


def prose_bootstrap(samples: DataFrame, source: str = "source", sample: str = "doc_id", n_boot: int = 80, permutations: int = 40, margin: float = 0.5, min_context: int = 4, min_obs: int = 3, seed: str = "boot") -> DataFrame:
    """``source, b, gap``: prose gaps (:func:`prose_gaps`) of bootstrap draws of each source's samples.

    ``samples``: ``source, sample, tokens``.  A source's tokens (without
    U+001F) go to one task for each block of draws; its pairs are sorted there
    once, and each draw is a weighted sum over them.  Counts of the draws are
    neither written nor shuffled.  A task's memory grows with the largest
    source: some 24 bytes for each of its tokens.
    """
    kind = samples.schema[source].dataType.simpleString()
    rows = samples.where(F.size("tokens") > 1).select(F.col(source).alias("source"), F.col(sample).cast("string").alias("__id"), F.array_join("tokens", BETWEEN).alias("__tokens"), F.explode(F.array(*map(F.lit, range(BLOCKS)))).alias("__block"))
    found = rows.repartition(DEALT, "source", "__block").mapInArrow(_corpus_gaps(n_boot, permutations, margin, min_context, min_obs, seed), f"source {kind}, b int, gap double")
    return found.withColumnRenamed("source", source)


# -- context-keyed choice signature ---------------------------------------------------------


def context_signature(choices: DataFrame) -> DataFrame:
    """``pair, concentration, balance, score`` and a row with a null pair for all: from ``pair, context, choice`` ('a', 'b' or null)."""
    cell = choices.groupBy("pair", "context").agg(F.sum((F.col("choice") == "a").cast("int")).alias("__a"), F.sum((F.col("choice") == "b").cast("int")).alias("__b"))
    cell = cell.where(F.col("__a") + F.col("__b") > 0).withColumn("__p", F.col("__a") / (F.col("__a") + F.col("__b")))
    per = cell.groupBy("pair").agg(F.avg(2 * F.abs(F.col("__p") - 0.5)).alias("concentration"), F.avg((F.col("__p") >= 0.5).cast("double")).alias("__m"))
    per = per.withColumn("balance", 4 * F.col("__m") * (1 - F.col("__m"))).withColumn("score", F.col("concentration") * F.col("balance")).drop("__m")
    return per.unionByName(per.agg(F.lit(None).cast("string").alias("pair"), F.avg("concentration").alias("concentration"), F.avg("balance").alias("balance"), F.avg("score").alias("score")))


# -- residual variability --------------------------------------------------------------------


def residual_variability(tokens: DataFrame, by: list[str], sample: str = "sample_id") -> DataFrame:
    """``by..., variability``: mean over sample pairs of the token-multiset difference over the larger size.

    Pairs are formed within a task only (few samples each), by a join on the
    task with ``a < b``.
    """
    counts = tokens.groupBy(*by, sample, "tok").agg(F.count("*").alias("n"))
    packed = counts.groupBy(*by, sample).agg(F.map_from_entries(F.collect_list(F.struct("tok", "n"))).alias("m"), F.sum("n").alias("size"))
    a, b = packed.alias("a"), packed.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by])
    pair = a.join(b, on & (F.col(f"a.{sample}") < F.col(f"b.{sample}")))
    keys = F.array_union(F.map_keys("a.m"), F.map_keys("b.m"))
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0).cast("long"))
    diff = F.aggregate(keys, F.lit(0).cast("long"), lambda s, k: s + F.abs(at(F.col("a.m"), k) - at(F.col("b.m"), k)))
    return pair.select(*[F.col(f"a.{c}").alias(c) for c in by], (diff / F.greatest(F.col("a.size") + F.col("b.size"), F.lit(1))).alias("__v")).groupBy(*by).agg(F.avg("__v").alias("variability"))


def suite_probe(tokens: DataFrame, candidate: str, control: str, excess: float = 0.02) -> DataFrame:
    """``task, candidate, control, excess, flagged`` from ``task, arm, sample_id, tok``."""
    v = residual_variability(tokens, ["task", "arm"])
    wide = v.groupBy("task").pivot("arm", [candidate, control]).agg(F.first("variability"))
    return wide.select("task", F.col(candidate).alias("candidate"), F.col(control).alias("control")).withColumn("excess", F.col("candidate") - F.col("control")).withColumn("flagged", F.col("excess") >= excess)


def green_fraction(bigrams: DataFrame, green: DataFrame, gamma: float = 0.25) -> DataFrame:
    """``green, scored, z`` of pairs whose context has a green set."""
    scored = pair_counts(bigrams).join(green.select("ctx").distinct(), "ctx", "left_semi")
    hit = scored.join(green.withColumn("__g", F.lit(1)), ["ctx", "tok"], "left")
    return hit.agg(F.coalesce(F.sum(F.when(F.col("__g") == 1, F.col("n")).otherwise(0)), F.lit(0)).alias("green"), F.coalesce(F.sum("n"), F.lit(0)).alias("scored")).withColumn("z", proportion_z(F.col("green"), F.col("scored"), gamma))
