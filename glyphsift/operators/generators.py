"""Synthetic token sequences and the transforms they are tested under.

Marks are written with keys of our own over an invented vocabulary.  A sequence
depends on the tokens before, so it is made row by row in Python workers, one
sequence a row; everything that looks at a whole sequence at once is native.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphsift.functions.text import let
from glyphsift.operators.keyless import draw

FULL = 1 << 32


def make_vocab(spark: SparkSession, size: int = 400) -> DataFrame:
    """``id, tok``: w0, w1, ..."""
    return spark.range(size).select("id", F.concat(F.lit("w"), F.col("id").cast("string")).alias("tok"))


def h32(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:4], "big")


def context(kind: str, history: list[str], window: int = 3, h: int = 4) -> list[str]:
    """What the next token's hash depends on, besides key and token."""
    if kind == "unigram":
        return [""]
    if kind == "window":
        return ["+".join(sorted(history[-window:])) or "<s>"]
    if kind == "selfhash":
        return history[-(h - 1) :]
    return [history[-1] if history else "<s>"]


def is_green(kind: str, key: str, ctx: list[str], tok: str, gamma: float) -> bool:
    if kind == "selfhash":
        return h32(key, min(h32(key, x) for x in [*ctx, tok]), tok) < gamma * FULL
    return h32(key, ctx[0], tok) < gamma * FULL


@dataclass(frozen=True)
class Recipe:
    """How to write a sequence: kind is unigram, prev, window, selfhash, tournament, multibit or none."""

    kind: str = "prev"
    key: str = "demo"
    vocab: int = 400
    length: int = 180
    delta: float = 2.0
    gamma: float = 0.25
    layers: int = 4
    message: tuple[int, ...] = ()

    def write(self, seed: int) -> list[str]:
        rng = random.Random(seed)
        words, out, boost = [f"w{i}" for i in range(self.vocab)], [], math.exp(self.delta)
        for i in range(self.length):
            prev = out[-1] if out else "<s>"
            if self.kind == "none":
                tok = rng.choice(words)
            elif self.kind == "tournament":
                some = rng.sample(words, min(self.vocab, 2**self.layers))
                tok = max(some, key=lambda w: h32(self.key, prev, w))
            elif self.kind == "multibit":
                group = i % len(self.message)
                tok = self._pick(rng, words, lambda w: h32(self.key, group, self.message[group], prev, w) < self.gamma * FULL, boost)  # noqa: B023
            else:
                ctx = context(self.kind, out)
                tok = self._pick(rng, words, lambda w: is_green(self.kind, self.key, ctx, w, self.gamma), boost)  # noqa: B023
            out.append(tok)
        return out

    def _pick(self, rng: random.Random, words: list[str], green: Callable[[str], bool], boost: float) -> str:
        """A green word weighs ``boost``: by rejection, which needs few hashes."""
        while True:
            w = rng.choice(words)
            if green(w) or rng.random() * boost < 1:
                return w


def sequences(spark: SparkSession, recipe: Recipe, samples: int, seed: int = 1, arm: str = "marked") -> DataFrame:
    """``arm, seq_id, tokens``: one sequence for each seed."""

    def write(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"arm": arm, "seq_id": pdf["id"], "tokens": [recipe.write(seed * 1_000_003 + i) for i in pdf["id"].tolist()]})

    return spark.range(samples).repartition(min(samples, max(1, spark.sparkContext.defaultParallelism))).mapInPandas(write, "arm string, seq_id long, tokens array<string>")


def in_unit_order(recipe: Recipe, sizes: list[int], order: list[int], seed: int) -> list[str]:
    """Units written in ``order``, read in their own order."""
    rng, units, history = random.Random(seed), {}, []
    words, boost = [f"w{i}" for i in range(recipe.vocab)], math.exp(recipe.delta)
    for u in order:
        units[u] = []
        for _ in range(sizes[u]):
            ctx = context(recipe.kind, history)
            tok = recipe._pick(rng, words, lambda w: is_green(recipe.kind, recipe.key, ctx, w, recipe.gamma), boost)  # noqa: B023
            history.append(tok)
            units[u].append(tok)
    return [t for u in range(len(sizes)) for t in units[u]]


# -- native transforms of a token array ----------------------------------------------------


def control(spark: SparkSession, samples: int, length: int, vocab: int, seed: str = "control") -> DataFrame:
    """``arm, seq_id, tokens``: even draws by hash, no Python."""
    tok = lambda i: F.concat(F.lit("w"), F.pmod(draw(seed, F.col("id"), i), F.lit(vocab)).cast("string"))
    return spark.range(samples).select(F.lit("control").alias("arm"), F.col("id").alias("seq_id"), F.transform(F.sequence(F.lit(0), F.lit(length - 1)), tok).alias("tokens"))


def substitute(tokens: DataFrame, vocab: int, fraction: float, seed: str = "sub", key: str = "seq_id") -> DataFrame:
    """``key, pos, tok`` with round(fraction * n) tokens replaced, those whose hash comes first."""
    w = Window.partitionBy(key)
    rank = F.row_number().over(w.orderBy(draw(seed, F.col(key), F.col("pos")), "pos"))
    chosen = rank <= F.bround(F.count("*").over(w) * fraction)
    return tokens.select(key, "pos", F.when(chosen, F.concat(F.lit("w"), F.pmod(draw(seed, "to", F.col(key), F.col("pos")), F.lit(vocab)).cast("string"))).otherwise(F.col("tok")).alias("tok"))


def substituted(tokens: Column, key: Column, vocab: int, fraction: float, seed: str = "sub") -> Column:
    """The tokens of a row as :func:`substitute` would leave them, without a row for each."""
    other = lambda i: F.concat(F.lit("w"), F.pmod(draw(seed, "to", key, i), F.lit(vocab)).cast("string"))

    def changed(ts: Column) -> Column:
        drawn = F.transform(ts, lambda _, i: F.struct(draw(seed, key, i).alias("u"), i.alias("i")))
        last = lambda ds: F.get(F.array_sort(ds), (F.bround(F.size(ts) * fraction) - 1).cast("int"))
        # none where the index is -1
        return let(drawn, lambda ds: let(last(ds), lambda end: F.zip_with(ts, ds, lambda t, d: F.when(d <= end, other(d["i"])).otherwise(t))))

    return let(tokens, changed)


def reorder_units(tokens: Column, unit: int) -> Column:
    """Units of ``unit`` tokens in reverse order."""
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / unit).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.reverse(F.transform(starts, lambda i: F.slice(tokens, i * unit + 1, F.lit(unit)))))


def overlap_cost(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """``key, cost``: 1 less the share of the multiset of tokens that is left; no row for one without tokens.

    Counted within the row, so no token is shuffled.
    """

    @F.pandas_udf("double")
    def cost(before: pd.Series, after: pd.Series) -> pd.Series:
        def lost(b, a):
            b = Counter(b) if b is not None else Counter()
            return 1 - (b & Counter(a if a is not None else ())).total() / b.total() if b else None

        return pd.Series([lost(b, a) for b, a in zip(before, after, strict=True)], dtype="float64")

    # through a generator, as a filter would go below the projection and count once more
    return pairs.select(key, F.explode_outer(F.array(cost(before, after))).alias("cost")).where("cost is not null")


@dataclass(frozen=True)
class Strategy:
    """An order in which units are written: identity, reverse, block_reverse, stride or rotate."""

    kind: str = "identity"
    granularity: int = 1
    param: int = 2

    def order(self, n: int) -> list[int]:
        """Unit indexes in the order of writing."""
        seq, p = list(range(n)), max(1, self.param)
        if self.kind == "reverse":
            return seq[::-1]
        if self.kind == "block_reverse":
            return [x for b in range(0, n, p) for x in seq[b : b + p][::-1]]
        if self.kind == "stride":
            return [x for s in range(p) for x in seq[s::p]]
        if self.kind == "rotate":
            return seq[p % n :] + seq[: p % n] if n else []
        return seq

    def inverse(self, n: int) -> list[int]:
        place = [0] * n
        for i, u in enumerate(self.order(n)):
            place[u] = i
        return place

    def apply(self, tokens: Column) -> Column:
        """Units in the order of writing, natively."""
        g, n = self.granularity, F.ceil(F.size(tokens) / self.granularity).cast("int")
        units = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(self._rank(i, n).alias("r"), F.slice(tokens, i * g + 1, F.lit(g)).alias("u")))
        return F.flatten(F.transform(F.array_sort(units), lambda x: x["u"]))

    def _rank(self, i: Column, n: Column) -> Column:
        """Place of unit i in the order of writing."""
        p = max(1, self.param)
        if self.kind == "reverse":
            return (n - 1 - i).cast("long")
        if self.kind == "block_reverse":
            block = F.floor(i / p) * p
            return (block + F.least(block + p, n) - 1 - i).cast("long")
        if self.kind == "stride":
            return (F.pmod(i, F.lit(p)) * n + i).cast("long")
        if self.kind == "rotate":
            return F.pmod(i - F.pmod(F.lit(p), F.greatest(n, F.lit(1))), F.greatest(n, F.lit(1))).cast("long")
        return i.cast("long")

    def restore(self, written: list) -> list:
        """Units back in reading order."""
        return [written[i] for i in self.inverse(len(written))]

    def describe(self) -> str:
        return self.kind if self.kind in ("identity", "reverse") else f"{self.kind}({self.param})"
