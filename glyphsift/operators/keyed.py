"""Keyed statistical tests: hash predicates and proportion tests over tokens."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsift.functions.text import let

START = "<s>"
FULL = 4294967296.0
Z_ALARM = 4.0


def h32(*parts: Column | str) -> Column:
    """The first four bytes of SHA-256 of the parts joined by ``|``, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256), 1, 8), 16, 10).cast("long")


def below(gamma: float, *parts: Column | str) -> Column:
    """Whether :func:`h32` of the parts is less than that share of its range, told by the digest's digits as they stand."""
    limit = math.ceil(gamma * FULL)
    digest = F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)
    return F.lit(limit > 0) & digest.isNotNull() if not 0 < limit < FULL else digest < f"{limit:08x}"


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def proportion_z(hits: Column, n: Column, p: float) -> Column:
    """One-proportion z; 0 when nothing was scored."""
    return F.when(n > 0, (hits - p * n) / F.sqrt(F.greatest(n, F.lit(1)) * p * (1 - p))).otherwise(0.0)


def previous(tokens: Column) -> Column:
    """The token before each token; none for no tokens."""
    return F.slice(F.concat(F.array(F.lit(START)), tokens), 1, F.size(tokens))


@dataclass(frozen=True)
class GreenList:
    """A token is green if the hash of key, previous token and token is below gamma."""

    key: str
    gamma: float = 0.25

    def is_green(self, prev: Column, tok: Column) -> Column:
        return below(self.gamma, self.key, prev, tok)

    def count(self, tokens: Column, vocab: Column | Callable[[Column], Column] | None = None) -> Column:
        """``struct<green, scored>``; the context moves on over tokens outside the vocabulary (an array, or a test of a token)."""
        known = (lambda t: F.lit(True)) if vocab is None else vocab if not isinstance(vocab, Column) else (lambda t: F.array_contains(vocab, t))
        flags = lambda ts: F.zip_with(previous(ts), ts, lambda p, t: F.when(known(t), self.is_green(p, t)))
        # tokens and flags are bound, as each is looked at more than once
        counted = lambda fs: F.named_struct(F.lit("green"), F.size(F.filter(fs, lambda x: x)), F.lit("scored"), F.size(F.filter(fs, lambda x: x.isNotNull())))
        return let(let(tokens, flags), counted)

    def z(self, tokens: Column, vocab: Column | Callable[[Column], Column] | None = None) -> Column:
        c = self.count(tokens, vocab)
        return proportion_z(c["green"], c["scored"], self.gamma)

    def detect(self, df: DataFrame, tokens: str = "tokens") -> DataFrame:
        """``green, scored, z, alarm, fpr`` (the tail at the alarm's threshold) beside the row."""
        c = df.withColumn("__c", self.count(F.col(tokens)))
        z = proportion_z(F.col("__c.green"), F.col("__c.scored"), self.gamma)
        return c.withColumns({"green": F.col("__c.green"), "scored": F.col("__c.scored"), "z": z}).withColumns({"alarm": F.col("z") >= Z_ALARM, "fpr": F.lit(upper_tail(Z_ALARM))}).drop("__c")


@dataclass(frozen=True)
class Tournament:
    """Mean of the tokens' keyed values in [0, 1), against 1/2 with variance 1/12."""

    key: str
    layers: int = 4

    def value(self, prev: Column, tok: Column) -> Column:
        return h32(self.key, prev, tok) / FULL

    def total(self, tokens: Column) -> Column:
        """Sum of the hashes (a whole number, so the order of addition is of no account)."""
        return F.aggregate(F.zip_with(previous(tokens), tokens, lambda p, t: h32(self.key, p, t)), F.lit(0).cast("long"), lambda s, x: s + x)

    def mean(self, tokens: Column) -> Column:
        return F.when(F.size(tokens) > 0, self.total(tokens) / FULL / F.greatest(F.size(tokens), F.lit(1)))

    def z(self, tokens: Column) -> Column:
        n = F.greatest(F.size(tokens), F.lit(1))
        return F.when(F.size(tokens) > 0, (self.mean(tokens) - 0.5) / F.sqrt(F.lit(1 / 12) / n)).otherwise(0.0)


@dataclass(frozen=True)
class ContextScheme:
    """Green by a context: none, the previous token, the sorted last tokens, or the smallest hash around."""

    kind: str
    key: str
    gamma: float = 0.25
    window: int = 3
    h: int = 4

    def green(self, tokens: Column) -> Column:
        """``array<boolean>`` of the tokens."""
        return let(tokens, self._green)

    def _green(self, tokens: Column) -> Column:
        if self.kind == "unigram":
            return F.transform(tokens, lambda t: below(self.gamma, self.key, "", t))
        if self.kind == "prev":
            return F.zip_with(previous(tokens), tokens, lambda p, t: below(self.gamma, self.key, p, t))
        back = lambda i, n: F.slice(tokens, F.greatest(i - n, F.lit(0)) + 1, F.least(i, F.lit(n)))
        if self.kind == "window":
            return F.transform(tokens, lambda t, i: below(self.gamma, self.key, F.when(i > 0, F.array_join(F.array_sort(back(i, self.window)), "+")).otherwise(F.lit(START)), t))
        if self.kind == "selfhash":

            # each token is hashed once, not once for each window that it lies in
            lowest = lambda own, x, i: F.least(x, *[F.get(own, i - j) for j in range(1, self.h)]) if self.h > 1 else x
            low = let(F.transform(tokens, lambda t: h32(self.key, t)), lambda own: F.transform(own, lambda x, i: lowest(own, x, i)))
            return F.zip_with(low, tokens, lambda h, t: below(self.gamma, self.key, h.cast("string"), t))
        raise ValueError(f"no context scheme {self.kind!r}")

    def count(self, tokens: Column, vocab: Column | None = None) -> Column:
        """``struct<green, scored>`` over the vocabulary's tokens; all tokens are context."""
        if vocab is None:
            return let(self.green(tokens), lambda g: F.named_struct(F.lit("green"), F.size(F.filter(g, lambda x: x)), F.lit("scored"), F.size(g)))
        flags = self.green(tokens)
        if vocab is not None:
            flags = F.filter(F.zip_with(flags, tokens, lambda g, t: F.when(F.array_contains(vocab, t), g)), lambda x: x.isNotNull())
        return F.named_struct(F.lit("green"), F.size(F.filter(flags, lambda x: x)), F.lit("scored"), F.size(flags))

    def z(self, tokens: Column, vocab: Column | None = None) -> Column:
        c = self.count(tokens, vocab)
        return proportion_z(c["green"], c["scored"], self.gamma)


@dataclass(frozen=True)
class MultiBit:
    """Positions are dealt to the message's bits; a bit is 1 if its tokens are green for 1 more often than for 0."""

    key: str
    n_bits: int = 16
    gamma: float = 0.25

    def estimate(self, tokens: DataFrame, key: str = "doc_id") -> DataFrame:
        """``key, bit, green0, green1, value`` from ``key, pos, tok, prev``."""
        group = F.pmod(F.col("pos"), F.lit(self.n_bits))
        green = lambda b: (h32(self.key, group.cast("string"), str(b), F.col("prev"), F.col("tok")) < self.gamma * FULL).cast("int")
        return tokens.groupBy(key, group.alias("bit")).agg(F.sum(green(0)).alias("green0"), F.sum(green(1)).alias("green1")).withColumn("value", (F.col("green1") > F.col("green0")).cast("int"))


def positions(df: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    """``key, pos, tok, prev``: tokens in long form."""
    return df.select(key, F.posexplode(F.zip_with(previous(tokens), tokens, lambda p, t: F.struct(t.alias("tok"), p.alias("prev")))).alias("pos", "__t")).select(key, "pos", "__t.tok", "__t.prev")


def bit_accuracy(estimated: DataFrame, message: DataFrame) -> DataFrame:
    """Share of bits that agree; both ``bit, value``."""
    return estimated.join(message.select("bit", F.col("value").alias("__want")), "bit").agg(F.avg((F.col("value") == F.col("__want")).cast("double")).alias("accuracy"))
