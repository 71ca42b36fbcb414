"""Order MinHash document fingerprints (operator 2).  DataFrame functions only.

Method: the k-mers are runs of two words (the last word also stands alone).
Each gets its occurrence number, so the n-th "of the" differs from the first.
A hash of k-mer and number assigns it to one of 64 bins and ranks it there; two
bins make a component, so each of the 32 components has up to two minimal
numbered k-mers.  They keep the order that they have in the text, and the hash
of the ordered tuple is the component: texts agree on it only if they share the
minimal k-mers in the same order, which tracks edit distance where plain
MinHash sees a set.  A component whose bins are empty is ``--------``; the
likeness of two fingerprints is the share of equal components among those that
are not empty in both.

Everything happens within a row by two sorts of packed longs, so a text costs
n log n, and no word is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsift.sources.tables import table

from .common import NO_ID, identified, ordered, stored, words

PARTS = 32
POS, GRAM = 30, 33
EMPTY = "-" * 8
_POS = (1 << POS) - 1


def _pack(gram: Column, number: Column, at: Column) -> Column:
    """bin (6 bits), rank (27 bits), place (30 bits) of a numbered k-mer."""
    h = F.xxhash64(gram, number)
    return h.bitwiseAND(F.lit(((1 << GRAM) - 1) << POS)).bitwiseOR(at)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of column ``text``."""
    rest = [c for c in df.columns]
    a = df.select(*rest, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("__h"))
    gram = lambda x, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(x, F.get("__h", i + 1)), POS + 1), POS).bitwiseOR(i.cast("long"))
    b = a.select(*rest, F.sort_array(F.transform("__h", gram)).alias("__s"))
    key = lambda x: F.shiftright(x, POS)
    at = lambda x: x.bitwiseAND(F.lit(_POS))
    first = F.filter("__s", lambda x, i: (i == 0) | (key(F.get("__s", i - 1)) != key(x)))
    again = F.filter("__s", lambda x, i: (i > 0) & (key(F.get("__s", i - 1)) == key(x)))
    c = b.select(*rest, F.transform(first, lambda x: _pack(key(x), F.lit(1), at(x))).alias("__one"), again.alias("__more")).drop("__s")
    # the second and later occurrences: few; their minima by bin, in one pass
    start = F.struct(F.lit(-1).cast("long").alias("k"), F.lit(1).alias("n"), F.array_repeat(F.lit(2**63 - 1).cast("long"), 2 * PARTS).alias("m"))

    def step(s: Column, x: Column) -> Column:
        number = F.when(s["k"] == key(x), s["n"] + 1).otherwise(F.lit(2))
        v = _pack(key(x), number, at(x))
        bin_ = F.shiftright(v, 57).cast("int")
        low = F.when(v < F.get(s["m"], bin_), F.transform(s["m"], lambda y, j: F.when(j == bin_, v).otherwise(y))).otherwise(s["m"])
        return F.struct(key(x).alias("k"), number.alias("n"), low.alias("m"))

    least = F.when(F.size("__more") > 0, F.filter(F.aggregate("__more", start, step, lambda s: s["m"]), lambda x: x < F.lit(2**63 - 1))).otherwise(F.array().cast("array<long>"))
    d = c.select(*rest, F.sort_array(F.concat("__one", least)).alias("__v"))
    e = d.select(*rest, F.filter("__v", lambda x, i: (i == 0) | (F.shiftright(F.get("__v", i - 1), 57) != F.shiftright(x, 57))).alias("__m"))
    rank = lambda x: F.shiftright(x, POS).bitwiseAND(F.lit((1 << GRAM) - 1))
    part = lambda x: F.shiftright(x, 58)

    def component(x: Column, i: Column) -> Column:
        nxt = F.get("__m", i + 1)
        pair = F.when(part(nxt) == part(x), F.when(at(x) <= at(nxt), F.xxhash64(rank(x), rank(nxt))).otherwise(F.xxhash64(rank(nxt), rank(x)))).otherwise(F.xxhash64(rank(x)))
        return F.struct(part(x).cast("int").alias("k"), F.lower(F.substring(F.lpad(F.hex(pair), 16, "0"), 9, 8)).alias("v"))

    f = e.select(*rest, F.map_from_entries(F.filter(F.transform("__m", lambda x, i: F.when((i == 0) | (part(F.get("__m", i - 1)) != part(x)), component(x, i))), lambda y: y.isNotNull())).alias("__c"))
    whole = F.array_join(F.array(*[F.coalesce(F.try_element_at("__c", F.lit(i)), F.lit(EMPTY)) for i in range(PARTS)]), "")
    return f.select(*rest, whole.alias(out))


def likeness(a: str, b: str) -> Column:
    """Share of equal components of two fingerprints; two empty ones are alike."""
    cut = lambda c: [F.substring(c, 8 * i + 1, 8) for i in range(PARTS)]
    both = list(zip(cut(F.col(a)), cut(F.col(b)), strict=True))
    same = sum((F.when((x == y) & (x != EMPTY), 1).otherwise(0) for x, y in both), F.lit(0))
    some = sum((F.when((x != EMPTY) | (y != EMPTY), 1).otherwise(0) for x, y in both), F.lit(0))
    return F.when(some == 0, F.lit(1.0)).otherwise(same / some)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts.

    Null text counts as empty (all components empty).  The next document is
    the next smaller ``doc_id``, after the smallest the largest (null ids are
    the smallest); of equal ids, texts follow by hash.  Rows that repeat id and
    text are one document in that order, and each gets its row.  An empty
    table gives no rows.
    """
    base = identified(docs)
    keys = base.groupBy("__d", "__t").agg(F.max(F.length("text")).cast("long").alias("n_chars"))
    placed = ordered(keys, [F.col("__d").desc(), F.col("__t")], name="order")
    n = placed.count()
    own = placed.select("__d", "__t", "n_chars", F.when(F.col("__pos") + 1 == n, F.lit(0)).otherwise(F.col("__pos") + 1).alias("__next"))
    nxt = placed.select(F.col("__d").alias("__ed"), F.col("__t").alias("__et"), F.col("__pos").alias("__next"))
    link = stored(own.join(nxt, "__next").drop("__next"), "next")

    # both joins read this one exchange of the texts, so it has the same columns for both
    texts = base.select("__d", "__t", "text")
    doc_id = F.when(F.col("__d") != NO_ID, F.col("__d")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    # the next document's first characters travel to the document, not whole texts
    to = link.select(F.col("__ed").alias("__d"), F.col("__et").alias("__t"), F.col("__d").alias("__od"), F.col("__t").alias("__ot"), F.floor(F.col("n_chars") / 3).cast("int").alias("__take"))
    head = texts.join(to, ["__d", "__t"]).select(F.col("__od").alias("__d"), F.col("__ot").alias("__t"), "__take", F.col("text").substr(F.lit(1), F.col("__take")).alias("__head")).dropDuplicates(["__d", "__t"])
    both = texts.join(head, ["__d", "__t"]).select("__d", "__t", doc_id, F.length("text").cast("long").alias("n_chars"), "text", F.concat(F.col("text").substr(F.lit(1), (F.length("text") - F.col("__take")).cast("int")), F.col("__head")).alias("__edited"))
    both = both.withColumn("edited_sha256", F.sha2("__edited", 256))
    made = with_fingerprint(with_fingerprint(both, "text", "fingerprint").drop("text"), "__edited", "edited_fingerprint").drop("__edited")
    made = stored(made, "fingerprints")
    # of rows that repeat, one carries the fingerprint on
    of = made.select(F.col("__d").alias("__ed"), F.col("__t").alias("__et"), F.col("fingerprint").alias("__nf")).dropDuplicates(["__ed", "__et"])
    carried = link.join(of, ["__ed", "__et"]).select("__d", "__t", "__nf")
    return made.join(carried, ["__d", "__t"]).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "__nf").alias("near_next"))


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
