"""SimHash near-duplicates (operator 6).

Method: segment-popcount embedding.  A fingerprint's 16 segments of 4 bits are
mapped to their bit counts; each flipped bit moves one count by one, so the
Manhattan distance of two count vectors is at most the Hamming distance.  The
range join on the grid of count vectors meets in the middle: two vectors at a
distance of at most 2 share a grid point within 1 of both, so each distinct
fingerprint goes to its own point and its 32 neighbours (not to the 500-odd
points within 2), each time beside the bits of a block that was not moved.
What meets at a point is verified exactly by Hamming distance.  Equal fingerprints are one row throughout, so groups of copies cost
nothing here.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphsift.sources.shared import release
from glyphsift.sources.tables import table

from .common import bounded_batches, byte_column, drop_stored, identified, parallelism, rows_with_identity, stored, worker_store
from .components import apart, components

#: For joins whose sides grow out of small files (lists laid out in rows, columns of few values): Spark guesses sizes
#: by the files, would take such a side for small and gather all its rows in the driver.
UNGATHERED = "merge"

LOW = np.uint64(0x5555555555555555)
PAIR = np.uint64(0x3333333333333333)


def counts(fp: np.ndarray) -> np.ndarray:
    """Each nibble's bit count, in place of the nibble."""
    x = fp - (fp >> np.uint64(1) & LOW)
    return (x & PAIR) + (x >> np.uint64(2) & PAIR)


def simhash(hashes: np.ndarray, width: int = 64) -> np.ndarray:
    """Bits that are set in over half of the rows of ``hashes`` (n x width/64, big-endian uint64)."""
    total = np.zeros(width, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[a : a + (1 << 14)].view(np.uint8).reshape(-1, width // 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes)).view(">u8").astype(np.uint64)


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 (seed 42) of the lower-cased text's k-word shingles; of all words where there are fewer."""
    import xxhash

    ws = text.lower().split()
    if not ws:
        return []
    line = b" ".join(ws)
    if len(ws) <= k:
        return [xxhash.xxh64_intdigest(line, 42)]
    end = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    start = np.append(0, end[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(start[: len(ws) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)]


def _fingerprints(k: int):
    def f(batches):
        import pyarrow as pa

        worker_store("simhash")
        for batch in batches:
            raw, offs = byte_column(batch.column(1))
            fps = np.zeros(len(offs) - 1, np.uint64)
            for i in range(len(fps)):
                if h := shingle_hashes(raw[offs[i] : offs[i + 1]].tobytes(), k):
                    fps[i] = simhash(np.array(h, ">u8"))[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), pa.array(counts(fps).view(np.int64))], ["doc_id", "fp", "pv"])

    return f


#: Segments of each block; two flips leave one block as it is.
BLOCKS = (range(5), range(5, 10), range(10, 16))


def grid_points(pv: Column) -> Column:
    """``array<struct<at, block>>``: a count vector's own point and its neighbours at distance 1 (counts stay within 0 to 4), with the block moved (-1: none)."""
    at = lambda j: F.shiftrightunsigned(pv, j * 4).bitwiseAND(F.lit(15).cast("long"))
    block = {j: F.lit(b) for b, js in enumerate(BLOCKS) for j in js}
    up = [F.when(at(j) < 4, F.struct((pv + F.lit(1 << 4 * j).cast("long")).alias("at"), block[j].alias("block"))) for j in range(16)]
    down = [F.when(at(j) > 0, F.struct((pv - F.lit(1 << 4 * j).cast("long")).alias("at"), block[j].alias("block"))) for j in range(16)]
    return F.array_compact(F.array(F.struct(pv.alias("at"), F.lit(-1).alias("block")), *up, *down))


def links(fps: DataFrame) -> DataFrame:
    """``u, v``: distinct fingerprints (``fp``, with counts ``pv``) at Hamming distance 1 or 2.

    Points alone have about 30 bits, so chance meetings would grow with the
    square of the table.  Two flips touch two of three blocks at most: each
    point is met together with the bits of a block that its side has not moved,
    which adds 20 bits or more to the key and loses no pair.
    """
    masks = [sum(15 << 4 * j for j in js) for js in BLOCKS]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    point = fps.repartition(parallelism(fps.sparkSession), "fp").select("fp", F.explode(grid_points(F.col("pv"))).alias("__p"))
    keys = F.array_compact(F.array(*[F.when(F.col("__p.block") != b, F.xxhash64(F.lit(b), F.col("__p.at"), F.col("fp").bitwiseAND(F.lit(m).cast("long")))) for b, m in enumerate(masks)]))
    at = point.select("fp", F.explode(keys).alias("__at"))
    a, b = at.alias("a"), at.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= 2
    return a.join(b.hint(UNGATHERED), (F.col("a.__at") == F.col("b.__at")) & (F.col("a.fp") > F.col("b.fp")) & near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per input row.

    Null text counts as empty; texts without words have fingerprint zero and
    are linked to each other like any others.  Fingerprints link at 2 or fewer
    differing bits; ``component_id`` is the smallest ``doc_id`` that can be
    reached.  Repeated rows give repeated rows; an empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    each = stored(own.mapInArrow(_fingerprints(shingle), f"doc_id {kind}, fp long, pv long"), "simhash")
    distinct = stored(each.groupBy("fp").agg(F.min("pv").alias("pv"), F.min("doc_id").alias("least")), "distinct-simhash")
    of = components(links(distinct.select("fp", "pv")))
    rooted = distinct.join(of, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = stored(rooted.join(least, "root").select("fp", "component_id"), "named-simhash")
    return each.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The parity bits that a text carries into its buckets: all of them, laid over one another in so many longs.
FOLDS = ["__p0", "__p1", "__p2", "__p3"]
#: Texts in one bucket up to which its shingle counts as rare.
BUCKET = 64
#: Orders of texts, each of which names the first text of some buckets.
ORDERS = 8
#: Bits on which the parity of shingles is kept for each text.
PARITY = 1024


def _needed(n, similarity: float):
    """Smallest overlap with a set of ``n`` shingles that reaches the similarity."""
    return np.ceil(similarity * n - 1e-6).astype(np.int64)


def _prefix(n, similarity: float):
    """So many first shingles of each of two similar sets, in any common order, share one."""
    return n - _needed(n, similarity) + 1


def _spare(n, similarity: float):
    """Shingles beyond the prefix: two similar sets share so many more within both."""
    return _prefix(n, similarity) // 6 + 2


def _sketches(k: int, similarity: float):
    """``__d, __t, __n, __fp, __pv, __pre, __sure``: fingerprint with its bit counts, number of shingles, and the first of them by hash.

    ``__sure``: a similar text shares more than so many of ``__pre``.
    """

    def f(batches):
        import pyarrow as pa

        worker_store("simhash")
        for batch in batches:
            raw, offs = byte_column(batch.column(2))
            rows = len(offs) - 1
            fps, sizes, parts = np.zeros(rows, np.uint64), np.zeros(rows, np.int64), []
            for i in range(rows):
                h = np.array(shingle_hashes(raw[offs[i] : offs[i + 1]].tobytes(), k), ">u8")
                if len(h):
                    fps[i] = simhash(h)[0]
                    h = np.unique(h.astype(np.int64))
                sizes[i] = n = len(h)
                parts.append(h[: _prefix(n, similarity) + _spare(n, similarity)].astype(np.int64))
            least = _needed(sizes, similarity)
            sure = np.minimum(_spare(least, similarity), least - 1)
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(fps.view(np.int64)), pa.array(counts(fps).view(np.int64)), lists, pa.array(sure)], ["__d", "__t", "__n", "__fp", "__pv", "__pre", "__sure"])

    return f


def _shingle_sets(k: int):
    """``__t, __n, __set, __bits``: the distinct shingles of a text by hash.

    ``__bits``: for each of ``PARITY`` bits whether an odd number of shingles falls
    on it; two texts' bits differ in no more places than their sets have
    shingles that the other lacks.
    """

    def f(batches):
        import pyarrow as pa

        worker_store("simhash")
        for batch in batches:
            raw, offs = byte_column(batch.column(1))
            sets, bits = [], np.zeros((len(offs) - 1, PARITY // 64), np.int64)
            for i in range(len(offs) - 1):
                h = np.unique(np.array(shingle_hashes(raw[offs[i] : offs[i + 1]].tobytes(), k), np.uint64).astype(np.int64))
                sets.append(h)
                bits[i] = np.packbits((np.bincount(h & (PARITY - 1), minlength=PARITY) & 1).astype(np.uint8)).view(np.int64)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            each = (np.arange(len(sets) + 1) * (PARITY // 64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.ListArray.from_arrays(pa.array(each), pa.array(bits.reshape(-1)))], ["__t", "__n", "__set", "__bits"])

    return f


def _settled(df: DataFrame, name: str) -> DataFrame:
    """:func:`stored`, and the shuffle files that it took go at once: so two large steps never stand side by side on disk."""
    out = stored(df, name)
    for _ in range(2):  # the first only lets go of what holds the plan
        release(df.sparkSession)
    return out


def _verified(sets: DataFrame, close: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``u, v`` that have the similarity.

    Sizes and parity bits rule most others out before the sets are read: bit
    counts of the difference are a lower bound of the sets' difference.
    """
    bits = sets.select("__t", "__n", "__bits")
    of = lambda c, x: bits.select(F.col("__t").alias(c), F.col("__n").alias(f"__n{x}"), F.col("__bits").alias(f"__{x}"))
    differ = F.aggregate(F.zip_with("__a", "__b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    most = (F.col("__na") + F.col("__nb")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    sizes = F.least("__na", "__nb") >= similarity * F.greatest("__na", "__nb") - 1e-6
    maybe = close.join(of("u", "a"), "u").join(of("v", "b"), "v").where(sizes & (differ <= most)).select("u", "v")
    whole = lambda c, x: sets.select(F.col("__t").alias(c), F.col("__set").alias(x)).hint(UNGATHERED)
    both = maybe.join(whole("u", "__a"), "u").join(whole("v", "__b"), "v")
    common = F.size(F.array_intersect("__a", "__b"))
    return _settled(both.where(common / (F.size("__a") + F.size("__b") - common) >= similarity).select("u", "v"), "links")


def _possible(a, b, similarity: float) -> Column:
    """Whether two texts that meet in a bucket can have the similarity, by their sets' sizes and parity bits and the places there.

    Among texts of common shingles the bucket may be asked to be the first that
    the two share: each then has so few shingles before it that the rest can
    still be the overlap.
    """
    na, nb, i, j = a("__n"), b("__n"), a("__i"), b("__i")
    overlap = similarity / (1 + similarity) * (na + nb) - 1e-6
    sizes = F.least(na, nb) >= similarity * F.greatest(na, nb) - 1e-6
    later = F.least(na - i, nb - j)
    differ = sum((F.bit_count(a(c).bitwiseXOR(b(c))) for c in FOLDS), F.lit(0))
    return sizes & (differ <= na + nb - 2 * overlap) & F.when(a("__late"), (na - i >= overlap) & (nb - j >= overlap)).otherwise(F.least(i, j) + later >= overlap)


def _meetings(met: DataFrame, similarity: float) -> DataFrame:
    """Pairs of rows of different groups (``a``, ``b``) that meet in a bucket."""
    a, b = met.alias("a"), met.alias("b")
    of = lambda x: lambda c: F.col(f"{x}.{c}")
    # two texts of common shingles meet under their rarest ones
    fit = F.col("a.__late") | ~(F.col("a.__common") & F.col("b.__common"))
    return a.join(b.hint(UNGATHERED), (F.col("a.__m") == F.col("b.__m")) & (F.col("a.__r") < F.col("b.__r")) & fit & _possible(of("a"), of("b"), similarity))


def _stars(buckets: DataFrame, similarity: float) -> DataFrame:
    """``u, v``: each text of a bucket with the bucket's first, by one of ``ORDERS`` orders that the shingle picks.

    Copies that fail against one first text are held against those of the other orders.
    """
    first = buckets.groupBy("__m").agg(F.min(F.struct(F.xxhash64("__t", F.pmod("__m", F.lit(ORDERS))), "__t", "__n", "__i", "__late", *FOLDS)).alias("__f")).select(apart(F.col("__m")).alias("__at"), "__f")
    both = buckets.join(first.hint(UNGATHERED), (apart(F.col("__m")) == F.col("__at")) & (F.col("__t") != F.col("__f.__t")))
    return both.where(_possible(F.col, lambda c: F.col(f"__f.{c}"), similarity)).select(F.col("__t").alias("u"), F.col("__f.__t").alias("v")).distinct()


def _pairs(buckets: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """``u, v``: texts of different groups that meet in as many buckets as similar ones do."""
    of = components(links)
    own = stored(buckets.join(of, F.col("__t") == F.col("node"), "left").select("__m", "__t", "__n", "__i", "__need", "__late", "__common", *FOLDS, F.coalesce("root", "__t").alias("__r")), "grouped")
    apart_ = own.groupBy("__m").agg(F.min("__r").alias("__lo"), F.max("__r").alias("__hi")).where("__lo != __hi").select(apart(F.col("__m")).alias("__at"))
    met = _settled(own.join(apart_.hint(UNGATHERED), apart(F.col("__m")) == F.col("__at")).drop("__at"), "met")
    pairs = _meetings(met, similarity)
    pairs = pairs.groupBy(F.col("a.__t").alias("u"), F.col("b.__t").alias("v")).agg(F.count("*").alias("__c"), F.max(F.greatest("a.__need", "b.__need")).alias("__need"))
    out = _settled(pairs.where("__c >= __need").select("u", "v"), "pairs")
    drop_stored(own, met)
    return out


def _buckets(base: DataFrame, each: DataFrame, seeds: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``__m, __t, __n, __i, __late, __common, __need``: texts under the shingles by which each similar pair meets, and the sets of all texts in them or in ``seeds``.

    A text meets a similar one in ``__need`` buckets or more; ``__i``: the shingle's place in the order.
    ``__p0`` to ``__p3``: parity bits; ``__late``: a bucket of the second kind; ``__common``: a text that is in those.

    First all texts, under the first shingles by hash, with some to spare.
    Shingles of more than ``BUCKET`` texts are common.  A text with no more
    common ones than it has to spare shares a rare one with each similar text.
    The others are looked at among themselves with all their shingles, the
    rarest first, so common passages come last and hardly ever into a prefix.
    """
    rows = each.where("__n > 0").select("__t", "__n", "__sure", F.posexplode("__pre").alias("__i", "__m"))
    many = lambda xs: xs.groupBy("__m").agg(F.count("*").alias("__c")).where("__c > 1").select(apart(F.col("__m")).alias("__at"), "__c")
    shared = _settled(rows.join(many(rows).hint(UNGATHERED), apart(F.col("__m")) == F.col("__at")).drop("__at"), "shared-rows")
    often = stored(shared.where(F.col("__c") > BUCKET).groupBy("__t", "__sure").agg(F.count("*").alias("__k")), "common-counts")
    common = often.where("__k > __sure").select("__t")
    rare = shared.where(F.col("__c") <= BUCKET).join(often.select("__t", "__k"), "__t", "left")
    rare = rare.select("__m", "__t", "__n", "__i", F.lit(False).alias("__late"), (F.coalesce("__k", F.lit(0)) > F.col("__sure")).alias("__common"), F.greatest(F.lit(1), F.col("__sure") + 1 - F.coalesce("__k", F.lit(0))).cast("long").alias("__need"))
    # a text that shares fewer rare shingles than that with all others together has no similar one
    rare = stored(rare.withColumn("__all", F.count("*").over(Window.partitionBy("__t"))).where("__all >= __need").drop("__all"), "rare-rows")
    wanted = stored(rare.select("__t").unionByName(common).unionByName(seeds.select(F.col("u").alias("__t"))).unionByName(seeds.select(F.col("v").alias("__t"))).distinct().join(each.select("__t", "__d"), "__t"), "wanted")
    # one row of each text: the keys are as many as the texts, whatever number of copies they have
    sets = _settled(base.join(wanted, ["__d", "__t"]).dropDuplicates(["__d", "__t"]).select("__t", "text").mapInArrow(_shingle_sets(shingle), "__t long, __n long, __set array<long>, __bits array<long>"), "shingle-sets")
    drop_stored(wanted)

    folds = sets.select("__t", *[reduce(Column.bitwiseXOR, [F.get("__bits", F.lit(j)) for j in range(k, PARITY // 64, len(FOLDS))]).alias(c) for k, c in enumerate(FOLDS)])
    rows = sets.join(common, "__t", "left_semi").select("__t", "__n", F.explode("__set").alias("__m"))
    own = Window.partitionBy("__t")
    # what only one text has comes first and leads nowhere
    placed = rows.join(many(rows).hint(UNGATHERED), apart(F.col("__m")) == F.col("__at")).withColumn("__i", (F.col("__n") - F.count("*").over(own) + F.row_number().over(own.orderBy("__c", "__m")) - 1).cast("int"))
    # keys apart from those of the first kind
    late = placed.where(F.col("__i") <= F.col("__n") - F.ceil(similarity * F.col("__n") - 1e-6)).select(F.xxhash64("__m", F.lit(2)).alias("__m"), "__t", "__n", "__i", F.lit(True).alias("__late"), F.lit(True).alias("__common"), F.lit(1).cast("long").alias("__need"))
    out = _settled(rare.unionByName(late).join(folds, "__t"), "buckets")
    drop_stored(shared, often, rare)
    return out, sets


def similar_links(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``u, v``: hashes of different texts whose ``shingle``-word sets have a Jaccard similarity of ``similarity`` or more.

    What the links connect is what all pairs of that similarity connect; pairs
    within a group that other links connect already are not looked at.  Texts
    without words are alike.

    Close copies are found by this operator's fingerprints on the grid of bit
    counts.  Texts at a similarity of 0.8 differ by about 9 of 64 bits, where a grid
    of counts rules nothing out; so the rest is found, exactly, by shingles:
    every similar pair meets in :func:`_buckets`.  Texts are compared with the
    first text of each of their buckets, and then all pairs that are in different
    groups still and meet often enough, unless sizes, the shingle's places or
    parity bits rule a pair out.  Each link is verified on the sets.
    """
    bounded_batches(docs.sparkSession)
    base = identified(docs).select("__d", "__t", "text")
    found = base.mapInArrow(_sketches(shingle, similarity), "__d long, __t long, __n long, __fp long, __pv long, __pre array<long>, __sure long")
    names = ["__n", "__fp", "__pv", "__pre", "__sure"]
    each = _settled(found.groupBy("__t").agg(F.min("__d").alias("__d"), *[F.first(c).alias(c) for c in names]), "sketches")

    worded = each.where("__n > 0")
    prints = stored(worded.groupBy("__fp").agg(F.min("__pv").alias("pv"), F.min("__t").alias("__v")).withColumnRenamed("__fp", "fp"), "prints")
    same = worded.join(prints, F.col("__fp") == F.col("fp")).where("__t != __v").select(F.col("__t").alias("u"), F.col("__v").alias("v"))
    text = lambda c: prints.select(F.col("fp").alias(c), F.col("__v").alias(f"__{c}"))
    near = links(prints.select("fp", "pv")).join(text("u"), "u").join(text("v"), "v").select(F.col("__u").alias("u"), F.col("__v").alias("v"))
    seeds = _settled(same.unionByName(near), "seeds")
    buckets, sets = _buckets(base, each, seeds, shingle, similarity)
    none = each.where("__n = 0")
    empty = none.crossJoin(none.agg(F.min("__t").alias("v"))).where("__t != v").select(F.col("__t").alias("u"), "v")  # one row
    out = stored(empty.unionByName(_verified(sets, _settled(seeds.unionByName(_stars(buckets, similarity)).distinct(), "stars"), similarity)), "links")
    out = stored(out.unionByName(_verified(sets, _pairs(buckets, out, similarity), similarity)), "similar-links")
    drop_stored(each, prints, seeds, buckets, sets)
    return out


def distinct_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of copies and near copies: that of the smallest ``doc_id``.

    A group is what links of :func:`similar_links` connect; equal texts (null
    counts as empty) are one group.  All columns of ``docs`` are returned.
    """
    rows = identified(docs).groupBy("__t").agg(F.min("__d").alias("__d"))
    of = components(similar_links(docs, shingle, similarity))
    keep = rows.join(of, F.col("__t") == F.col("node"), "left").groupBy(F.coalesce("root", "__t").alias("__root")).agg(F.min(F.struct("__d", "__t")).alias("__k")).select("__k.*")
    own = rows_with_identity(docs)
    return own.join(stored(keep, "kept-documents"), ["__d", "__t"], "left_semi").dropDuplicates(["__d", "__t"]).select("__row.*")
