"""Mixing sources to target weights (operator 4).  DataFrame functions only.

Method: a low-discrepancy source schedule.  Slot t of the mix has the golden
ratio point frac(t * phi); the sources' cumulative shares of the slots cut
[0, 1) into intervals, and the interval that holds the point gives the slot's
source.  A source's documents in the order of a hash make a stream of words that
is cut into blocks of equal size; it may be read MOST times, each time with its
blocks in another shuffled order, and the k-th slot of a source takes the k-th
of these blocks.  What a document gives to the mix are its parts of the blocks
that were dealt; nothing else is taken.  Points fill every interval evenly, so
each prefix of the mix has the shares wanted, and a source misses its target by
a few blocks at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphsift.sources.tables import table

from .common import NO_ID, NOT_WS, ordered, rows_with_identity, stored

PHI = (math.sqrt(5) - 1) / 2
MOST = 3


def golden(slot: Column) -> Column:
    """frac(slot * PHI), split so that large slot numbers keep their fraction."""
    step = 1 << 20
    high = (slot / step).cast("long").cast("double") * (PHI * step % 1)
    low = F.pmod(slot, F.lit(step)).cast("double") * PHI
    both = (high - F.floor(high)) + (low - F.floor(low))
    return both - F.floor(both)


def source_targets(sizes: DataFrame) -> DataFrame:
    """``__source, __pos, __w, source_size, target``: weights 1, 2, 3 by the order of the sources' names, null last.

    The share of a source that would exceed MOST times its size is cut there
    and the rest dealt out anew by weight, until none exceeds it.
    """
    sums = sizes.groupBy("__source").agg(F.sum("size").alias("source_size"))
    named = ordered(sums, [F.col("__source").isNull(), F.col("__source")], name="sources")
    sources = stored(named.withColumn("__w", 1 + F.pmod("__pos", F.lit(3))), "weights")
    cap, level = MOST * F.col("source_size"), 0.0
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = cap <= level * F.col("__w")
        done = sources.agg(F.sum(F.when(full, cap)).alias("cut"), F.sum(F.when(~full, F.col("__w"))).alias("w")).first()
        nxt = (whole - (done["cut"] or 0)) / done["w"] if done["w"] else level
        if nxt <= level:
            break
        level = nxt
    return sources.withColumn("target", F.least(cap.cast("double"), level * F.col("__w")))


def van_der_corput(slot: Column) -> Column:
    """The slot number's bits mirrored at the point: another sequence that fills [0, 1) evenly."""
    return F.conv(F.reverse(F.lpad(F.bin(slot), 52, "0")), 2, 10).cast("double") / F.lit(float(1 << 52))


def blocks_of(targets: DataFrame, slots_per_source: int) -> DataFrame:
    """``targets`` with the words of a block (``__size``), blocks (``__blocks``) and slots wanted (``__slots``) of each source."""
    have = targets.agg(F.count("*").alias("n"), F.sum("source_size").alias("words")).first()
    even = max(1, (have["words"] or 0) // max(1, slots_per_source * have["n"]))
    # small sources get smaller blocks, so that a block more or less is little of any source
    size = F.greatest(F.lit(1), F.least(F.lit(even), F.expr(f"source_size div {max(1, slots_per_source // 4)}"))).cast("long")
    out = targets.where("source_size > 0").withColumn("__size", size)
    out = out.withColumn("__blocks", F.expr("(source_size + __size - 1) div __size"))
    return out.withColumn("__slots", F.col("target") / (F.col("source_size") / F.col("__blocks")))


def schedule(blocks: DataFrame, points: Callable[[Column], Column] = golden) -> DataFrame:
    """``__pos, __k, slot``: the source of each slot, and which of the source's slots it is."""
    spark = blocks.sparkSession
    run = stored(ordered(blocks.select(F.col("__pos").alias("__src"), "__slots"), [F.col("__src")], "__slots", "shares"), "shares")
    have = run.agg(F.count("*").alias("n"), F.sum("__slots").alias("s"), F.max("__src").alias("last")).first()
    total = float(have["s"] or 1)
    slots, cells = round(have["s"] or 0), max(64, have["n"])
    lo = F.col("__before") / total
    hi = F.when(F.col("__src") == have["last"], F.lit(1.0)).otherwise((F.col("__before") + F.col("__slots")) / total)
    parts = run.select(F.col("__src").alias("__pos"), lo.alias("__lo"), hi.alias("__hi"))
    parts = parts.where("__lo < __hi").withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__lo") * cells), F.floor(F.col("__hi") * cells))))
    dealt = spark.range(slots).select(F.col("id").alias("slot"), points(F.col("id") + 1).alias("__g")).withColumn("__cell", F.floor(F.col("__g") * cells))
    hit = dealt.join(parts, "__cell").where("__lo <= __g and __g < __hi").select("__pos", "slot", (F.col("slot") / 4096).cast("long").alias("__chunk"))
    # ranks within a source: within runs of slots, then over the runs
    hit = hit.withColumn("__rn", F.row_number().over(Window.partitionBy("__pos", "__chunk").orderBy("slot")) - 1)
    chunks = hit.groupBy("__pos", "__chunk").agg(F.count("*").alias("__n"))
    first = chunks.select("__pos", "__chunk", (F.sum("__n").over(Window.partitionBy("__pos").orderBy("__chunk")) - F.col("__n")).alias("__first"))
    return hit.join(first, ["__pos", "__chunk"]).select("__pos", (F.col("__first") + F.col("__rn")).alias("__k"), "slot")


def shuffled_blocks(blocks: DataFrame) -> DataFrame:
    """``__pos, __k, __b``: the block that a source's k-th slot takes; each pass over the stream has an order of its own."""
    own = blocks.select(F.col("__pos").alias("__src"), "__blocks", F.explode(F.array(*map(F.lit, range(MOST)))).alias("__pass"))
    own = own.select("__src", "__pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)).alias("__b"))
    placed = ordered(own, [F.col("__src"), F.col("__pass"), F.xxhash64(F.lit(23), "__src", "__pass", "__b"), F.col("__b")], name="blocks")
    before = ordered(blocks.select(F.col("__pos").alias("__at"), (MOST * F.col("__blocks")).alias("__all")), [F.col("__at")], "__all", "block-counts")
    return placed.join(before.select("__at", "__before"), F.col("__src") == F.col("__at")).select(F.col("__src").alias("__pos"), (F.col("__pos") - F.col("__before")).alias("__k"), "__b")


def mix(docs: DataFrame, slots_per_source: int = 1024, points: Callable[[Column], Column] = golden) -> DataFrame:
    """``__d, __t, doc_id, size, source_size, target, taken, slot``, one row per input row.

    ``size``: white-space separated words of the whole text (null: 0).  A null
    source is a source of its own, last in order.  ``slot``: the first slot of the
    mix that takes from the document (null: none does).  Documents without words
    are never taken; an empty table gives no rows; rows that repeat are documents
    of their own.  The order depends on ``doc_id`` and text alone, so reruns agree.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = docs.select("doc_id", F.col("source").alias("__source"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__d"), F.xxhash64(text).alias("__t"), F.regexp_count(text, F.lit(NOT_WS)).cast("long").alias("size"))
    sizes = stored(sizes, "sizes")
    targets = stored(source_targets(sizes), "targets")
    rows = sizes.join(targets.select(F.col("__source").alias("__s"), "__pos", "source_size", "target"), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s", "__source")
    # the streams: about sqrt(n) shards of sqrt(n) documents, so that no source is one task's
    n = sizes.count()
    order = F.xxhash64(F.lit(17), "__d", "__t")
    rows = rows.withColumns({"__h": order, "__shard": F.pmod(order, F.lit(math.isqrt(n) + 1))})
    rows = rows.withColumn("__in", F.coalesce(F.sum("size").over(Window.partitionBy("__pos", "__shard").orderBy("__h", "__d", "__t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = stored(rows, "streams")
    shards = rows.groupBy("__pos", "__shard").agg(F.sum("size").alias("__n"))
    begin = shards.select("__pos", "__shard", (F.sum("__n").over(Window.partitionBy("__pos").orderBy("__shard")) - F.col("__n")).alias("__off"))
    rows = stored(rows.join(begin, ["__pos", "__shard"]).withColumn("__a", F.col("__off") + F.col("__in")).drop("__h", "__shard", "__off", "__in"), "places")

    blocks = stored(blocks_of(targets, slots_per_source), "source-blocks")
    plan = shuffled_blocks(blocks).join(schedule(blocks, points), ["__pos", "__k"])
    plan = plan.groupBy("__pos", "__b").agg(F.count("*").alias("__times"), F.min("slot").alias("slot"))
    worded = rows.where("size > 0").join(blocks.select("__pos", "__size"), "__pos")
    pieces = worded.select("__pos", "__a", "size", "__size", F.explode(F.sequence(F.expr("__a div __size"), F.expr("(__a + size - 1) div __size"))).alias("__b"))
    part = F.least(F.col("__a") + F.col("size"), (F.col("__b") + 1) * F.col("__size")) - F.greatest(F.col("__a"), F.col("__b") * F.col("__size"))
    used = pieces.join(plan, ["__pos", "__b"]).groupBy("__pos", "__a").agg(F.sum(part * F.col("__times")).alias("taken"), F.min("slot").alias("slot"))
    used = used.select(F.col("__pos").alias("__p"), F.col("__a").alias("__s"), "taken", "slot")
    # words > 0: (source, place) names one row
    joined = rows.join(used, (F.col("size") > 0) & (F.col("__pos") == F.col("__p")) & (F.col("__a") == F.col("__s")), "left")
    return joined.select("__d", "__t", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "slot")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes their whole text, to the nearest."""
    taken = mix(docs).where("size > 0").groupBy("__d", "__t").agg(F.sum("taken").alias("__taken"), F.sum("size").alias("__size"))
    copies = F.floor(F.col("__taken") / F.col("__size") + 0.5).cast("int")
    kept = taken.select("__d", "__t", copies.alias("__copies")).where("__copies > 0")
    return rows_with_identity(docs).join(kept, ["__d", "__t"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("__d", "__t")
