"""Choice matrices: partition estimates, steal-and-test with a permutation null, bootstrap calibration."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphsift.operators.keyless import bootstrap_weights, draw
from glyphsift.sources.shared import stored


def estimate_partition(choices: DataFrame, k: int, margin: float = 0.15) -> DataFrame:
    """``slot, variant``: cells used more often than an even choice with a margin."""
    cell = choices.groupBy("slot", "variant").agg(F.count("*").alias("__n"))
    n = cell.groupBy("slot").agg(F.sum("__n").alias("__s"))
    return cell.join(n, "slot").where(F.col("__n") / F.col("__s") > (1 + margin) / k).select("slot", "variant")


def gamma_of(green: DataFrame, k: int, n_slots: int) -> DataFrame:
    return green.agg((F.count("*") / F.lit(k * n_slots)).alias("gamma"))


def _z(hits: Column, n: Column, gamma: Column) -> Column:
    return F.when((gamma > 0) & (gamma < 1) & (n > 0), (hits - gamma * n) / F.sqrt(F.greatest(n, F.lit(1)) * gamma * (1 - gamma))).otherwise(0.0)


def aggregate_z(choices: DataFrame, green: DataFrame, k: int, n_slots: int) -> DataFrame:
    """``hits, n, gamma, z``."""
    hit = choices.join(green.withColumn("__g", F.lit(1)), ["slot", "variant"], "left")
    return hit.agg(F.sum(F.coalesce("__g", F.lit(0))).alias("hits"), F.count("*").alias("n")).crossJoin(gamma_of(green, k, n_slots)).withColumn("z", _z(F.col("hits"), F.col("n"), F.col("gamma")))


def steal_and_test(choices: DataFrame, k: int, n_slots: int, margin: float = 0.15, permutations: int = 300, split: float = 0.5, alpha: float = 0.05, seed: str = "partition") -> DataFrame:
    """``z, null_mean, gap, p, detected``: partition from one part, tested on the other against slots dealt anew.

    The test part is counted once to slots x k cells; a permutation moves green
    cells to other slots and adds up counts, so samples are read once.
    """
    ranked = choices.withColumn("__test", draw(seed, "split", F.col("sample_id")) >= F.lit(split * 4294967296.0))
    green = estimate_partition(ranked.where("not __test"), k, margin)
    cells = ranked.where("__test").groupBy("slot", "variant").agg(F.count("*").alias("__n"))
    spark = choices.sparkSession
    slots = spark.range(n_slots).select(F.col("id").cast("int").alias("slot"))
    deals = slots.crossJoin(spark.range(permutations).select(F.col("id").alias("__p")))  # parameters, not data
    to = deals.select("__p", "slot", (F.row_number().over(Window.partitionBy("__p").orderBy(draw(seed, F.col("__p"), F.col("slot")), "slot")) - 1).alias("__to"))
    moved = green.join(to, "slot").select("__p", F.col("__to").alias("slot"), "variant")
    null = moved.join(cells, ["slot", "variant"]).groupBy("__p").agg(F.sum("__n").alias("__h"))
    null = spark.range(permutations).select(F.col("id").alias("__p")).join(null, "__p", "left").select(F.coalesce("__h", F.lit(0)).alias("__h"))
    real = cells.join(green, ["slot", "variant"]).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__real")).crossJoin(cells.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__n"))).crossJoin(gamma_of(green, k, n_slots))
    zs = null.crossJoin(real).select(_z(F.col("__h"), F.col("__n"), F.col("gamma")).alias("__z"), _z(F.col("__real"), F.col("__n"), F.col("gamma")).alias("z"))
    out = zs.groupBy("z").agg(F.avg("__z").alias("null_mean"), ((F.sum((F.col("__z") >= F.col("z")).cast("int")) + 1) / (F.count("*") + 1)).alias("p"))
    return out.withColumn("gap", F.col("z") - F.col("null_mean")).withColumn("detected", F.col("p") <= alpha)


#: Sums that a task holds of its draws before it hands them on, each a vector over the draws.
HELD = 20_000


def _drawn_cells(tag: str, n_boot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``source, b, slot, variant, s, t`` from ``source, __id, __x``: what each draw takes of each cell, added up within a task.

    Weights of the draws times choices of the samples, as one product of
    matrices for each batch and source: no row is made for a draw of a sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        schema = []

        def given() -> Iterator[pa.RecordBatch]:
            for (source, slot, variant), sums in held.items():
                b = np.flatnonzero(sums[0] + sums[1])
                if len(b):
                    columns = [[source] * len(b), b.astype(np.int32), [slot] * len(b), [variant] * len(b), sums[0, b], sums[1, b]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f) for c, f in zip(columns, schema, strict=True)], names=["source", "b", "slot", "variant", "s", "t"])
            held.clear()

        for batch in batches:
            x = batch.column("__x")
            at, flat = np.repeat(np.arange(batch.num_rows), x.value_lengths().to_numpy()), x.flatten()
            slot, variant = flat.field("slot").to_numpy(zero_copy_only=False), flat.field("variant").to_numpy(zero_copy_only=False)
            schema = [batch.schema.field("source").type, pa.int32(), flat.type.field("slot").type, flat.type.field("variant").type, pa.int64(), pa.int64()]
            sources = batch.column("source").to_pylist()
            number = {v: i for i, v in enumerate(dict.fromkeys(sources))}
            of = np.array([number[v] for v in sources])
            weights = np.stack(bootstrap_weights(tag, batch.column("__id").to_pylist(), n_boot)).astype(np.float64)
            cells, col = np.unique(np.stack([slot, variant]), axis=1, return_inverse=True)
            for source, i in number.items():
                mine = np.flatnonzero(of == i)
                here = np.isin(at, mine)
                choices = np.zeros((len(mine), cells.shape[1]))
                np.add.at(choices, (np.searchsorted(mine, at[here]), col.ravel()[here]), 1)
                sums = (weights[:, :, mine] @ choices).astype(np.int64)  # whole numbers
                for c in np.flatnonzero(choices.any(axis=0)):
                    key = (source, int(cells[0, c]), int(cells[1, c]))
                    held[key] = held[key] + sums[:, :, c] if key in held else sums[:, :, c].copy()
            if len(held) > HELD:
                yield from given()
        yield from given()

    return run


def bootstrap_gaps(choices: DataFrame, k: int, n_slots: int, n_boot: int = 120, permutations: int = 60, margin: float = 0.15, seed: int = 0, source: str | None = "reference") -> DataFrame:
    """``source, b, gap``: steal-and-test gaps of samples drawn with replacement, as one group-by.

    ``source``: the name of the corpus, or null if ``choices`` has a column
    ``source`` of several.  Each draw weighs a sample by two hashes (see
    ``keyless.poisson_half``); what it takes is added up to slots x k cells within
    the tasks, and the slots are permuted among those cells.  Corpora of less than four samples,
    or with one slot, give gaps of 0.
    """
    tag, spark = f"boot{seed}", choices.sparkSession
    named = choices if source is None else choices.withColumn("source", F.lit(source))
    # a sample has n_slots choices at most
    packed = named.groupBy("source", "sample_id").agg(F.collect_list(F.struct("slot", "variant")).alias("__x"))
    kinds = {f.name: f.dataType.simpleString() for f in named.schema}
    sums = packed.select("source", F.col("sample_id").cast("string").alias("__id"), "__x").mapInArrow(_drawn_cells(tag, n_boot), f"source {kinds['source']}, b int, slot {kinds['slot']}, variant {kinds['variant']}, s long, t long")
    cells = sums.groupBy("source", "b", "slot", "variant").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    of, cells = ["source", "b"], stored(cells, "bootstrap-cells")
    cells = cells.join(cells.groupBy(*of, "slot").agg(F.sum("s").alias("__all")), [*of, "slot"]).withColumn("green", F.coalesce(F.col("s") / F.nullif("__all", F.lit(0)) > (1 + margin) / k, F.lit(False)))
    one = cells.groupBy(*of).agg((F.sum(F.col("green").cast("int")) / F.lit(k * n_slots)).alias("gamma"), F.sum("t").alias("__n"), F.sum(F.when(F.col("green"), F.col("t")).otherwise(0)).alias("__h"))
    slots = spark.range(n_slots).select(F.col("id").cast("int").alias("slot"))
    grid = slots.crossJoin(spark.range(permutations).select(F.col("id").alias("__p"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))  # parameters, not data
    to = grid.select("b", "__p", "slot", (F.row_number().over(Window.partitionBy("b", "__p").orderBy(draw(tag, F.col("b"), F.col("__p"), F.col("slot")), "slot")) - 1).alias("__to"))
    moved = cells.where("green").select(*of, "slot", "variant").join(to, ["b", "slot"]).select(*of, "__p", F.col("__to").alias("slot"), "variant")
    null = moved.join(cells.select(*of, "slot", "variant", "t"), [*of, "slot", "variant"]).groupBy(*of, "__p").agg(F.sum("t").alias("__nh"))
    # permutations that meet nothing count with no hit
    sums = one.withColumn("__p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(permutations - 1).cast("long")))).join(null, [*of, "__p"], "left")
    sums = sums.withColumns({"__z": _z(F.col("__h"), F.col("__n"), F.col("gamma")), "__nz": _z(F.coalesce("__nh", F.lit(0)), F.col("__n"), F.col("gamma"))})
    gaps = sums.groupBy(*of).agg((F.first("__z") - F.avg("__nz")).alias("__gap"))
    enough = packed.groupBy("source").agg((F.count("*") >= 4).alias("__ok"))
    draws = enough.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    fine = F.col("__ok") & F.lit(n_slots >= 2)
    return draws.join(gaps, of, "left").select("source", "b", F.when(fine, F.coalesce("__gap", F.lit(0.0))).otherwise(0.0).alias("gap"))


def style_baseline(gaps: DataFrame) -> DataFrame:
    """``n, mean, stdev, p50, p90, p95, max`` of bootstrap gaps; quantiles by index into the sorted gaps.

    The list has one number for each bootstrap draw.
    """
    at = lambda q: F.get("__g", F.least(F.size("__g") - 1, F.floor(F.lit(q) * F.size("__g")).cast("int")))
    return gaps.agg(F.sort_array(F.collect_list("gap")).alias("__g"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("stdev"), F.max("gap").alias("max")).select(F.size("__g").alias("n"), "mean", "stdev", at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"), "max")


def score_against_baseline(gaps: DataFrame, candidate: float, alpha: float = 0.05) -> DataFrame:
    """``gap, fpr, exceeds``: the empirical rate at which references reach the candidate's gap (1 without references)."""
    return gaps.agg(((F.coalesce(F.sum((F.col("gap") >= candidate).cast("int")), F.lit(0)) + 1) / (F.count("*") + 1)).alias("fpr")).select(F.lit(candidate).alias("gap"), "fpr", (F.col("fpr") <= alpha).alias("exceeds"))


# -- arena -------------------------------------------------------------------------------------


def keyed_partition(spark: SparkSession, key: str, n_slots: int, k: int, gamma: float = 0.4) -> DataFrame:
    """``slot, variant, green``: the hidden partition of a key."""
    cells = spark.range(n_slots * k).select(F.floor(F.col("id") / k).cast("int").alias("slot"), F.pmod("id", F.lit(k)).cast("int").alias("variant"))
    return cells.withColumn("green", draw(key, F.col("slot"), F.col("variant")) < F.lit(gamma * 4294967296.0))


def arena_samples(partition: DataFrame, n: int, delta: float, seed: str, style: float = 1.6) -> DataFrame:
    """``sample_id, slot, variant``: choices by inverse distribution; green cells weigh e^delta more (0: control)."""
    weight = F.pow(F.lit(style), -F.col("variant")) * F.when(F.col("green"), F.lit(math.exp(delta))).otherwise(F.lit(1.0))
    w = Window.partitionBy("slot").orderBy("variant")
    cdf = partition.withColumn("__w", weight).withColumn("__hi", F.sum("__w").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    slots = cdf.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("__hi", "variant"))).alias("__c"), F.sum("__w").alias("__all"))
    samples = partition.sparkSession.range(n).select(F.col("id").alias("sample_id"))
    u = draw(seed, F.col("sample_id"), F.col("slot")) / 4294967296.0
    picked = slots.crossJoin(samples).withColumn("__u", u * F.col("__all"))  # a grid of parameters
    return picked.select("sample_id", "slot", F.coalesce(F.get(F.filter("__c", lambda c: c["__hi"] > F.col("__u")), F.lit(0))["variant"], F.lit(0)).alias("variant"))


def partition_recovery(green: DataFrame, partition: DataFrame) -> DataFrame:
    """``recovery``: share of cells whose estimate is right."""
    joined = partition.join(green.withColumn("__g", F.lit(True)), ["slot", "variant"], "left")
    return joined.agg(F.avg((F.coalesce("__g", F.lit(False)) == F.col("green")).cast("double")).alias("recovery"))
