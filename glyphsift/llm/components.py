"""Connected components by alternating stars.

A node's smallest neighbour comes from a pre-aggregated minimum.  It is joined
under a key of its own (``apart``), so both sides of the join are dealt out
anew and Spark can split the edges of a node that has very many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_stored, stored


def apart(key: Column) -> Column:
    """A key as good as ``key`` whose partitioning Spark doesn't take for that of an aggregate."""
    return key.bitwiseXOR(F.lit(0x5BD1E995).cast("long"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over ``u > v`` edges: link each node's larger (or smaller) neighbours to its smallest."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("__m")).select(apart(F.col("u")).alias("__u"), F.least("u", "__m").alias("__m"))
    joined = both.join(least, apart(F.col("u")) == F.col("__u"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("__m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("__m").alias("v")), F.struct("u", F.col("__m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each linked node's component.

    edges: ``u, v`` (long), in either direction, repeats and loops allowed.
    Nodes without a link to another one are not returned; no edges give no rows.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    mark = None
    while True:
        large = stored(_star(now, True), "edges")
        seen = Observation()
        nxt = stored(_star(large, False).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
        drop_stored(now, large)
        now = nxt
        if seen.get == mark or not seen.get["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen.get
