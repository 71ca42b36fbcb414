"""Helpers shared by the training-data operators.

Every operator narrows its input to the columns it names before it adds any of
its own (all of them start with ``__``), so extra columns with clashing names
never reach a plan.  Row identity is ``(doc_id, xxhash64(text))``: rows that
repeat both are equal documents and get equal results.
"""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsift.sources.shared import drop_stored, shared_dir, stored  # noqa: F401

#: The white space that separates words in the contracts: space and \t \n \v \f \r.
WS = "[\\x20\\x09-\\x0D]+"
NOT_WS = "[^\\x20\\x09-\\x0D]+"
NO_ID = -(2**63)


def identified(docs: DataFrame, *more: str, text: str = "text") -> DataFrame:
    """``__d``, ``__t`` (row identity), ``doc_id``, ``text`` and the columns named."""
    return docs.select(
        F.col("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(c) for c in more]
    ).withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__t": F.xxhash64("text")})


def rows_with_identity(docs: DataFrame) -> DataFrame:
    """``__row`` (all columns of ``docs``, whatever their names), ``__d`` and ``__t``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    return docs.select(whole, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__d"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("__t"))


def words(text: Column) -> Column:
    """White-space separated words, in order; no empty ones."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def byte_column(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary array, without a copy, and its n + 1 offsets."""
    import pyarrow as pa

    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(array) else np.zeros(0, np.uint8)
    return raw, offs - (offs[0] if len(offs) else 0)


def pieces(offs: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    i = 0
    while i < len(offs) - 1:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j
        i = j


#: Rows of whole texts in one Arrow batch, which stands in the executor's and the worker's memory at once.
BATCH_ROWS = 4000


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's 10,000 rows, for plans that carry whole texts to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


#: What operators keep in a Python worker between tasks, by operator.
_worker: dict[str, dict] = {}


def give_back() -> None:
    """What this worker has freed goes back to the system; Arrow and the C library keep it otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def worker_store(name: str) -> dict:
    """The store of one operator in this worker; those of other operators go.

    Spark hands a worker on from stage to stage, so what an earlier stage kept
    would otherwise stand beside what this one needs.
    """
    others = [k for k in _worker if k != name]
    for k in others:
        del _worker[k]
    if others:
        gc.collect()
        give_back()
    return _worker.setdefault(name, {})


def ordered(df: DataFrame, keys: list, value: str | None = None, name: str = "ordered") -> DataFrame:
    """``df`` with ``__pos`` (0-based rank by ``keys``) and, for ``value``, ``__before`` (its sum over the rows before).

    Rows are dealt out by range and ranked within their part; the parts' totals
    (one row for each) are then summed up.  No task sees more than one part.
    """
    from pyspark.sql.window import Window

    amount = F.col(value) if value else F.lit(0)
    dealt = df.repartitionByRange(parallelism(df.sparkSession), *keys).withColumn("__part", F.spark_partition_id())
    dealt = stored(dealt, name)
    within = Window.partitionBy("__part").orderBy(*keys)
    totals = dealt.groupBy("__part").agg(F.count("*").alias("__n"), F.sum(amount).alias("__v"))
    w = Window.orderBy("__part")  # one row for each part
    before = totals.select(F.col("__part"), (F.sum("__n").over(w) - F.col("__n")).alias("__n0"), (F.sum("__v").over(w) - F.col("__v")).alias("__v0"))
    ranked = dealt.withColumn("__rn", F.row_number().over(within) - 1)
    if value:
        ranked = ranked.withColumn("__run", F.coalesce(F.sum(amount).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = ranked.join(before, "__part").withColumn("__pos", F.col("__n0") + F.col("__rn"))
    if value:
        out = out.withColumn("__before", F.col("__v0") + F.col("__run")).drop("__run")
    return out.drop("__part", "__n0", "__v0", "__rn")
