"""Reading the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; one that makes few scan tasks is dealt out over the cores.

    A small table is often one file of one row group, which one task would have
    to work on alone.  How many tasks the scan has is asked of its plan, which
    goes by bytes and not by files, so nothing large is shuffled.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
