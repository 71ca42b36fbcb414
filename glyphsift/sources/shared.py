"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds after which the shuffle files of plans that are done may go.
RELEASE_EVERY = 10
_released = 0.0


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on one machine without that setting a folder in /tmp.

    On a cluster executors would not see each other's /tmp, so there the setting
    is required.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir")
    set_now = sc._jsc.sc().getCheckpointDir()
    if set_now.isEmpty():
        if not found and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or "/tmp/checkpoints/glyphsift")
    return (found or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but compressed and by column, and
    survives the loss of any executor.
    """
    global _released
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if time.monotonic() - _released > RELEASE_EVERY:
        release(spark)
        _released = time.monotonic()
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables made by :func:`stored` that nothing will read again."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
