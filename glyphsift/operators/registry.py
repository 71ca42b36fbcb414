"""Model registry: the largest model that fits a memory budget, else the smallest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Own invented entries: function, name, billions of parameters, context.
MODELS = [("chat", "tiny", 1.0, 4096), ("chat", "small", 3.0, 8192), ("chat", "medium", 7.0, 8192), ("chat", "large", 14.0, 16384), ("embed", "mini", 0.1, 512), ("embed", "base", 0.4, 8192)]


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "function string, name string, params double, context int")


def vram_mb(params: Column, context: Column) -> Column:
    """620 MB a billion parameters, 1500 MB besides, a tenth of a MB for each place of context."""
    return (620 * params + 1500 + 0.10 * context).cast("int")


def select_for(table: DataFrame, budgets: DataFrame) -> DataFrame:
    """``function, budget, name, fits``: the best of each function for each budget (MB)."""
    need = table.withColumn("need", vram_mb(F.col("params"), F.col("context")))
    grid = need.crossJoin(budgets)  # two small parameter tables
    fits = F.col("need") <= F.col("budget")
    best = grid.groupBy("function", "budget").agg(F.max(F.when(fits, F.struct("params", "name"))).alias("__b"), F.min(F.struct("params", "name")).alias("__s"))
    return best.select("function", "budget", F.coalesce("__b.name", "__s.name").alias("name"), F.col("__b").isNotNull().alias("fits"))
