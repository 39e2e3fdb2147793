"""The row before, over a key's whole history, without one task per key.

Rows are dealt out by ranges of (key, order), so that a key with a third of all rows lies in many partitions; within
a partition the row before is a window function, and the first row of a partition takes it from the last row of the
partitions before (one small row each).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.staging import stage


def with_previous(df: DataFrame, key: str, order: list[str], columns: list[str], name: str = "prev") -> DataFrame:
    """df with a struct `name` of the columns in the row before by `order` within the key; null in a key's first row."""
    ranged = stage(df.repartitionByRange(key, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    here = F.struct(F.col(key).alias("_k"), *columns)
    edge = ranged.groupBy("_p").agg(F.max_by(here, F.struct(key, *order)).alias("_e"))
    before = edge.withColumn("_before", F.lag("_e").over(Window.orderBy("_p"))).select(F.col("_p").alias("_q"), "_before")  # a row per partition
    inside = F.lag(here).over(Window.partitionBy("_p").orderBy(key, *order))
    joined = ranged.withColumn("_in", inside).join(F.broadcast(before), F.col("_p") == F.col("_q"), "left")
    found = F.coalesce("_in", "_before")
    same = found["_k"].eqNullSafe(F.col(key)) & found.isNotNull()
    return joined.withColumn(name, F.when(same, F.struct(*(found[c].alias(c) for c in columns)))).drop("_p", "_q", "_in", "_before")
