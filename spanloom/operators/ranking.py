"""Positions in a global order without a single task: range partitions, their counts, and ranks within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize


def global_positions(df: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """``df`` with pos (from 0) in the total order ``order``, and its number of rows."""
    parts = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = {r["__part"]: r["count"] for r in parts.groupBy("__part").count().collect()}  # a row for each partition
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    starts = df.sparkSession.createDataFrame(before, "__part int, __before bigint")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__rank", rank).join(F.broadcast(starts), "__part").withColumn("pos", F.col("__before") + F.col("__rank")).drop("__part", "__rank", "__before"), total
