"""An incremental front end: new captures are deduplicated as they arrive and counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_arrivals(stream: DataFrame, key: str, at: str, delay: str = "10 minutes") -> DataFrame:
    """Rows whose key has not come within the watermark; state older than that is dropped."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows and mean value of each window and key, once the watermark has passed it."""
    s = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    out = s.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), by, "n")


def append_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what there is to a Parquet table and stop; the checkpoint makes a rerun take only what is new."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
