"""Choices with total orders: sources of a reference, best rows, even samples, capped adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .phases import even_positions


def prioritized_sources(edges: DataFrame, *, most: int = 6, least_cross: int = 1) -> DataFrame:
    """(ref, source, rank) from directed edges (ref, source, same_ring, distance, ord).

    The nearest source of the same ring and ``least_cross`` of other rings are
    reserved; the rest follow, same ring first, by distance and order.
    """
    side = Window.partitionBy("ref", "same_ring").orderBy("distance", "ord")
    e = edges.withColumn("side_rank", F.row_number().over(side))
    cls = F.when(F.col("same_ring") & (F.col("side_rank") == 1), 0).when(~F.col("same_ring") & (F.col("side_rank") <= least_cross), 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("ref").orderBy("cls", F.when(F.col("cls") == 2, (~F.col("same_ring")).cast("int")).otherwise(0), "distance", "ord"))
    return e.withColumn("cls", cls).withColumn("rank", rank).where(F.col("rank") <= most).select("ref", "source", "rank")


def capped_adjacency(pairs: DataFrame, order: DataFrame, most: int | None = None) -> DataFrame:
    """(ref, source, rank): both directions of undirected pairs (a, b), sources in the order of ``order`` (name, ord), at most ``most``."""
    both = pairs.select(F.col("a").alias("ref"), F.col("b").alias("source")).unionByName(pairs.select(F.col("b").alias("ref"), F.col("a").alias("source"))).distinct()
    ranked = both.join(order.select(F.col("name").alias("source"), "ord"), "source").withColumn("rank", F.row_number().over(Window.partitionBy("ref").orderBy("ord")))
    return (ranked.where(F.col("rank") <= most) if most else ranked).select("ref", "source", "rank")


def ring_support_sources(edges: DataFrame, *, local: int = 4, cross: int = 2, most: int = 6) -> DataFrame:
    """(ref, source, rank): the ``local`` strongest of the same ring, the ``cross`` strongest of others, filled up by strength."""
    side = F.row_number().over(Window.partitionBy("ref", "same_ring").orderBy(F.desc("inliers"), "source"))
    e = edges.withColumn("side", side).withColumn("reserved", F.when(F.col("same_ring"), F.col("side") <= local).otherwise(F.col("side") <= cross))
    rank = F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("reserved"), F.desc("same_ring"), F.desc("inliers"), "source"))
    return e.withColumn("rank", rank).where(F.col("rank") <= most).select("ref", "source", "rank")


def lexicographic_best(df: DataFrame, keys: list[Column], by: list[str] | None = None) -> DataFrame:
    """The row of the greatest tuple of ``keys`` (of each group)."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*(by or [])).agg(F.max_by(row, F.struct(*keys)).alias("r"))
    return best.select("r.*")


def even_sample(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """An even sample of k rows of the whole table in its order.

    Positions come from the counts of range partitions, so no task sees the whole table.
    """
    from .ranking import global_positions

    ranked, n = global_positions(df, order)
    places = df.sparkSession.range(1).select(F.explode(even_positions(F.lit(n).cast("bigint"), k)).alias("pos")) if n else df.sparkSession.createDataFrame([], "pos bigint")
    return ranked.join(F.broadcast(places), "pos")


def verified_sources(edges: DataFrame, most: int = 6) -> DataFrame:
    """(ref, source, rank): the strongest source of the same ring, the strongest of another, then all others by inliers and name."""
    side = Window.partitionBy("ref", "same_ring").orderBy(F.desc("inliers"), "source")
    place = F.when(F.row_number().over(side) > 1, 2).when(F.col("same_ring"), 0).otherwise(1)
    rank = F.row_number().over(Window.partitionBy("ref").orderBy("place", F.desc("inliers"), "source"))
    return edges.withColumn("place", place).withColumn("rank", rank).where(F.col("rank") <= most).select("ref", "source", "rank")
