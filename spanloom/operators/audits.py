"""Exactly-once, set equality, pruning and coverage audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exactly_once(expected: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """One row: numbers of expected, written, distinct, missing, unexpected and repeated keys, and passed."""
    w = written.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    e = expected.select(F.col(key).alias("k")).distinct().withColumn("want", F.lit(True))
    both = e.join(w, "k", "full_outer")
    out = both.agg(
        F.count_if("want").alias("n_expected"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_written"), F.count_if(F.col("n").isNotNull()).alias("n_distinct"),
        F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if(F.col("want").isNull()).alias("n_unexpected"), F.count_if(F.col("n") > 1).alias("n_repeated"),
    )
    return out.withColumn("passed", (F.col("n_missing") == 0) & (F.col("n_unexpected") == 0) & (F.col("n_repeated") == 0))


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key) of the keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("left").alias("side"), key).unionByName(b.join(a, key, "left_anti").select(F.lit("right").alias("side"), key))


def prune_to(df: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``keep``; a null key is in nothing."""
    return df.join(keep.select(key).distinct(), key, "left_semi")


def replace_rows(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of ``new`` in place of its own where the key has a replacement."""
    cols = [c for c in new.columns if c != key]
    n = new.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in cols], F.lit(True).alias("__hit"))
    out = df.join(n, F.col(key) == F.col("__k"), "left")
    return out.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def recompute_set(expected: DataFrame, cached: DataFrame, identity: list[str]) -> DataFrame:
    """Rows of ``expected`` that no cached row of the same identity covers."""
    return expected.join(cached.select(*identity).distinct(), identity, "left_anti")


def tile_audit(tiles: DataFrame, images: DataFrame, rings: DataFrame, most_sources: int = 6) -> DataFrame:
    """One row over tile configurations (tile, ref, source): coverage of the images, repeated references, cross-ring sources and sizes.

    References are counted by tile, so a reference in two tiles is repeated.
    """
    refs = tiles.select("tile", "ref").distinct().groupBy("ref").agg(F.count("*").alias("tiles"))
    names = images.select(F.col("name").alias("ref")).distinct().withColumn("want", F.lit(True))
    cover = names.join(refs, "ref", "full_outer").agg(F.count_if(F.col("tiles").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("extra"), F.count_if(F.col("tiles") > 1).alias("repeated"))
    ends = tiles.join(rings.select(F.col("name").alias("ref"), F.col("ring").alias("ref_ring")), "ref", "left").join(rings.select(F.col("name").alias("source"), F.col("ring").alias("source_ring")), "source", "left")
    each = ends.groupBy("tile", "ref").agg(F.count("*").alias("sources"), F.count_if(F.col("ref_ring") != F.col("source_ring")).alias("cross"), F.count_if(F.col("ref") == F.col("source")).alias("self"))
    sizes = each.agg(F.coalesce(F.sum("sources"), F.lit(0)).alias("edges"), F.coalesce(F.sum("cross"), F.lit(0)).alias("cross_ring_edges"), F.count_if(F.expr("cross = 0")).alias("no_cross"), F.count_if(F.col("sources") > most_sources).alias("over_cap"), F.coalesce(F.sum("self"), F.lit(0)).alias("self_edges"))
    return cover.withColumn("__one", F.lit(1)).join(sizes.withColumn("__one", F.lit(1)), "__one").drop("__one").withColumn("passed", F.expr("missing = 0 and extra = 0 and repeated = 0 and no_cross = 0 and over_cap = 0 and self_edges = 0"))
