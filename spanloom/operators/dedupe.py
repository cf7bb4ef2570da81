"""Duplicates of captures: identical bytes, and near copies of the first of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import exprs as E


def exact_duplicates(df: DataFrame, key: str, digest: Column) -> DataFrame:
    """(key, digest, copies, first_key) of the rows whose digest occurs more than once.

    The groups are counted before the rows are joined back, so a digest of very many rows is combined first.
    """
    rows = df.select(F.col(key).alias("key"), digest.alias("digest"))
    groups = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("key").alias("first_key")).where("copies > 1")
    return rows.join(groups, "digest").select("key", "digest", "copies", "first_key")


def near_anchor_duplicates(df: DataFrame, group: str, key: str, word: Column, most_bits: int = 6) -> DataFrame:
    """Rows within ``most_bits`` differing bits of the first row of their group (its least key); later rows are not compared with each other."""
    rows = df.select(F.col(group).alias("grp"), F.col(key).alias("key"), word.alias("word"))
    anchors = rows.groupBy("grp").agg(F.min(F.struct("key", "word")).alias("a"), F.count("*").alias("members")).where("members > 1")
    near = rows.join(anchors, "grp").where(F.col("key") != F.col("a.key"))
    return near.select("grp", F.col("a.key").alias("anchor"), "key", E.hamming("word", F.col("a.word")).cast("int").alias("bits")).where(F.col("bits") <= most_bits)


def keep_sharper(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """``pairs`` with kept: the side of greater sharpness, the first of equal ones."""
    return pairs.withColumn("kept", F.when(F.coalesce(F.col(first), F.lit(0.0)) >= F.coalesce(F.col(second), F.lit(0.0)), F.lit("first")).otherwise(F.lit("second")))


def first_two_per_group(df: DataFrame, group: str, order: list[Column], most: int = 2, cap: int = 18) -> DataFrame:
    """The first ``most`` rows of each group, in the order of groups, ``cap`` in all."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__rank") <= most)
    return ranked.orderBy(group, "__rank").limit(cap).drop("__rank")
