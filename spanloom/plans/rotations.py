"""Queries of repaired rotations, each beside its DuckDB SQL.

Suppliers are images with a known turn about one axis, in three rings.  Pairs
carry the turn from one to the other, some of them a wrong one, and the
reference of every fourth block is a quarter turn off, so that the right result
is known in closed form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rotation
from .queries import _t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RINGS = ["r0", "r1", "r2"]


def _query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _about_z(degrees: Column) -> Column:
    c, s, zero, one = F.cos(F.radians(degrees)), F.sin(F.radians(degrees)), F.lit(0.0), F.lit(1.0)
    return F.array(c, -s, zero, s, c, zero, zero, zero, one)


def _named(k: Column) -> Column:
    return F.concat(F.lit("s"), F.lpad(k.cast("string"), 9, "0"))


def _ring(k: Column) -> Column:
    return F.concat(F.lit("r"), k % 3)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("t"))
    step = s.withColumn("step", F.explode(F.array(F.lit(1), F.lit(3), F.lit(6)))).join(s.select(F.col("k").alias("m"), F.col("t").alias("tm")), F.col("k") + F.col("step") == F.col("m"))
    k, wrong = F.col("k"), (F.col("step") == 1) & (F.col("k") % 10 == 4)
    return step.select((k * 10 + F.col("step")).alias("pair_id"), _named(k).alias("first"), _named(F.col("m")).alias("second"), _ring(k).alias("ring"), _ring(F.col("m")).alias("second_ring"), (F.col("step") > 1).alias("same_ring"), _about_z(F.col("tm") - F.col("t") + F.when(wrong, 90.0).otherwise(0.0)).alias("rotation"), (100 + k % 50).alias("inliers"), (k % 8 != 5).alias("conditioned"))


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    off = F.when(F.floor(k / 9) % 4 == 2, 90.0).otherwise(0.0)
    return _t(spark, sf_dir, "supplier").select(_named(k).alias("name"), _about_z(F.col("s_acctbal") + off).alias("rotation"))


def _turns(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, (F.round(F.col("rotation")[0], 4) + 0.0).alias("cos"), (F.round(F.col("rotation")[3], 4) + 0.0).alias("sin"), (F.round(F.col("rotation")[8], 4)).alias("axis"))


_NAME = "'s' || lpad(CAST({} AS VARCHAR), 9, '0')"
_STEPS = f"""p AS (SELECT a.s_suppkey AS k, d AS step, a.s_suppkey + d AS m FROM supplier a, (SELECT unnest([1, 3, 6]) AS d) JOIN supplier b ON b.s_suppkey = a.s_suppkey + d),
e AS (SELECT k * 10 + step AS pair_id, {_NAME.format("k")} AS first, {_NAME.format("m")} AS second, k, step, step = 1 AND k % 10 = 4 AS wrong, k % 8 <> 5 AS good FROM p)"""


@_query(f"SELECT {_NAME.format('s_suppkey')} AS name, 'r' || s_suppkey % 3 AS ring, round(cos(radians(s_acctbal - t)), 4) + 0.0 AS cos, round(sin(radians(s_acctbal - t)), 4) + 0.0 AS sin, 1.0::DOUBLE AS axis FROM supplier, (SELECT arg_min(s_acctbal, s_suppkey) AS t FROM supplier)")
def rotation_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(rotation.rotation_consensus(_records(spark, sf_dir), RINGS)[0], "name", "ring")


@_query(f"""WITH {_STEPS} SELECT pair_id, CASE WHEN step = 1 THEN 'cross_ring' ELSE 'same_ring' END AS edge_type, good AS conditioned, CASE WHEN step = 1 AND NOT good THEN NULL WHEN wrong THEN 90.0::DOUBLE ELSE 0.0::DOUBLE END AS residual,
  CASE WHEN step > 1 THEN 'retained_rotation_synchronization' WHEN NOT good THEN 'retained_negative_or_unconditioned_evidence' WHEN wrong THEN 'retained_robust_consensus_outlier' ELSE 'retained_robust_consensus_inlier' END AS status FROM e""")
def consensus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = rotation.rotation_consensus(_records(spark, sf_dir), RINGS)[1]
    return edges.select("pair_id", "edge_type", "conditioned", (F.round("residual", 3) + 0.0).alias("residual"), "status")


_TRUE = f"SELECT {_NAME.format('s_suppkey')} AS name, round(cos(radians(s_acctbal)), 4) + 0.0 AS cos, round(sin(radians(s_acctbal)), 4) + 0.0 AS sin, 1.0::DOUBLE AS axis FROM supplier"


@_query(_TRUE)
def ring_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(rotation.ring_aligned(_records(spark, sf_dir), _reference(spark, sf_dir))[0], "name")


@_query("""SELECT 'r' || s_suppkey % 3 AS ring, count(*) AS images, count(*) AS candidates, count(*) FILTER (floor(s_suppkey / 9) % 4 <> 2) AS support, round(avg((floor(s_suppkey / 9) % 4 <> 2)::INT), 6) AS support_fraction, 'supported' AS status FROM supplier GROUP BY 1""")
def ring_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation.ring_aligned(_records(spark, sf_dir), _reference(spark, sf_dir))[1].select("ring", "images", "candidates", "support", F.round("support_fraction", 6).alias("support_fraction"), "status")


@_query(_TRUE)
def island_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(rotation.island_repair(_records(spark, sf_dir), _reference(spark, sf_dir))[0], "name")


@_query(f"""WITH {_STEPS}, x AS (SELECT *, (floor(k / 9) % 4 = 2)::INT AS a, (floor((k + step) / 9) % 4 = 2)::INT AS b FROM e WHERE good)
SELECT pair_id, CASE ((wrong::INT - (b - a)) % 4 + 4) % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 2 THEN 180.0::DOUBLE ELSE 90.0::DOUBLE END AS source_residual, CASE WHEN wrong THEN 90.0::DOUBLE ELSE 0.0::DOUBLE END AS corrected_residual FROM x""")
def island_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of the conditioned pairs before and after the repair; wrong pairs stay wrong."""
    edges = rotation.island_repair(_records(spark, sf_dir), _reference(spark, sf_dir))[1]
    return edges.select("pair_id", (F.round("source_residual", 3) + 0.0).alias("source_residual"), (F.round("corrected_residual", 3) + 0.0).alias("corrected_residual"))
