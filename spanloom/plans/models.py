"""Queries of model summaries, verified graphs and candidates, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import cloud, evidence, gates, selection, stats
from .oracle import _REGIONS
from .queries import _points, _rounded, _steps, _t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@_query(f"""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem),
p AS (SELECT greatest(0.0, least(1.0, (l_extendedprice - lo) / greatest(hi - lo, 1e-9))) AS h, l_discount < 0.08 AS ok FROM lineitem, q),
s AS (SELECT region, lo::DOUBLE AS low, hi::DOUBLE AS high FROM (VALUES {_REGIONS}) v(region, lo, hi))
SELECT region, low, high, count(h) AS point_count, coalesce(round(avg(ok::INT) FILTER (h IS NOT NULL), 6), 0) AS supported_fraction FROM s LEFT JOIN p ON h BETWEEN low AND high GROUP BY 1, 2, 3""")
def band_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cloud.band_evidence(cloud.normalized_height(_points(spark, sf_dir), "height")), "supported_fraction")


@_query("""WITH i AS (SELECT c_acctbal > 0 AS reg, CASE WHEN c_nationkey > 0 THEN c_nationkey END AS ring, c_custkey % 7 <> 0 AS ok FROM customer),
p AS (SELECT l_quantity AS x, l_discount AS y, l_tax AS z, l_orderkey % 13 <> 0 AS ok FROM lineitem), r AS (SELECT ring, count(*) AS n FROM i WHERE reg AND ok GROUP BY 1)
SELECT (SELECT count(*) FROM i) AS total_images, (SELECT count(*) FROM i WHERE reg) AS registered_images, count(*) AS sparse_points, count(*) FILTER (ok) AS finite_sparse_points,
  min(x) FILTER (ok) AS x_min, max(x) FILTER (ok) AS x_max, min(y) FILTER (ok) AS y_min, max(y) FILTER (ok) AS y_max, min(z) FILTER (ok) AS z_min, max(z) FILTER (ok) AS z_max,
  (SELECT count(*) FROM r) AS trajectory_ring_count, (SELECT min(n) >= 3 FROM r) AS trajectory_coherent_candidate, (SELECT count(*) FROM orders) AS observations,
  round((SELECT avg(reg::INT) FROM i), 6) AS registration_fraction, round((SELECT count(*) FROM orders) / count(*), 6) AS mean_track_length, round((SELECT count(*) FROM orders) / (SELECT count(*) FROM i WHERE reg), 6) AS mean_observations_per_image FROM p""")
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero, bad = F.lit(0.0), F.lit(float("nan"))
    images = _t(spark, sf_dir, "customer").select((F.col("c_acctbal") > 0).alias("registered"), F.when(F.col("c_nationkey") > 0, F.col("c_nationkey").cast("string")).alias("ring"), zero.alias("x"), F.when(F.col("c_custkey") % 7 != 0, 1.0).otherwise(bad).alias("y"), zero.alias("z"))
    points = _t(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.when(F.col("l_orderkey") % 13 != 0, F.col("l_tax")).otherwise(bad).alias("z"))
    return _rounded(stats.model_summary(images, points, _t(spark, sf_dir, "orders")), "registration_fraction", "mean_track_length", "mean_observations_per_image")


@_query("""WITH s AS (SELECT o_orderstatus AS name, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1),
f AS (SELECT event_type AS name, count(*) AS n, min(user_id) AS a, max(user_id) AS b FROM events WHERE event_id % 3 = 0 AND event_type IN ('click', 'view') GROUP BY 1)
SELECT 'pass' AS kind, v.name, coalesce(n, 0) AS n, a AS least_frame, b AS greatest_frame FROM (VALUES ('click'), ('view'), ('none')) v(name) LEFT JOIN f ON f.name = v.name
UNION ALL SELECT 'status', CASE name WHEN 'O' THEN 'missing' WHEN 'P' THEN 'deferred_until_registered_empty_reference' ELSE name END, n, NULL, NULL FROM s
UNION ALL SELECT 'result', CASE WHEN bool_or(name = 'P') THEN 'deferred_until_registered_empty_reference' ELSE 'not_evaluable' END, CAST(sum(n) AS BIGINT), NULL, NULL FROM s""")
def negative_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = _t(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, "empty_board").otherwise("geometry").alias("role"), F.col("event_type").alias("pass_id"), F.col("user_id").alias("frame"))
    s = F.col("o_orderstatus")
    records = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ring"), F.when(s == "P", "deferred_until_registered_empty_reference").when(s != "O", s).alias("status"))
    return stats.negative_evidence(manifest, records, ["click", "view", "none"], ["1-URGENT", "5-LOW"])


def _verified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as views, with pairs of near keys; some pairs have no inliers, one view in 23 isn't registered, and one pair in 29 is of a view with itself."""
    s = _t(spark, sf_dir, "supplier")
    name = lambda c: F.concat(F.lit("i"), F.col(c).cast("string"))
    near = _steps(s.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")))
    images = s.select(F.col("s_suppkey").alias("image_id"), name("s_suppkey").alias("name"))
    geometries = near.where("a > 0").select(E.pair_id("a", "b").alias("pair_id"), F.when(F.col("a") % 11 != 0, F.floor(F.abs("vb")).cast("bigint")).alias("inliers"))
    pairs = near.select(name("a").alias("first"), F.when(F.col("a") % 29 == 0, name("a")).otherwise(name("b")).alias("second")).distinct()
    rings = s.where("s_suppkey % 23 <> 0").select(name("s_suppkey").alias("name"), F.col("s_nationkey").alias("ring"))
    return evidence.verified_graph(pairs, evidence.verified_support(geometries, images), rings)


_GRAPH = """WITH s AS (SELECT s_suppkey AS k, 'i' || s_suppkey AS name, s_acctbal AS v, s_nationkey AS ring, s_suppkey % 23 <> 0 AS known FROM supplier),
n AS (SELECT x.name AS first, CASE WHEN x.k % 29 = 0 THEN x.name ELSE y.name END AS second, x.known AND y.known AND x.k % 29 <> 0 AS known, x.ring = y.ring AS same,
  CASE WHEN x.k % 11 <> 0 AND x.k > 0 THEN floor(abs(y.v)) ELSE 0 END AS inliers FROM s x JOIN s y ON y.k BETWEEN x.k + 1 AND x.k + 3),
g AS (SELECT first AS ref, second AS source, inliers, same FROM n WHERE known AND inliers > 0 UNION ALL SELECT second, first, inliers, same FROM n WHERE known AND inliers > 0),
"""


@_query(_GRAPH + """k AS (SELECT *, row_number() OVER (PARTITION BY ref, same ORDER BY inliers DESC, source) AS side FROM g),
r AS (SELECT ref, source, CAST(row_number() OVER (PARTITION BY ref ORDER BY CASE WHEN side > 1 THEN 2 WHEN same THEN 0 ELSE 1 END, inliers DESC, source) AS INTEGER) AS rank FROM k) SELECT * FROM r WHERE rank <= 4""")
def verified_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.verified_sources(_verified(spark, sf_dir)[0], most=4)


@_query(_GRAPH + """w AS (SELECT DISTINCT CASE WHEN first = second OR NOT known THEN 'unknown_or_self' ELSE 'unsupported' END AS problem, first, second FROM n WHERE NOT known OR inliers <= 0)
SELECT * FROM w UNION ALL SELECT 'isolated', name, NULL FROM s WHERE known AND name NOT IN (SELECT ref FROM g)""")
def verified_graph_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir)[1]


@_query("""WITH r AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer),
f AS (SELECT k, k % 2 = 0 AND k % 5 <> 0 AND n <> 3 AS ex, k % 3 <> 0 AND n % 4 <> 1 AS cl, n <> 7 AND n <> 5 AND k % 7 <> 0 AS pr, k % 13 <> 0 AS pv, n FROM r)
SELECT k, ex AS exact_model, cl AS pose_and_trajectory_clean, pr AS provenance_clean, pv AS process_valid,
  array_to_string(list_filter([CASE WHEN k % 7 = 0 THEN 'cross_ring_graph_connected' END, CASE WHEN n = 3 THEN 'registered_image_set_exact' END], lambda x: x IS NOT NULL), ',') AS strict_gate_failures, ex AND cl AND pr AND pv AS defensible FROM f""")
def defensible_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    checks = {"stable_model_hash_bound": F.lit(True), "sqlite_snapshot_lineage_bound": F.lit(True), "cross_ring_graph_connected": F.when(k % 7 != 0, True), "registered_image_set_exact": n != 3, "single_coherent_model": F.lit(True)}
    c = _t(spark, sf_dir, "customer").select(
        k.alias("k"), F.when(k % 2 == 0, 372).otherwise(371).alias("registered_images"), F.when(k % 5 != 0, 1).alias("model_count"), F.map_from_arrays(F.array(*[F.lit(x) for x in checks]), F.array(*checks.values())).alias("gate_checks"),
        (k % 3 == 0).cast("int").alias("rotation_failures"), F.when(n % 4 == 1, 2).alias("trajectory_failures"), F.when(n != 7, True).alias("independent_graph"), F.when(n != 5, False).alias("constructed_pairwise_tracks"), F.when(k % 13 == 0, False).alias("process_valid"),
    )
    return gates.defensible_candidate(c, ["k"]).withColumn("strict_gate_failures", F.array_join("strict_gate_failures", ","))
