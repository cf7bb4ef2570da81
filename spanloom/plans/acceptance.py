"""Queries of the acceptance of a sparse model, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, integrity, masks, stats
from .queries import _rounded, _t
from .rasters import _PROJECTION, _views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _failed(df: DataFrame) -> DataFrame:
    return df.withColumn("reasons", F.array_join("reasons", ",")).drop("checks")


def _sql_reasons(*checks: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{k}' END" for k, c in checks) + "], lambda x: x IS NOT NULL), ',')"


@_query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 41 = 0 THEN 'inf'::DOUBLE WHEN event_id % 43 = 0 THEN 'nan'::DOUBLE WHEN event_id % 5 > 0 THEN value END AS c, CASE WHEN user_id % 9 = 0 AND event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 3 > 0 THEN abs(value - 40) END AS r FROM events),
a AS (SELECT user_id, median(c) AS m FROM e WHERE isfinite(c) GROUP BY 1), t AS (SELECT user_id, m + 3 * greatest(median(abs(c - m)), 1e-9) AS tc FROM e JOIN a USING (user_id) WHERE isfinite(c) GROUP BY user_id, m),
b AS (SELECT user_id, median(r) AS m FROM e WHERE r IS NOT NULL AND c IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (isnan(r)) = 0), u AS (SELECT user_id, m + 3 * greatest(median(abs(r - m)), 1e-9) AS tr FROM e JOIN b USING (user_id) WHERE r IS NOT NULL AND c IS NOT NULL GROUP BY user_id, m)
SELECT event_id, c IS NOT NULL AND (coalesce(NOT isnan(c) AND c > tc, false) OR coalesce(NOT isnan(r) AND r > tr, false)) AS is_outlier FROM e LEFT JOIN t USING (user_id) LEFT JOIN u USING (user_id)""")
def jump_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps that are infinite, NaN or missing among others."""
    k, nan = F.col("event_id"), F.lit(float("nan"))
    c = F.when(k % 41 == 0, float("inf")).when(k % 43 == 0, nan).when(k % 5 > 0, F.col("value"))
    r = F.when((F.col("user_id") % 9 == 0) & (k % 7 == 0), nan).when(k % 3 > 0, F.abs(F.col("value") - 40))
    j = _t(spark, sf_dir, "events").select("event_id", "user_id", F.lit(True).alias("same"), c.alias("c"), r.alias("r"))
    return evidence.trajectory_outliers(j, "user_id", "c", "r", "same", scale=3.0).select("event_id", "is_outlier")


@_query("""WITH i AS (SELECT CASE WHEN c_nationkey > 0 THEN 'ring' || c_nationkey ELSE 'unknown' END AS ring, c_acctbal / 1000 AS x, cos(c_custkey) AS y, sin(c_custkey) AS z FROM customer WHERE c_acctbal > 0 AND c_custkey % 7 > 0),
m AS (SELECT ring, count(*) AS registered_count, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM i GROUP BY 1), r AS (SELECT i.ring, registered_count, cx, cy, cz, sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS r FROM i JOIN m USING (ring))
SELECT ring, registered_count, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y, round(cz, 6) AS centroid_z, round(median(r), 6) AS radius_median, round(stddev_pop(r), 6) AS radius_std, round(stddev_pop(r) / greatest(avg(r), 1e-9), 6) AS radius_cv FROM r GROUP BY ring, registered_count, cx, cy, cz""")
def trajectory_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    ring = F.when(F.col("c_nationkey") > 0, F.concat(F.lit("ring"), F.col("c_nationkey")))
    x = F.when(k % 7 > 0, F.col("c_acctbal") / 1000).otherwise(F.lit(float("nan")))
    images = _t(spark, sf_dir, "customer").select(ring.alias("ring"), (F.col("c_acctbal") > 0).alias("registered"), x.alias("x"), F.cos(k).alias("y"), F.sin(k).alias("z"))
    return _rounded(stats.trajectory_spread(images), *[f"centroid_{a}" for a in "xyz"], "radius_median", "radius_std", "radius_cv")


_TRACKS = """l AS (SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY 1),
tr AS (SELECT count(*) FILTER (n >= 2) AS tracks, count(*) FILTER (d < n) AS repeated, avg((n >= 3)::INT) FILTER (n >= 2) AS three, quantile_cont(n, 0.5) FILTER (n >= 2) AS p50, quantile_cont(n, 0.9) FILTER (n >= 2) AS p90, sha256('lineitem') IS NOT NULL AS bound FROM l)"""
_TRACK_CHECKS = (("track_evidence_available", "tracks > 0"), ("no_duplicate_image_observations", "repeated = 0"), ("independent_track_provenance_bound", "bound"), ("pair_local_track_partition_rejected", "true"), ("multi_view_track_fraction", "three >= 0.5"), ("track_length_p50", "p50 >= 3"), ("track_length_p90", "p90 >= 4"))


@_query(f"WITH {_TRACKS}, r AS (SELECT tracks, {_sql_reasons(*_TRACK_CHECKS)} AS reasons FROM tr) SELECT tracks, reasons = '' AS passed, reasons FROM r")
def track_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of parts as observations of tracks."""
    return _failed(_track_row(spark, sf_dir))


def _track_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("track"), F.col("l_suppkey").alias("image"))
    source = spark.range(1).select(F.lit("lineitem").alias("source"), F.lit(True).alias("independent_graph"), F.sha2(F.lit("lineitem"), 256).alias("independent_graph_sha256"), F.lit(False).alias("constructed_pairwise_tracks"))
    return integrity.track_gate(seen, source)


_MOVES = """mv AS (SELECT a.vec_id AS k, b.embedding[1] - a.embedding[1] AS dx, b.embedding[2] - a.embedding[2] AS dy, b.embedding[3] - a.embedding[3] AS dz, a.vec_id % 10 = 0 AS odd FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings) a JOIN (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings) b ON b.vec_id = a.vec_id + 1),
mo AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS d, CASE WHEN odd THEN dx ELSE -dx END AS tx, -dy AS ty, -dz AS tz FROM mv),
ms AS (SELECT *, (dx * -tx + dy * -ty + dz * -tz) / d AS scale FROM mo WHERE d > 1e-9),
mr AS (SELECT scale, degrees(acos(greatest(-1.0, least(1.0, scale / d)))) AS err, sqrt((dx - scale * -tx / d) ** 2 + (dy - scale * -ty / d) ** 2 + (dz - scale * -tz / d) ** 2) / d AS res FROM ms),
mc AS (SELECT count(*) AS edges, quantile_cont(err, 0.9) AS direction, quantile_cont(res, 0.9) AS residual, avg((scale > 0)::INT) AS positive FROM mr)"""
_MOVE_CHECKS = (("translation_evidence_available", "edges > 0"), ("finite_camera_centers", "true"), ("direction_error_p90", "direction <= 35"), ("positive_projected_scale_fraction", "positive >= 0.95"), ("orthogonal_residual_p90", "residual <= 0.6"))


@_query(f"WITH {_MOVES}, r AS (SELECT edges, {_sql_reasons(*_MOVE_CHECKS)} AS reasons FROM mc) SELECT edges, reasons = '' AS passed, reasons FROM r")
def translation_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as camera centres, and the way to the next as the direction; one in ten of these is mirrored."""
    return _failed(_translation_row(spark, sf_dir))


def _translation_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 3).alias("center"))
    cameras = e.select(F.col("vec_id").alias("name"), "center", F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)]).alias("rotation"))
    step = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("center").alias("next")), "vec_id")
    back = [F.col("center")[i] - F.col("next")[i] for i in range(3)]
    edges = step.select(F.col("vec_id").alias("pair_id"), F.col("vec_id").alias("first"), (F.col("vec_id") + 1).alias("second"), F.array(F.when(F.col("vec_id") % 10 == 0, -back[0]).otherwise(back[0]), *back[1:]).alias("translation"), F.lit(True).alias("conditioned"))
    return integrity.translation_gate(evidence.translation_edges(edges, cameras), cameras)


_AUDIT = """im AS (SELECT c_custkey AS name, c_nationkey % 6 AS ring, c_acctbal > -500 AS selected FROM customer), re AS (SELECT c_custkey AS name FROM customer WHERE c_custkey % 50 <> 7),
au AS (SELECT o_custkey AS f, o_custkey + 1 + o_orderkey % 4 AS s, CAST(floor(o_totalprice / 1000) AS BIGINT) AS inliers, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice - floor(o_totalprice / 40) * 40 END AS turn, o_orderkey % 50 AS shared, o_orderpriority = '1-URGENT' AS jump, o_orderkey % 11 = 0 AS near, o_orderkey % 997 = 0 AS excuse FROM orders),
ex AS (SELECT DISTINCT f, s FROM au WHERE excuse), fl AS (SELECT au.*, ex.f IS NOT NULL AS excluded, a.ring = b.ring AS same FROM au LEFT JOIN ex ON ex.f = au.f AND ex.s = au.s LEFT JOIN im a ON a.name = au.f LEFT JOIN im b ON b.name = au.s),
ag AS (SELECT *, coalesce(same, true) AND NOT near AND inliers >= 100 AND NOT excluded AS relevant FROM fl),
cn AS (SELECT count(*) AS pairs, count(*) FILTER (excluded) AS excluded, count(*) FILTER (relevant) AS relevant, count(*) FILTER (relevant AND coalesce(turn > 30, true)) AS disagrees, count(*) FILTER (relevant AND turn IS NOT NULL AND shared < 20) AS unshared, count(*) FILTER (relevant AND jump) AS jumps FROM ag),
rg AS (SELECT ring, count(*) FILTER (selected) AS n, count(*) FILTER (name IN (SELECT name FROM re)) AS k FROM im GROUP BY 1), ri AS (SELECT count(*) AS rings, min(k / n) AS share FROM rg WHERE n > 0),
ed AS (SELECT DISTINCT a.ring AS u, b.ring AS v FROM au JOIN re p ON p.name = f JOIN re q ON q.name = s JOIN im a ON a.name = f JOIN im b ON b.name = s WHERE inliers >= 50 AND a.ring <> b.ring),
rp(id, root) USING KEY (id) AS (SELECT ring AS id, ring AS root FROM rg WHERE n > 0 UNION SELECT e.v, min(r.root) FROM rp AS r JOIN (SELECT u, v FROM ed UNION SELECT v, u FROM ed) e ON e.u = r.id JOIN recurring.rp AS o ON o.id = e.v WHERE r.root < o.root GROUP BY e.v)"""
_CHECKS = (
    ("independent_audit_evidence_bound", "pairs > 0"), ("audit_exclusion_justifications_bound", "true"), ("all_selected_rings_registered", "share >= 0.95"), ("registered_image_set_exact", "(SELECT count(*) FROM customer WHERE c_custkey % 50 = 7) = 0"), ("same_ring_pose_consistency", "disagrees = 0"), ("shared_track_continuity", "unshared = 0"), ("trajectory_continuity", "jumps = 0"),
    ("cross_ring_graph_connected", "parts = 1"), ("single_coherent_model", "(SELECT count(*) FROM customer WHERE c_custkey % 50 = 7) = 0"), ("stable_model_hash_bound", "true"), ("sqlite_snapshot_lineage_bound", "true"), ("camera_intrinsics_integrity", "(SELECT count(*) FROM supplier WHERE s_acctbal <= 0) = 0"), ("sparse_point_health", "(SELECT count(*) FROM part) >= 100"), ("observation_health", "(SELECT count(*) FROM lineitem) >= 1000"), ("mean_reprojection_health", "(SELECT avg(l_discount * 40) FROM lineitem) <= 3"),
    ("independent_multiview_track_distribution", "(SELECT " + " AND ".join(c for _, c in _TRACK_CHECKS) + " FROM tr)"), ("mask_projection_per_view", "(SELECT count(*) FILTER (status <> 'measured') = 0 AND quantile_cont(precision, 0.1) >= 0.9 AND quantile_cont(recall, 0.1) >= 0.6 AND quantile_cont(iou, 0.1) >= 0.6 FROM v)"), ("mask_projection_per_ring", "(SELECT min(p) >= 0.9 AND min(r) >= 0.6 AND min(i) >= 0.6 FROM (SELECT avg(precision) AS p, avg(recall) AS r, avg(iou) AS i FROM v WHERE status = 'measured' GROUP BY ring))"),
    ("camera_center_translation_scale_consistency", "(SELECT " + " AND ".join(c for _, c in _MOVE_CHECKS) + " FROM mc)"),
)


@_query(f"""WITH RECURSIVE {_PROJECTION}, {_TRACKS}, {_MOVES}, {_AUDIT}, x AS (SELECT cn.*, ri.*, (SELECT count(DISTINCT root) FROM rp) AS parts FROM cn, ri),
y AS (SELECT pairs, excluded, relevant, disagrees, unshared, jumps, parts AS ring_parts, {_sql_reasons(*_CHECKS)} AS reasons FROM x) SELECT *, reasons = '' AS passed FROM y""")
def integrity_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as images, orders as audited pairs of them, suppliers as cameras; tracks, masks and centres as in their own rules."""
    customer, order = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    images = customer.select(F.col("c_custkey").alias("name"), (F.col("c_nationkey") % 6).alias("ring"), (F.col("c_acctbal") > -500).alias("selected"))
    registered = customer.where("c_custkey % 50 <> 7").select(F.col("c_custkey").alias("name"))
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    audit = order.select(
        F.col("o_custkey").alias("first"), (F.col("o_custkey") + 1 + k % 4).alias("second"), F.lit(None).cast("int").alias("ring"), F.lit(None).cast("int").alias("second_ring"), (k % 11 == 0).alias("near_duplicate"), F.lit(None).cast("boolean").alias("calibrated_conditioned"), F.floor(price / 1000).alias("verified_inliers"),
        F.when(F.col("o_orderstatus") != "P", price - F.floor(price / 40) * 40).alias("rotation_disagreement_deg"), (k % 50).alias("shared_final_tracks"), (F.col("o_orderpriority") == "1-URGENT").alias("trajectory_outlier"), k,
    )
    rings = images.select("name", F.col("ring").alias("r"))
    for side in ("first", "second"):
        audit = audit.join(rings.select(F.col("name").alias(side), F.col("r").alias(f"{side}_r")), side, "left")
    audit = audit.withColumn("same_ring", F.col("first_r") == F.col("second_r"))
    excuses = audit.where("o_orderkey % 997 = 0").select("first", "second", F.lit("independently_degenerate").alias("status"), F.lit("flat scene").alias("evidence"))
    model = _t(spark, sf_dir, "lineitem").agg(F.count("*").alias("observations"), F.avg(F.col("l_discount") * 40).alias("mean_reprojection_error"))
    digest = F.sha2(F.lit("model"), 256)
    model = model.join(_t(spark, sf_dir, "part").agg(F.count("*").alias("sparse_points"))).join(registered.agg(F.count("*").alias("registered_images")))
    model = model.withColumns({"model_count": F.lit(1), "model_sha256": digest, "expected_model_sha256": F.upper(digest), "snapshot_sha256": digest, "logical_sha256": digest})
    cameras = _t(spark, sf_dir, "supplier").select(F.array("s_acctbal", F.lit(1.0), F.lit(2.0)).alias("params"))
    seen = masks.projection_gate(masks.mask_projection(*_views(spark, sf_dir)), _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ring")))
    return _failed(integrity.integrity_gate(images, registered, audit, model, cameras, _track_row(spark, sf_dir), seen, _translation_row(spark, sf_dir), exclusions=excuses, expected=customer.select(F.col("c_custkey").alias("name"))))
