"""Queries of the finishing gates and of joins between models, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, gates
from .queries import _rounded, _t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _failed(df: DataFrame) -> DataFrame:
    return df.withColumn("reasons", F.array_join("reasons", ",")).drop("checks", "passed")


def _solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as measured solids."""
    k = F.col("s_suppkey")
    side = {f"{p}{a}_{e}": F.lit(v) for p in ("", "ref_") for a in "yz" for e, v in (("lo", -1.0), ("hi", 1.0))}
    return _t(spark, sf_dir, "supplier").select(
        k.alias("k"), (k % 7).alias("vertex_count"), (k % 5).alias("face_count"), (k * 1000).alias("point_count"), (k % 8 != 0).alias("has_color"), (k % 10 / 10).alias("dominant_fraction"),
        F.when(k % 11 != 0, 1.0).otherwise(0.5).alias("finite_xyz_fraction"), F.when(k % 13 != 0, 3).alias("rank"), F.when(k % 17 != 0, "passed").alias("visual_status"),
        F.when(k % 3 == 0, 0.995).when(k % 19 == 0, 0.9).alias("coverage"), F.lit(0.0).alias("x_lo"), (F.col("s_acctbal") / 1000).alias("x_hi"), F.lit(0.0).alias("ref_x_lo"), F.lit(4.0).alias("ref_x_hi"), *[v.alias(c) for c, v in side.items()],
    )


_SOLID = """CASE WHEN k % 11 = 0 THEN 'finite' END, CASE WHEN k % 13 = 0 THEN 'spatial_rank_3' END, CASE WHEN NOT (x > 0 AND x <= 8 AND covered) THEN 'plausible_bounds' END, CASE WHEN k % 17 = 0 THEN 'visual' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM (SELECT s_suppkey AS k, s_acctbal / 1000 AS x, s_suppkey % 3 = 0 OR s_suppkey % 19 <> 0 AS covered FROM supplier)"""


@_query("SELECT k, array_to_string(list_filter([CASE WHEN k % 7 = 0 THEN 'vertices' END, CASE WHEN k % 5 = 0 THEN 'faces' END, CASE WHEN k % 10 < 3 THEN 'dominant_component' END, " + _SOLID)
def mesh_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failed(gates.mesh_gate(_solids(spark, sf_dir), ["k"]))


@_query("SELECT k, k * 1000 >= 60990 AS quality_target_met, array_to_string(list_filter([CASE WHEN k * 1000 <= 6099 THEN 'more_than_sparse' END, CASE WHEN NOT covered THEN 'reference_coverage' END, CASE WHEN k % 8 = 0 THEN 'color' END, " + _SOLID)
def cloud_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failed(gates.cloud_gate(_solids(spark, sf_dir), ["k"]))


@_query("""SELECT o_custkey, count(DISTINCT o_orderkey % 4) = 4 AND bool_and(o_orderstatus <> 'P') AS passed FROM orders GROUP BY 1""")
def finished_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_custkey", (14 + F.col("o_orderkey") % 4).alias("stage"), (F.col("o_orderstatus") != "P").alias("passed"))
    return gates.integrated_success(o, ["o_custkey"])


@_query("""WITH r AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer)
SELECT k, array_to_string(list_filter([CASE WHEN n % 2 = 0 THEN 'collections' END, CASE WHEN k % 3 = 0 THEN 'raw_preserved' END, CASE WHEN k % 5 = 0 THEN 'clean_high_present' END, CASE WHEN n % 7 = 0 THEN 'brass_material' END,
  CASE WHEN k % 4 = 0 OR n = 0 THEN 'nonzero_mesh' END, CASE WHEN k % 9 = 0 THEN 'sane_transforms' END], lambda x: x IS NOT NULL), ',') AS scene,
  array_to_string(list_filter([CASE WHEN k % 4 = 0 OR n = 0 THEN 'mesh_nonzero' END, CASE WHEN n % 7 = 0 THEN 'material_present' END, CASE WHEN k % 9 = 0 THEN 'sane_bounds' END, CASE WHEN k % 6 = 0 THEN 'normals_ok' END], lambda x: x IS NOT NULL), ',') AS export FROM r""")
def scene_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    some = lambda *names: F.array_compact(F.array(*[F.when(c, F.lit(v)) for v, c in names]))
    true = F.lit(True)
    c = _t(spark, sf_dir, "customer").select(
        k.alias("k"), some(("raw", k % 3 != 0), ("clean", k % 5 != 0), ("final", true)).alias("objects"), some(("a", true), ("b", n % 2 != 0)).alias("collections"), some(("brass", n % 7 != 0)).alias("materials"),
        (k % 4).alias("final_vertex_count"), n.alias("final_face_count"), (k % 4).alias("vertex_count"), n.alias("face_count"), (k % 9 != 0).alias("sane_transforms"),
        true.alias("textures_resolve"), F.when(k % 9 != 0, True).alias("sane_bounds"), (k % 6 != 0).alias("normals_ok"), true.alias("only_final_exported"),
    )
    scene = gates.scene_gate(c, ["k", "materials", "vertex_count", "face_count", "textures_resolve", "sane_bounds", "normals_ok", "only_final_exported"], collections=["a", "b"], raw="raw", clean="clean", final="final", material="brass")
    scene = scene.withColumn("scene", F.array_join("reasons", ","))
    return gates.export_gate(scene, ["k", "scene"], material="brass").select("k", "scene", F.array_join("reasons", ",").alias("export"))


@_query("""WITH r AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'Termination.CONVERGENCE' WHEN 1 THEN 'no_convergence' WHEN 2 THEN 'success' WHEN 3 THEN 'x.FAILURE' END AS t FROM part),
g AS (SELECT k, list_filter([CASE WHEN k % 3 = 0 OR k % 5 IN (1, 3) THEN 'bundle_adjustment_not_successfully_executed' END, CASE WHEN k % 7 <> 0 THEN 'promotion_not_allowed' END, CASE WHEN k % 2 = 0 THEN 'full_sparse_candidate_not_eligible' END], lambda x: x IS NOT NULL) AS rs,
  list_filter([CASE WHEN k % 11 = 0 THEN 'residuals_configured' END, CASE WHEN k % 3 = 0 THEN 'residuals_reported' END, CASE WHEN k % 5 NOT IN (0, 2) THEN 'converged' END], lambda x: x IS NOT NULL) AS adj FROM r)
SELECT k, array_to_string(adj, ',') AS adjustment, len(rs) = 0 AS strict_gate_passed, len(rs) > 0 AS best_defensible, true AS continuation_allowed, CASE WHEN len(rs) = 0 THEN 'dense_evidence_passed' ELSE 'dense_best_defensible' END AS status, array_to_string(rs, ',') AS strict_failure_reasons FROM g""")
def solver_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    end = F.when(k % 5 == 0, "Termination.CONVERGENCE").when(k % 5 == 1, "no_convergence").when(k % 5 == 2, "success").when(k % 5 == 3, "x.FAILURE")
    p = _t(spark, sf_dir, "part").select(k.alias("k"), (k % 11).alias("configured"), (k % 3).alias("residuals"), end.alias("termination"), F.when(k % 7 == 0, True).alias("promotion_allowed"), (k % 2 != 0).alias("eligible"))
    p = gates.adjustment_gate(p, p.columns).withColumn("adjustment", F.array_join("reasons", ",")).drop("passed", "checks", "reasons")
    out = gates.completion_class(gates.process_gate(p, ["k", "adjustment"]).drop("checks"))
    return out.withColumn("strict_failure_reasons", F.array_join("strict_failure_reasons", ","))


@_query("""WITH r AS (SELECT p_partkey AS k, p_size / 50.0::DOUBLE AS b, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice / 3000 END AS c, p_partkey % 3 = 0 AS done FROM part),
s AS (SELECT *, coalesce(c, 'inf'::DOUBLE) < b AS better, coalesce(c, 0) AS f, CASE WHEN k % 5 = 0 THEN 0.5 ELSE 0.02 END AS lim FROM r)
SELECT k, better AND done AS promote, CASE WHEN better AND done THEN 'upper_recovery_improved' ELSE 'recovery_exhausted_unresolved' END AS status, better AS ratio_improved, CASE WHEN k % 4 > 1 THEN k % 4 ELSE 0 END AS second_faces, f <= lim AS fraction_proxy_passed FROM s""")
def recovery_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ratio = F.when(k % 7 != 0, F.col("p_retailprice") / 3000)
    faces = F.when(k % 4 > 1, F.array(F.lit(9).cast("bigint"), k % 4)).otherwise(F.array(F.lit(9).cast("bigint")))
    p = _t(spark, sf_dir, "part").select(k.alias("k"), (F.col("p_size") / 50.0).alias("baseline_ratio"), ratio.alias("candidate_ratio"), (k % 3 == 0).alias("candidate_resolved"), faces.alias("face_counts"), ratio.alias("second_fraction"), F.when(k % 5 == 0, 0.5).alias("second_max"))
    out = gates.detached_components(p, ["k", "baseline_ratio", "candidate_ratio", "candidate_resolved"])
    return gates.upper_recovery(out, ["k", "second_faces", "fraction_proxy_passed"])


@_query("""WITH o AS (SELECT DISTINCT l_suppkey AS image, l_partkey AS track FROM lineitem), n AS (SELECT a.image AS f, b.image AS s, count(*) AS n FROM o a JOIN o b ON a.track = b.track AND b.image = a.image + 1 GROUP BY 1, 2)
SELECT s_suppkey AS first, s_suppkey + 1 AS second, coalesce(n, 0) AS shared_tracks FROM supplier LEFT JOIN n ON f = s_suppkey""")
def shared_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), F.col("l_partkey").alias("track"))
    pairs = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("first"), (F.col("s_suppkey") + 1).alias("second"))
    return evidence.shared_tracks(pairs, seen)


@_query("""WITH v AS (SELECT vec_id AS k, CAST(embedding[1] AS DOUBLE) / 8 AS d FROM embeddings WHERE vec_id % 5 <> 0)
SELECT count(*) AS common_view_count, max(k % 7)::DOUBLE AS rotation_geodesic_max_deg, round(max(abs(d)), 6) AS center_delta_max_m, false AS pose_field_unchanged FROM v""")
def pose_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k, zero, one = _t(spark, sf_dir, "embeddings"), F.col("vec_id"), F.lit(0.0), F.lit(1.0)

    def model(turn, move):
        t = F.radians((k % 360 + turn).cast("double"))
        center = F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 3)
        return e.select(k.alias("name"), F.array(F.cos(t), -F.sin(t), zero, F.sin(t), F.cos(t), zero, zero, zero, one).alias("rotation"), F.transform(center, lambda x, i: F.when(i == 0, x + move * x).otherwise(x)).alias("center"))

    return _rounded(evidence.pose_delta(model(F.lit(0), 0.0), model(k % 7, 0.125).where("name % 5 <> 0")), "rotation_geodesic_max_deg", "center_delta_max_m")


@_query("""SELECT o_orderkey AS pair_id, o_totalprice AS score, coalesce(c_acctbal > 0 AND o_orderkey % 3 <> 0, false) AS well_conditioned_calibrated FROM orders LEFT JOIN customer ON c_custkey = o_orderkey""")
def conditioned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_id"), F.col("o_totalprice").alias("score"))
    k = F.col("c_custkey")
    return evidence.conditioned_records(audit, _t(spark, sf_dir, "customer").select(k.alias("pair_id"), F.when(k % 3 != 0, F.col("c_acctbal") > 0).alias("well_conditioned_calibrated")))


@_query("""WITH e AS (SELECT user_id AS name, event_type AS ring, event_id * 2 AS pos FROM events UNION ALL SELECT event_id % 97, 'r' || event_id % 3, event_id * 2 + 1 FROM events) SELECT name, arg_max(ring, pos) AS ring FROM e GROUP BY 1""")
def image_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    edges = _t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("first"), F.col("event_type").alias("ring"), (k % 97).alias("second"), F.concat(F.lit("r"), (k % 3).cast("string")).alias("second_ring"))
    return evidence.image_rings(edges, "event_id")
