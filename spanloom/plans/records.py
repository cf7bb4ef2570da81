"""Queries of record hashes, small rules, counts and evidence summaries, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import evidence, gates, stats
from .oracle import ORACLE as _BEFORE
from .queries import QUERIES as _FIRST
from .queries import _frames, _rounded, _t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@_query("SELECT event_id, printf('%g', value * CASE event_id % 3 WHEN 0 THEN 100000.0::DOUBLE WHEN 1 THEN 0.0001::DOUBLE ELSE 1.0::DOUBLE END) AS text FROM events")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = F.when(F.col("event_id") % 3 == 0, 100000.0).when(F.col("event_id") % 3 == 1, 0.0001).otherwise(1.0)
    return _t(spark, sf_dir, "events").select("event_id", E.number_text(F.col("value") * scale).alias("text"))


@_query("""SELECT o_custkey, sha256('[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']') AS ids_sha256, sha256(string_agg('o' || o_orderkey || chr(10), '' ORDER BY o_orderkey)) AS names_sha256,
  sha256('[' || string_agg('["a' || o_orderkey || '","b' || o_orderkey || '"]', ',' ORDER BY o_orderkey) || ']') AS schedule_sha256 FROM orders GROUP BY 1""")
def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    text = lambda k: lambda i: F.concat(F.lit(k), i.cast("string"))
    pairs = F.transform("ids", lambda i: F.struct(text("b")(i).alias("a"), text("a")(i).alias("b")))
    return ids.select("o_custkey", E.id_list_sha256("ids").alias("ids_sha256"), E.names_sha256(F.transform("ids", text("o"))).alias("names_sha256"), E.schedule_sha256(pairs).alias("schedule_sha256"))


@_query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') AS record_sha256,
  sha256('{"feature_mask_sha256":"' || sha256(c_mktsegment) || '","model_identity":{"name":"m' || c_nationkey || '"},"source_sha256":"' || sha256(c_name) || '"}') AS cache_sha256 FROM customer""")
def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    model = F.struct(F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("name"))
    return c.select("c_custkey", E.canonical_sha256("c_name", "c_custkey", "c_mktsegment").alias("record_sha256"), E.cache_identity(F.sha2("c_name", 256), F.sha2("c_mktsegment", 256), model).alias("cache_sha256"))


@_query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN greatest(1.0::DOUBLE, l_quantity) ELSE greatest(0.001::DOUBLE, greatest(1.0::DOUBLE, l_quantity) * 0.001::DOUBLE) END AS weight,
  l_discount = l_tax AS matches, round(degrees(l_discount), 9) AS degrees, CASE WHEN l_quantity - 25 >= 0 THEN round(degrees(l_quantity - 25), 9) END AS angle
FROM lineitem WHERE l_linenumber - 2 >= 0 AND l_linenumber - 2 < l_quantity AND l_quantity - 3 >= 0 AND l_quantity - 3 < 40""")
def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _t(spark, sf_dir, "lineitem").where(E.in_bounds(F.col("l_linenumber") - 2, F.col("l_quantity") - 3, "l_quantity", F.lit(40)))
    out = m.select("l_orderkey", "l_linenumber", E.edge_weight("l_quantity", F.col("l_returnflag") == "N").alias("weight"), E.equals_measured("l_discount", "l_tax").alias("matches"), E.degrees_or_null("l_discount").alias("degrees"), E.optional_angle_deg(F.col("l_quantity") - 25).alias("angle"))
    return _rounded(out, "degrees", "angle", places=9)


@_query("""WITH b AS (SELECT l_partkey, min(l_quantity) AS x, min(l_linenumber)::DOUBLE AS y, max(l_quantity) - min(l_quantity) + 1 AS w, max(l_suppkey)::DOUBLE * 3 AS h FROM lineitem GROUP BY 1)
SELECT l_partkey, greatest(0.0::DOUBLE, x - greatest(8.0::DOUBLE, round_even(w * 0.08::DOUBLE, 0))) AS x1, greatest(0.0::DOUBLE, y - greatest(8.0::DOUBLE, round_even(h * 0.08::DOUBLE, 0))) AS y1,
       least(55.0::DOUBLE, x + w + greatest(8.0::DOUBLE, round_even(w * 0.08::DOUBLE, 0))) AS x2, least(400.0::DOUBLE, y + h + greatest(8.0::DOUBLE, round_even(h * 0.08::DOUBLE, 0))) AS y2 FROM b""")
def padded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_quantity").alias("x"), F.min("l_linenumber").cast("double").alias("y"), (F.max("l_quantity") - F.min("l_quantity") + 1).alias("w"), (F.max("l_suppkey").cast("double") * 3).alias("h"))
    box = E.padded_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(55), F.lit(400))
    return b.withColumn("box", box).select("l_partkey", *[F.col("box")[i].alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))])


@_query("""WITH m AS (SELECT o_orderkey, CAST(floor(o_totalprice * 10) AS BIGINT) AS faces, o_custkey * 1000000 AS size, o_orderpriority AS p FROM orders),
u AS (SELECT *, NOT (faces <= 750000 AND size <= 536870912) AS used, least(500000, greatest(100000, faces // 2)) AS target FROM m)
SELECT o_orderkey, used, CASE WHEN used THEN target ELSE 0 END AS target_faces, CASE WHEN used THEN round(target / faces, 9) ELSE 0 END AS target_ratio,
       CASE WHEN p = '1-URGENT' AND o_orderkey % 2 = 0 THEN 1600 ELSE 0 END AS oom_size, CASE WHEN p IN ('1-URGENT', '2-HIGH') AND o_orderkey % 3 = 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 1600 ELSE 1200 END ELSE 0 END AS retry_size FROM u""")
def small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").withColumns({"faces": F.floor(F.col("o_totalprice") * 10), "bytes": F.col("o_custkey") * 1_000_000, "px": F.when(F.col("o_orderkey") % 2 == 0, 2000).otherwise(1600)})
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "cuda_oom").otherwise("other")
    why = F.when(F.col("o_orderpriority") == "1-URGENT", "resource").when(F.col("o_orderpriority") == "2-HIGH", "timeout").otherwise("other")
    out = o.select("o_orderkey", E.simplification("faces", "bytes").alias("s"), E.smaller_after_oom(kind, "px").alias("oom_size"), E.smaller_after_failure(F.col("o_orderkey") % 3, F.lit("failed"), why, "px").alias("retry_size"))
    none = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("target_faces", "target_ratio", "oom_size", "retry_size")}
    return out.select("o_orderkey", "s.used", "s.target_faces", F.round("s.target_ratio", 9).alias("target_ratio"), "oom_size", "retry_size").withColumns(none)


@_query("""SELECT p_partkey, CAST(CAST(p_retailprice AS FLOAT) * CAST(4080 / 1024.0::DOUBLE AS FLOAT) AS DOUBLE) AS x,
  printf('%.12g', p_size / sqrt(1872.0::DOUBLE) * sqrt(CAST(p_partkey AS DOUBLE) * p_partkey + 9.0)) || ',' || printf('%.12g', p_partkey / 2.0::DOUBLE) || ',1.5,0' AS camera FROM part""")
def camera_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", E.to_original("p_retailprice", 1024, 4080).cast("double").alias("x"), E.camera_params("p_size", F.col("p_partkey").cast("double"), F.lit(3.0)).alias("camera"))


@_query("""SELECT 'image_count' AS metric, count(*) AS value FROM orders UNION ALL SELECT 'camera_count', count(*) FROM customer UNION ALL SELECT 'keypoint_rows', CAST(sum(p_size) AS BIGINT) FROM part
UNION ALL SELECT 'match_pair_rows', count(*) FROM lineitem UNION ALL SELECT 'raw_match_rows', CAST(sum(l_quantity) AS BIGINT) FROM lineitem
UNION ALL SELECT 'verified_pair_rows', count(*) FROM lineitem WHERE l_linenumber - 2 > 0 UNION ALL SELECT 'verified_inlier_rows', CAST(sum(l_linenumber - 2) AS BIGINT) FROM lineitem""")
def database_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _t(spark, sf_dir, "lineitem")
    return stats.database_counts(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "part").select(F.col("p_size").alias("rows")), m.select(F.col("l_quantity").alias("rows")), m.select((F.col("l_linenumber") - 2).alias("rows")))


@_query("""SELECT count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderpriority)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM orders""")
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.logical_digest(_t(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"])


@_query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, '' AS blur, c_name FROM customer")
def public_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.public_rows(_t(spark, sf_dir, "customer"), ["c_custkey", "blur", "c_name"])


@_query(f"""WITH p AS ({_BEFORE["pair_schedule"]}), n AS (SELECT a AS name FROM p UNION SELECT b FROM p), o AS ({_BEFORE["offset_vote"]})
SELECT 'selected_geometry_count' AS metric, count(DISTINCT event_id) AS value FROM events UNION ALL SELECT 'schedule_pair_count', count(*) FROM p UNION ALL SELECT 'schedule_image_coverage', count(*) FROM n
UNION ALL SELECT 'images_without_pair', count(DISTINCT event_id) FROM events WHERE event_id NOT IN (SELECT name FROM n) UNION ALL SELECT 'ambiguous_offset_count', count(*) FILTER (ambiguous) FROM o""")
def pairing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pairing_summary(_frames(spark, sf_dir), _FIRST["pair_schedule"](spark, sf_dir), _FIRST["offset_vote"](spark, sf_dir))


@_query("""SELECT page_id % 10 AS g, count(*) FILTER (page_id % 2 = 0 AND page_id % 3 = 0) AS photometric_depth_count, count(*) FILTER (page_id % 2 = 1 AND page_id % 3 = 0) AS photometric_normal_count,
  count(*) FILTER (page_id % 2 = 0 AND page_id % 3 = 1) AS geometric_depth_count, count(*) FILTER (page_id % 2 = 1 AND page_id % 3 = 1) AS geometric_normal_count FROM pages GROUP BY 1""")
def map_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    kind = F.when(k % 3 == 0, "photometric.bin").when(k % 3 == 1, "geometric.bin").otherwise("geometric.binary")
    path = F.concat(F.lit("w/stereo/"), F.when(k % 2 == 0, "depth_maps").otherwise("normal_maps"), F.lit("/i.jpg."), kind)
    return stats.map_file_counts(_t(spark, sf_dir, "pages").select((k % 10).alias("g"), path.alias("path")), ["g"])


@_query("""WITH r AS (SELECT o_custkey AS k, o_orderkey % 8 AS region, max(o_totalprice) / 500000 AS a, count(*) / 4.0::DOUBLE AS b FROM orders GROUP BY 1, 2)
SELECT k, CASE WHEN count(*) = 8 AND bool_and(a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1) THEN round(avg(a), 6) END AS a_mean, CASE WHEN count(*) = 8 AND bool_and(a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1) THEN round(avg(b), 6) END AS b_mean FROM r GROUP BY 1""")
def region_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 8).alias("region")).agg((F.max("o_totalprice") / 500000).alias("a"), (F.count("*") / 4.0).alias("b"))
    return _rounded(stats.region_means(r, ["k"], ["a", "b"]), "a_mean", "b_mean")


@_query("""WITH s AS (SELECT c_nationkey AS k, count(*) FILTER (c_acctbal > -900) AS m, count(*) AS n, avg(c_acctbal) / 10000 AS cov, avg(CASE WHEN c_acctbal > 4000 THEN 1.0 ELSE 0.0 END) AS con FROM customer GROUP BY 1)
SELECT k, CASE WHEN m = n AND cov BETWEEN 0.01 AND 1 THEN 'passed' ELSE 'failed' END AS status, CASE WHEN m = n AND cov BETWEEN 0.01 AND 1 AND con >= 0.5 THEN 'passed' ELSE 'below_threshold' END AS diagnostic_status,
  CASE WHEN m = n AND cov BETWEEN 0.01 AND 1 THEN 'all_selected_source_z_pairs_measured_with_masked_overlap' ELSE 'incomplete_or_insufficient_source_z_measurements' END AS acceptance_basis FROM s""")
def transition_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k"))
    rows = c.agg(F.count_if(F.col("c_acctbal") > -900).alias("measured_pairs"), F.count("*").alias("selected_pairs"), (F.avg("c_acctbal") / 10000).alias("mean_coverage"), F.avg((F.col("c_acctbal") > 4000).cast("double")).alias("mean_consistency"))
    return gates.transition_gate(rows)


@_query("""WITH a AS (SELECT l_partkey % 40 AS g, min(l_quantity) AS xl, max(l_quantity) AS xh, min(l_discount) AS yl, max(l_discount) AS yh, min(l_tax) AS zl, max(l_tax) AS zh FROM lineitem GROUP BY 1)
SELECT g, xh > xl AND yh > yl AND zh > zl AND 10 > g % 12 AND xl >= 20 - (40 - 20) AND xh <= 40 + 20 AND yl >= 0.02 - (0.08 - 0.02) AND yh <= 0.08 + 0.06 AND zl >= -1 AND zh <= 2 AND (g % 3 <> 1) AS passed FROM a""")
def bounds_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = (F.col("l_partkey") % 40).alias("g")
    aggs = [f(c).alias(f"{a}_{e}") for a, c in (("x", "l_quantity"), ("y", "l_discount"), ("z", "l_tax")) for e, f in (("lo", F.min), ("hi", F.max))]
    rows = _t(spark, sf_dir, "lineitem").groupBy(g).agg(*aggs)
    # A reference without a span, in some groups, and a coverage that is missing in others.
    ref = {"ref_x_lo": F.lit(20.0), "ref_x_hi": F.lit(40.0), "ref_y_lo": F.lit(0.02), "ref_y_hi": F.lit(0.08), "ref_z_lo": F.lit(0.0), "ref_z_hi": F.when(F.col("g") % 12 < 10, 1.0).otherwise(0.0), "coverage": F.when(F.col("g") % 3 == 0, 0.99).when(F.col("g") % 3 == 1, 0.5)}
    return gates.bounds_gate(rows.withColumns(ref), ["g"]).select("g", "passed")


@_query("""WITH j AS (SELECT event_id, user_id, event_id % 5 <> 0 AS same, CASE WHEN event_id % 97 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 11 <> 0 THEN value END AS c, CASE WHEN event_id % 7 <> 0 THEN abs(value - 50) * (event_id % 13) END AS r FROM events),
u AS (SELECT * FROM j WHERE same AND c IS NOT NULL),
m AS (SELECT user_id, median(c) FILTER (NOT isnan(c)) AS mc, median(r) AS mr FROM u GROUP BY 1),
d AS (SELECT user_id, any_value(mc) + 3 * greatest(median(abs(c - mc)) FILTER (NOT isnan(c)), 1e-9) AS tc, any_value(mr) + 3 * greatest(median(abs(r - mr)), 1e-9) AS tr FROM u JOIN m USING (user_id) GROUP BY 1)
SELECT event_id, same AND c IS NOT NULL AND (coalesce(NOT isnan(c) AND c > tc, false) OR coalesce(r > tr, false)) AS is_outlier FROM j LEFT JOIN d USING (user_id)""")
def ray_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    j = _t(spark, sf_dir, "events").select("event_id", "user_id", (k % 5 != 0).alias("same"), F.when(k % 97 == 0, float("nan")).when(k % 11 != 0, F.col("value")).alias("c"), F.when(k % 7 != 0, F.abs(F.col("value") - 50) * (k % 13)).alias("r"))
    return evidence.trajectory_outliers(j, "user_id", "c", "r", "same", scale=3.0).select("event_id", "is_outlier")


@_query("""WITH c AS (SELECT vec_id AS k, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, cos(radians(vec_id % 360)) AS co, sin(radians(vec_id % 360)) AS si FROM embeddings),
p AS (SELECT a.k, b.co, b.si, a.e[4] AS tx, a.e[5] AS ty, a.e[6] AS tz, b.e[1] - a.e[1] AS dx, b.e[2] - a.e[2] AS dy, b.e[3] - a.e[3] AS dz FROM c a JOIN c b ON b.k = a.k + 1 WHERE a.k % 10 <> 0),
q AS (SELECT *, sqrt(tx * tx + ty * ty + tz * tz) AS t, sqrt(dx * dx + dy * dy + dz * dz) AS d FROM p),
w AS (SELECT *, -(co * tx + si * ty) / t AS wx, -(co * ty - si * tx) / t AS wy, -tz / t AS wz FROM q),
s AS (SELECT *, dx * wx + dy * wy + dz * wz AS scale FROM w),
r AS (SELECT scale, sqrt((dx - scale * wx) ** 2 + (dy - scale * wy) ** 2 + (dz - scale * wz) ** 2) / d AS res, degrees(acos(greatest(-1.0, least(1.0, scale / d)))) AS err FROM s)
SELECT count(*) AS evaluated_edge_count, round(quantile_cont(err, 0.9), 6) AS direction_error_p90, round(quantile_cont(res, 0.9), 6) AS orthogonal_residual_p90, round(avg(CASE WHEN scale > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS positive_fraction FROM r""")
def translation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"), F.radians((F.col("vec_id") % 360).cast("double")).alias("t"))
    zero, one = F.lit(0.0), F.lit(1.0)
    cameras = e.select(F.col("vec_id").alias("name"), F.slice("e", 1, 3).alias("center"), F.array(F.cos("t"), -F.sin("t"), zero, F.sin("t"), F.cos("t"), zero, zero, zero, one).alias("rotation"))
    edges = e.select(F.col("vec_id").alias("pair_id"), F.col("vec_id").alias("first"), (F.col("vec_id") + 1).alias("second"), F.slice("e", 4, 3).alias("translation"), (F.col("vec_id") % 10 != 0).alias("conditioned"))
    return _rounded(evidence.translation_summary(evidence.translation_edges(edges, cameras)), "direction_error_p90", "orthogonal_residual_p90", "positive_fraction")


@_query("""WITH r AS (SELECT s_suppkey AS k, s_acctbal / 40000 AS b, s_acctbal / 200000 AS w, s_acctbal / 90000 AS c, s_suppkey % 4 = 0 AS slab, s_suppkey % 9 <> 0 AS vessel FROM supplier)
SELECT k, array_to_string(list_filter([CASE WHEN NOT (b BETWEEN 0 AND 1) THEN 'contamination_metrics_explicit' END, CASE WHEN NOT (b BETWEEN 0 AND 1 AND b < 0.2) THEN 'board_not_dominant' END,
  CASE WHEN NOT (w BETWEEN 0 AND 1 AND w < 0.05) THEN 'pedestal_board_webbing_not_dominant' END, CASE WHEN NOT (c BETWEEN 0 AND 1 AND c < 0.1) THEN 'cloth_or_background_not_dominant' END,
  CASE WHEN slab THEN 'board_slab_absent' END, CASE WHEN k % 5 = 0 THEN 'pedestal_board_webbing_absent' END, CASE WHEN NOT vessel THEN 'vessel_identity_confirmed' END, CASE WHEN k % 5 = 0 THEN 'contamination_findings_explicit' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r""")
def contamination_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("s_suppkey"), F.col("s_acctbal")
    lit = lambda *names: [F.lit(n) for n in names]
    metrics = F.map_from_arrays(F.array(*lit("board_point_fraction", "pedestal_board_webbing_point_fraction", "cloth_or_background_point_fraction")), F.array(v / 40000, v / 200000, v / 90000))
    findings = F.map_from_arrays(F.array(*lit("board_slab_detected", "pedestal_board_webbing_detected", "cloth_or_background_structure_detected", "vessel_identity_confirmed")), F.array(k % 4 == 0, F.when(k % 5 != 0, False), F.lit(False), k % 9 != 0))
    rows = _t(spark, sf_dir, "supplier").select(k.alias("k"), metrics.alias("contamination_metrics"), findings.alias("contamination_findings"))
    return gates.contamination_gate(rows, ["k"]).select("k", F.array_join("reasons", ",").alias("reasons"))


@_query("""SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY list_position(['MACHINERY', 'AUTOMOBILE', 'BUILDING'], c_mktsegment), c_custkey) AS place FROM customer WHERE c_mktsegment IN ('MACHINERY', 'AUTOMOBILE', 'BUILDING')""")
def listed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = E.list_rank("c_mktsegment", ["MACHINERY", "AUTOMOBILE", "BUILDING"])
    c = _t(spark, sf_dir, "customer").withColumn("rank", rank).where("rank > 0")
    return c.select("c_nationkey", "c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("rank", "c_custkey")).alias("place"))
