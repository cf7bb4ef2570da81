"""Queries of assembled graphs, affected tiles and depth between rings, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly
from ..operators.graph import INLIER, OUTLIER
from ..operators.rotation import SAME
from .greedy import joined
from .queries import _rounded, _t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as images of four rings, each paired with the next five; every seventh name is a near duplicate of the one five before."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.floor(F.abs("s_acctbal") / 60).alias("v"))
    stem = lambda k: F.concat(F.lit("IMG"), F.lpad(F.when(k % 7 == 0, k - 4).otherwise(k).cast("string"), 9, "0"), F.when(k % 7 == 0, "_01").otherwise(""), F.lit(".jpg"))
    far = s.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(5)))).join(s.select(F.col("k").alias("m"), F.col("v").alias("w")), F.col("k") + F.col("d") == F.col("m"))
    pairs = far.select((F.col("k") * 10 + F.col("d")).alias("pair_id"), stem(F.col("k")).alias("first"), stem(F.col("m")).alias("second"), (F.col("v") + F.col("w")).alias("inliers"))
    meta = s.where("k % 41 <> 40").select(stem(F.col("k")).alias("name"), F.concat(F.lit("r"), F.floor(F.col("k") / 8) % 4).alias("ring"), F.col("k").alias("frame"))
    return pairs, meta


_NAME = "'IMG' || lpad(CAST(CASE WHEN {0} % 7 = 0 THEN {0} - 4 ELSE {0} END AS VARCHAR), 9, '0') || CASE WHEN {0} % 7 = 0 THEN '_01' ELSE '' END || '.jpg'"


@_query(f"""WITH s AS (SELECT s_suppkey AS k, CAST(floor(abs(s_acctbal) / 60) AS BIGINT) AS v, {_NAME.format("s_suppkey")} AS name, CAST(floor(s_suppkey / 8) % 4 AS BIGINT) AS ring FROM supplier),
c AS (SELECT a.k * 10 + d AS pair_id, a.name AS f, b.name AS s, a.ring AS fr, b.ring AS sr, a.k AS fk, b.k AS sk, d, a.v + b.v AS inliers FROM s a, (SELECT unnest(range(1, 6)) AS d) JOIN s b ON b.k = a.k + d WHERE a.k % 41 <> 40 AND b.k % 41 <> 40),
e AS (SELECT *, fr = sr AS same, abs(fr - sr) = 1 AS beside, fr = sr AND NOT (sk % 7 = 0 AND d = 4) AND NOT (fk % 7 = 0 AND sk % 7 > 0 AND fk - 4 = sk) AND d <= 4 AND inliers >= 80 AS near FROM c),
l AS (SELECT list({{'p': pair_id, 'a': f, 'b': s, 'near': beside}} ORDER BY inliers DESC, f, s) AS l FROM e WHERE NOT same AND inliers >= 50),
r AS (SELECT list_reduce(l, lambda acc, x: list_transform([CASE WHEN len(list_filter(acc.u, lambda q: q = x.a)) >= 2 OR len(list_filter(acc.u, lambda q: q = x.b)) >= 2 THEN 'cross_ring_per_image_cap' WHEN NOT x.near THEN 'non_adjacent_ring_edge' ELSE 'cross_ring_verified_support_pending_cap' END],
  lambda w: {{'u': CASE WHEN w LIKE '%cap' AND w LIKE '%pending%' THEN acc.u || [x.a, x.b] ELSE acc.u END, 'o': list_append(acc.o, {{'p': x.p, 'r': w}})}})[1], {{'u': CAST([] AS VARCHAR[]), 'o': CAST([] AS STRUCT(p BIGINT, r VARCHAR)[])}}) AS z FROM l),
o AS (SELECT q.p AS pair_id, q.r AS pick FROM (SELECT unnest(z.o) AS q FROM r)),
b AS (SELECT arg_max(pair_id, (inliers, f, s)) AS pair_id FROM e JOIN o USING (pair_id) WHERE beside GROUP BY least(fr, sr) HAVING NOT bool_or(pick LIKE '%pending%'))
SELECT pair_id, inliers, CASE WHEN same THEN near ELSE coalesce(pick LIKE '%pending%', false) OR pair_id IN (SELECT pair_id FROM b) END AS selected,
  CASE WHEN same AND near THEN 'same_ring_local_verified' WHEN same THEN 'same_ring_duplicate_or_weak_or_nonlocal' WHEN pair_id IN (SELECT pair_id FROM b) THEN 'boundary_bridge_rescue' ELSE coalesce(pick, 'cross_ring_weak_verified_support') END AS reason FROM e LEFT JOIN o USING (pair_id)""")
def corrected_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.corrected_graph(*_pairs(spark, sf_dir), ["r0", "r1", "r2", "r3"]).select("pair_id", "inliers", "selected", "reason")


@_query(f"""WITH e AS (SELECT a.s_suppkey * 10 + d AS pair_id, a.s_suppkey AS f, a.s_suppkey + d AS s, a.s_suppkey % 3 > 0 AND d > 1 AND (a.s_suppkey + d) % 4 > 0 AS base, CAST(floor(abs(a.s_acctbal) / 100) AS BIGINT) AS inliers, a.s_suppkey % 5 / 10 AS h FROM supplier a, (SELECT unnest([1, 2, 3]) AS d) JOIN supplier b ON b.s_suppkey = a.s_suppkey + d),
l AS (SELECT list({{'p': pair_id, 'u': f << 32, 'v': s << 32, 'b': base}} ORDER BY base DESC, inliers DESC, CASE WHEN h = 0 THEN 1.0 ELSE h END, pair_id) AS l FROM e),
g AS (SELECT list_reduce(l, lambda acc, x: list_transform([{joined("acc.t", "x.u", "x.v")}], lambda w: {{'t': w.t, 'o': list_append(acc.o, {{'p': x.p, 'k': CASE WHEN x.b THEN 'base' WHEN coalesce(list_contains(list_filter(acc.t, lambda q: list_contains(q, x.u))[1], x.v), false) THEN 'excluded' ELSE 'bridge' END}})}})[1], {{'t': CAST([] AS BIGINT[][]), 'o': CAST([] AS STRUCT(p BIGINT, k VARCHAR)[])}}) AS z FROM l)
SELECT o.p AS pair_id, o.k AS kind FROM (SELECT unnest(z.o) AS o FROM g)""")
def mapper_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier")
    k, m = F.col("s_suppkey"), F.col("s_suppkey") + F.col("d")
    e = s.withColumn("d", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).join(s.select(F.col("s_suppkey").alias("m")), F.col("m") == m)
    records = e.select((k * 10 + F.col("d")).alias("pair_id"), k.alias("first"), m.alias("second"), F.floor(F.abs("s_acctbal") / 100).alias("inliers"), F.lit(1.0).alias("tri_angle"), (k % 5 / 10).alias("homography"), F.when((k % 3 > 0) & (F.col("d") > 1) & (m % 4 > 0), F.when(k % 2 == 0, SAME).otherwise(INLIER)).otherwise(OUTLIER).alias("status"))
    return assembly.mapper_graph(records.drop("status"), records.select("first", "second", "status")).select("pair_id", "kind")


@_query("""WITH i AS (SELECT p_partkey AS name, p_partkey AS pos, p_partkey // 24 AS tile FROM part), c AS (SELECT p_partkey AS name FROM part WHERE p_retailprice > 900 AND p_partkey % 53 = 7),
d AS (SELECT tile, name, true AS own FROM i UNION ALL SELECT tile, l_suppkey, false FROM lineitem JOIN i ON i.name = l_partkey),
n AS (SELECT tile, name, max(own) AS own FROM d WHERE name IN (SELECT name FROM c) GROUP BY 1, 2), g AS (SELECT tile, array_to_string(list(name ORDER BY name) FILTER (own), ',') AS a, array_to_string(list(name ORDER BY name), ',') AS b FROM n GROUP BY 1)
SELECT i.tile AS tile, min(pos) AS start, count(*) AS images, coalesce(any_value(a), '') AS changed_images, coalesce(any_value(b), '') AS changed_dependencies, any_value(b) IS NOT NULL AS affected FROM i LEFT JOIN g USING (tile) GROUP BY i.tile""")
def affected_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images whose lines' suppliers are their sources."""
    part = _t(spark, sf_dir, "part")
    images = part.select(F.col("p_partkey").alias("name"), F.col("p_partkey").alias("pos"))
    sources = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ref"), F.col("l_suppkey").alias("source"))
    out = assembly.affected_tiles(images, sources, part.where("p_retailprice > 900 and p_partkey % 53 = 7").select(F.col("p_partkey").alias("name")))
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("changed_images", "changed_dependencies")})


def _depths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as pixels of twelve depth maps of a slope, nations as their cameras in a row."""
    k = F.col("o_orderkey")
    z = 4 + F.pmod(k, F.lit(40)) / 40.0 + F.when(k % 17 == 0, 0.5).otherwise(0.0)
    pixels = _t(spark, sf_dir, "orders").groupBy((k % 12).alias("image"), (F.floor(k / 12) % 40).alias("x"), (F.floor(k / 480) % 30).alias("y")).agg(F.min(z).alias("depth"), F.min(F.col("o_orderstatus") != "P").alias("inside"))
    n = F.col("n_nationkey")
    row = [F.lit(float(v)) for v in (1, 0, 0)]
    pose = F.array(*row, n / 10.0, F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))
    cameras = _t(spark, sf_dir, "nation").where("n_nationkey < 14").select(n.alias("image"), pose.alias("m"), F.array(*[F.lit(float(v)) for v in (40, 40, 20, 15)]).alias("k"))
    two = cameras.select(F.col("image").alias("ref")).join(cameras.select(F.col("image").alias("source")), F.abs(F.col("ref") - F.col("source")).between(1, 5))
    return two.select("ref", "source", (F.col("ref") % 3).alias("ring"), (F.col("source") % 3).alias("source_ring")), pixels, cameras


_DEPTHS = """px AS (SELECT o_orderkey % 12 AS image, CAST(floor(o_orderkey / 12) % 40 AS BIGINT) AS x, CAST(floor(o_orderkey / 480) % 30 AS BIGINT) AS y, min(4 + (o_orderkey % 40) / 40 + CASE WHEN o_orderkey % 17 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS depth, bool_and(o_orderstatus <> 'P') AS inside FROM orders GROUP BY 1, 2, 3),
gd AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY y, x) - 1 AS nr, count(*) OVER (PARTITION BY image) AS n FROM px WHERE inside),
wn AS (SELECT DISTINCT image, CASE WHEN j > 0 AND j = least(n, 100) - 1 THEN n - 1 ELSE CAST(floor(j * ((n - 1) / (least(n, 100) - 1))) AS BIGINT) END AS nr FROM (SELECT DISTINCT image, n FROM gd), (SELECT unnest(range(0, 100)) AS j) WHERE j < least(n, 100)),
sp AS (SELECT image, x, y, depth FROM gd JOIN wn USING (image, nr)),
ed AS (SELECT a.n_nationkey AS ref, b.n_nationkey AS source, a.n_nationkey % 3 AS ring, b.n_nationkey % 3 AS source_ring FROM nation a, nation b WHERE abs(a.n_nationkey - b.n_nationkey) BETWEEN 1 AND 5 AND a.n_nationkey < 14 AND b.n_nationkey < 14 AND a.n_nationkey % 3 <> b.n_nationkey % 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY ring, source_ring ORDER BY ref, source) - 1 AS nr, count(*) OVER (PARTITION BY ring, source_ring) AS pairs FROM ed),
se AS (SELECT ring, source_ring, ref, source, pairs FROM rk WHERE nr = pairs - 1 OR nr IN (0, CAST(floor((pairs - 1) / 3) AS BIGINT), CAST(floor(2 * ((pairs - 1) / 3)) AS BIGINT))),
pr AS (SELECT se.*, 40 * (((x - 20) / 40 * depth - ref / 10) + source / 10) / depth + 20 AS u, 40 * ((y - 15) / 40 * depth) / depth + 15 AS v, depth AS z FROM se JOIN sp ON image = ref),
ht AS (SELECT pr.ring, pr.source_ring, pr.ref, pr.source, pr.pairs, z, g.depth AS d, 2 * abs(z - g.depth) / (z + g.depth) AS rel FROM pr LEFT JOIN gd g ON g.image = pr.source AND g.x = round_even(u, 0) AND g.y = round_even(v, 0)),
fg AS (SELECT ref, source, count(*) AS sampled, count(d) AS overlap, count(d) / count(*) AS coverage, avg((rel <= 0.01)::INT) AS consistency, quantile_cont(rel, 0.5) AS median, quantile_cont(rel, 0.95) AS p95 FROM ht GROUP BY 1, 2),
dp AS (SELECT se.*, coalesce(sampled, 0) AS sampled, coalesce(overlap, 0) AS overlap, coverage, consistency, median, p95,
  CASE WHEN ref NOT IN (SELECT image FROM px) OR source NOT IN (SELECT image FROM px) THEN 'depth_map_missing' WHEN ref NOT IN (SELECT image FROM gd) THEN 'reference_depth_has_no_valid_pixels' WHEN coalesce(overlap, 0) = 0 THEN 'no_cross_view_overlap' ELSE 'measured' END AS status FROM se LEFT JOIN fg USING (ref, source))"""


@_query(f"WITH {_DEPTHS} SELECT ref, source, sampled, overlap, " + ", ".join(f"CASE WHEN status = 'measured' THEN round({c}, 6) END AS {c}" for c in ("coverage", "consistency", "median", "p95")) + ", status FROM dp")
def depth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, pixels, cameras = _depths(spark, sf_dir)
    out = assembly.depth_pairs(assembly.spread_edges(edges), pixels, cameras, most=100)
    return _rounded(out, "coverage", "consistency", "median", "p95").select("ref", "source", "sampled", "overlap", "coverage", "consistency", "median", "p95", "status")


@_query(f"""WITH {_DEPTHS}, t AS (SELECT ring, source_ring, pairs, count(*) AS selected_pairs, count(*) FILTER (status = 'measured') AS measured_pairs, coalesce(avg(coverage) FILTER (status = 'measured'), 0) AS mean_coverage, coalesce(avg(consistency) FILTER (status = 'measured'), 0) AS mean_consistency FROM dp GROUP BY 1, 2, 3)
SELECT ring, source_ring, pairs, selected_pairs, measured_pairs, round(mean_coverage, 6) AS mean_coverage, round(mean_consistency, 6) AS mean_consistency, CASE WHEN measured_pairs = selected_pairs AND mean_coverage BETWEEN 0.01 AND 1 THEN 'passed' ELSE 'failed' END AS status,
  CASE WHEN measured_pairs = selected_pairs AND mean_coverage BETWEEN 0.01 AND 1 AND mean_consistency >= 0.5 THEN 'passed' ELSE 'below_threshold' END AS diagnostic_status FROM t""")
def ring_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(assembly.ring_transitions(*_depths(spark, sf_dir), most_pixels=100), "mean_coverage", "mean_consistency").drop("acceptance_basis")
