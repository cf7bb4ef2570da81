"""Queries of final poses, overrides, the basis of an object and the registered manifest, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import poses
from .queries import _points, _t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


_VECTORS = "v AS (SELECT vec_id AS k, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def _tidy(c, places: int = 5):
    return F.round(c, places) + 0.0


@_query(f"""WITH {_VECTORS}, p AS (SELECT a.k AS k, b.k AS m, a.e AS e, b.e AS f, CAST(abs((a.k * 7) % 90 - (b.k * 7) % 90) AS DOUBLE) AS d FROM v a LEFT JOIN v b ON b.k = a.k + 1)
SELECT k AS first, round(CASE WHEN m IS NOT NULL THEN d END, 3) + 0.0 AS rotation_deg, round(CASE WHEN m IS NOT NULL THEN sqrt((f[1] - e[1]) ** 2 + (f[2] - e[2]) ** 2 + (f[3] - e[3]) ** 2) END, 5) + 0.0 AS center_jump, round(CASE WHEN m IS NOT NULL THEN d END, 3) + 0.0 AS ray_jump_deg FROM p""")
def pose_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as cameras that turn about the first axis; the last has no next."""
    v = _vectors(spark, sf_dir)
    t, zero, one = F.radians((F.col("k") * 7 % 90).cast("double")), F.lit(0.0), F.lit(1.0)
    cameras = v.select(F.col("k").alias("name"), F.array(one, zero, zero, zero, F.cos(t), -F.sin(t), zero, F.sin(t), F.cos(t)).alias("rotation"), F.slice("e", 1, 3).alias("center"))
    out = poses.pose_metrics(v.select(F.col("k").alias("first"), (F.col("k") + 1).alias("second")), cameras)
    return out.select("first", _tidy(F.col("rotation_deg"), 3).alias("rotation_deg"), _tidy(F.col("center_jump")).alias("center_jump"), _tidy(F.col("ray_jump_deg"), 3).alias("ray_jump_deg"))


@_query(f"""WITH {_VECTORS}, p AS (SELECT k, e[1:9] AS a, CASE WHEN k % 9 = 0 THEN list_transform(e[10:18], lambda x: 0.0::DOUBLE) WHEN k % 5 = 0 THEN list_transform(e[1:9], lambda x: -3 * x) ELSE e[10:18] END AS b FROM v),
s AS (SELECT *, list_sum(list_transform(range(1, 10), lambda i: a[i] * b[i])) AS ab, list_sum(list_transform(b, lambda x: x * x)) AS bb FROM p)
SELECT k, CASE WHEN bb > 0 THEN round(list_max(list_transform(range(1, 10), lambda i: abs(a[i] - ab / bb * b[i]))), 5) + 0.0 ELSE 'inf'::DOUBLE END AS error FROM s""")
def projective_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, k = F.slice("e", 1, 9), F.col("k")
    b = F.when(k % 9 == 0, F.transform(F.slice("e", 10, 9), lambda x: F.lit(0.0))).when(k % 5 == 0, F.transform(a, lambda x: -3 * x)).otherwise(F.slice("e", 10, 9))
    return _vectors(spark, sf_dir).select("k", a.alias("a"), b.alias("b")).select("k", _tidy(poses.projective_error("a", "b")).alias("error"))


@_query(f"""WITH {_VECTORS}, p AS (SELECT k, e[1] / n AS x, e[2] / n AS y, e[3] / n AS z, cos(radians(k % 360)) AS c, sin(radians(k % 360)) AS s FROM (SELECT *, sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3]) AS n FROM v)),
m AS (SELECT k, [-z * s, -z * c, y, z * c, -z * s, -x, x * s - y * c, y * s + x * c, 0.0::DOUBLE] AS m FROM p),
a AS (SELECT k, m, [m[1] / 100, m[2] / 100, m[3] - 0.5 * m[1] - 0.4 * m[2], m[4] / 100, m[5] / 100, m[6] - 0.5 * m[4] - 0.4 * m[5], m[7] / 100, m[8] / 100, m[9] - 0.5 * m[7] - 0.4 * m[8]] AS a FROM m),
f AS (SELECT k, m, [a[1] / 200, a[2] / 200, a[3] / 200, a[4] / 200, a[5] / 200, a[6] / 200, a[7] - 0.3 * a[1] - 0.2 * a[4], a[8] - 0.3 * a[2] - 0.2 * a[5], a[9] - 0.3 * a[3] - 0.2 * a[6]] AS f FROM a)
SELECT k, i - 1 AS at, round(m[i], 5) + 0.0 AS essential, round(f[i] * 1000, 4) + 0.0 AS fundamental FROM f, (SELECT unnest(range(1, 10)) AS i)""")
def pose_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, zero, one = F.radians((F.col("k") % 360).cast("double")), F.lit(0.0), F.lit(1.0)
    lens = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    p = _vectors(spark, sf_dir).select("k", F.array(F.cos(t), -F.sin(t), zero, F.sin(t), F.cos(t), zero, zero, zero, one).alias("rotation"), F.slice("e", 1, 3).alias("translation"), lens(100, 100, 50, 40).alias("k1"), lens(200, 200, 60, 40).alias("k2"))
    out = poses.pose_overrides(p).select("k", F.posexplode(F.arrays_zip("essential", "fundamental")).alias("at", "v"))
    return out.select("k", F.col("at").cast("bigint").alias("at"), _tidy(F.col("v.essential")).alias("essential"), _tidy(F.col("v.fundamental") * 1000, 4).alias("fundamental"))


@_query("""WITH p AS (SELECT l_quantity / 10 - 2.5 AS x, l_discount * 20 - 1 AS y, power(l_tax * 20 + 2, 2) AS z FROM lineitem), m AS (SELECT median(x) AS x, median(y) AS y, median(z) AS z FROM p),
h AS (SELECT CASE WHEN median(p.z - m.z) < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM p, m), c AS (SELECT 9 * cos(n_nationkey) AS x, 9 * sin(n_nationkey) AS y FROM nation WHERE n_nationkey = 0),
f AS (SELECT c.x - m.x AS x, c.y - m.y AS y, sqrt((c.x - m.x) ** 2 + (c.y - m.y) ** 2) AS n FROM c, m),
o AS (SELECT unnest([0, 1, 2]) AS axis, unnest([m.x, m.y, m.z]) AS center, unnest([0.0::DOUBLE, 0.0::DOUBLE, s]) AS vertical, unnest([f.x / n, f.y / n, 0.0::DOUBLE]) AS front, unnest([-s * f.y / n, s * f.x / n, 0.0::DOUBLE]) AS right_ FROM m, h, f)
SELECT axis, round(center, 5) + 0.0 AS center, round(vertical, 5) + 0.0 AS vertical, round(front, 5) + 0.0 AS front, round(right_, 5) + 0.0 AS right_ FROM o""")
def vertical_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as points and nations as cameras on a level circle."""
    points = _points(spark, sf_dir).select("x", "y", (F.col("z") * F.col("z")).alias("z"))
    k = F.col("n_nationkey")
    cameras = _t(spark, sf_dir, "nation").select(k.alias("name"), (9 * F.cos(k)).alias("x"), (9 * F.sin(k)).alias("y"), F.lit(1.0).alias("z"))
    out = poses.vertical_basis(points, cameras).select(F.posexplode(F.arrays_zip("center", "vertical", "front", "right")).alias("axis", "v"))
    return out.select("axis", *[_tidy(F.col(f"v.{c}")).alias(c + "_" * (c == "right")) for c in ("center", "vertical", "front", "right")])


@_query("SELECT p_name AS filename, p_partkey AS selected_index, p_size AS size_bytes FROM (SELECT p_name || p_partkey AS p_name, p_partkey, p_size FROM part) WHERE p_partkey IN (SELECT s_suppkey FROM supplier)")
def registered_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a manifest, of which as many are registered as there are suppliers."""
    name = F.concat("p_name", "p_partkey")
    records = _t(spark, sf_dir, "part").select(name.alias("filename"), F.col("p_partkey").alias("selected_index"), F.col("p_size").alias("size_bytes"))
    supplier = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("selected_index"))
    names = records.join(supplier, "selected_index").select("filename")
    return poses.registered_manifest(records, names, supplier.count())
