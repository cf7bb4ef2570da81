"""Queries of masks and of clouds projected against them, each beside its DuckDB SQL, which goes pixel by pixel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks, pictures
from .queries import _points, _rounded, _t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs of their nation's mask; some lie partly outside the frame."""
    k, x0 = F.col("c_custkey"), F.col("c_custkey") * 7 % 130
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("image"), (k * 11 % 100).alias("y"), x0.alias("x0"), (x0 + 4 + F.floor(F.abs("c_acctbal")) % 40).alias("x1"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("image"), F.lit(128).cast("bigint").alias("width"), F.lit(96).cast("bigint").alias("height"))


def _views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Points, cameras (nations, rings are regions), masks and their sizes; one mask is missing, one is of another size."""
    n = F.col("n_nationkey")
    side = lambda *v: F.array(*[F.lit(float(x)) if isinstance(x, int) else x for x in v])
    pose = side(1, 0, 0, (n % 5 - 2) / 2, 0, 1, 0, 0, 0, 0, 1, (n % 4).cast("double"))
    cameras = _t(spark, sf_dir, "nation").select(n.alias("image"), F.col("n_regionkey").alias("ring"), pose.alias("m"), side(100, 100, 64, 48).alias("k"), F.lit(128).cast("bigint").alias("width"), F.lit(96).cast("bigint").alias("height"))
    sizes = cameras.where("image <> 3").select("image", F.when(F.col("image") == 5, 64).otherwise(F.col("width")).alias("width"), "height")
    return _points(spark, sf_dir), cameras, _runs(spark, sf_dir), sizes


_PIXELS = """r AS (SELECT c_nationkey AS image, c_custkey * 11 % 100 AS y, c_custkey * 7 % 130 AS x0, CAST(4 + floor(abs(c_acctbal)) % 40 AS BIGINT) AS n FROM customer),
m AS (SELECT DISTINCT image, y, x FROM (SELECT image, y, unnest(range(x0, x0 + n)) AS x FROM r) WHERE x < 128 AND y < 96)"""
_PROJECTION = f"""{_PIXELS},
c AS (SELECT n_nationkey AS image, n_regionkey AS ring, (n_nationkey % 5 - 2) / 2 AS cx, n_nationkey % 4 AS cz, CASE n_nationkey WHEN 3 THEN 'missing_mask' WHEN 5 THEN 'shape_mismatch' ELSE 'measured' END AS status FROM nation),
u AS (SELECT image, 100 * (x + cx) / (z + cz) + 64 AS u, 100 * y / (z + cz) + 48 AS v FROM (SELECT l_quantity / 10 - 2.5 AS x, l_discount * 20 - 1 AS y, l_tax * 20 + 2 AS z FROM lineitem), c WHERE z + cz > 0 AND status = 'measured'),
p AS (SELECT image, CAST(round_even(u, 0) AS BIGINT) AS x, CAST(round_even(v, 0) AS BIGINT) AS y, count(*) AS n FROM u WHERE u >= 0 AND u < 128 AND v >= 0 AND v < 96 GROUP BY 1, 2, 3 HAVING x < 128 AND y < 96),
f AS (SELECT DISTINCT image, x + dx AS x, y + dy AS y FROM p, (SELECT unnest(range(-5, 6)) AS dx), (SELECT unnest(range(-5, 6)) AS dy) WHERE x + dx BETWEEN 0 AND 127 AND y + dy BETWEEN 0 AND 95),
a AS (SELECT image, sum(n) AS projected, sum(n) FILTER (m.x IS NOT NULL) AS inside FROM p LEFT JOIN m USING (image, x, y) GROUP BY 1),
b AS (SELECT image, count(*) AS both_, count(m.x) AS shared FROM f LEFT JOIN m USING (image, x, y) GROUP BY 1), d AS (SELECT image, count(*) AS area FROM m GROUP BY 1),
v AS (SELECT image, ring, status, CASE WHEN status = 'measured' THEN CAST(coalesce(projected, 0) AS BIGINT) END AS projected, CASE WHEN status = 'measured' THEN CAST(coalesce(inside, 0) AS BIGINT) END AS inside, CASE WHEN status = 'measured' THEN coalesce(area, 0) END AS mask_area,
  CASE WHEN status = 'measured' THEN coalesce(inside, 0) / greatest(coalesce(projected, 0), 1) END AS precision, CASE WHEN status = 'measured' THEN coalesce(shared, 0) / greatest(coalesce(area, 0), 1) END AS recall,
  CASE WHEN status = 'measured' THEN coalesce(shared, 0) / greatest(coalesce(both_, 0) + coalesce(area, 0) - coalesce(shared, 0), 1) END AS iou FROM c LEFT JOIN a USING (image) LEFT JOIN b USING (image) LEFT JOIN d USING (image))"""


@_query(f"WITH {_PROJECTION} SELECT image, ring, status, projected, inside, mask_area, round(precision, 6) AS precision, round(recall, 6) AS recall, round(iou, 6) AS iou FROM v")
def mask_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(masks.mask_projection(*_views(spark, sf_dir)), "precision", "recall", "iou")


_STATS = [(c, s) for c in ("precision", "recall", "iou") for s in ("mean", "p10", "p50", "least")]
_SQL_STATS = {"mean": "avg({})", "p10": "quantile_cont({}, 0.1)", "p50": "quantile_cont({}, 0.5)", "least": "min({})"}


@_query(f"WITH {_PROJECTION} SELECT ring, count(*) AS views, " + ", ".join(f"round({_SQL_STATS[s].format(c)}, 6) AS {c}_{s}" for c, s in _STATS) + " FROM v WHERE status = 'measured' GROUP BY ring")
def ring_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(masks.ring_projection(masks.mask_projection(*_views(spark, sf_dir))), *[f"{c}_{s}" for c, s in _STATS])


@_query(f"""WITH {_PROJECTION}, g AS (SELECT ring, avg(precision) AS p, avg(recall) AS r, avg(iou) AS i FROM v WHERE status = 'measured' GROUP BY ring),
o AS (SELECT count(*) AS registered, count(*) FILTER (status = 'measured') AS measured, quantile_cont(precision, 0.1) AS p, quantile_cont(recall, 0.1) AS r, quantile_cont(iou, 0.1) AS i FROM v)
SELECT registered, measured, false AS passed, array_to_string(list_filter([CASE WHEN measured < registered THEN 'all_registered_views_measured' END, CASE WHEN p < 0.9 THEN 'view_precision_p10' END, CASE WHEN r < 0.6 THEN 'view_recall_p10' END, CASE WHEN i < 0.6 THEN 'view_iou_p10' END,
  CASE WHEN (SELECT count(*) FROM g) < (SELECT count(*) FROM region) THEN 'all_selected_rings_measured' END, CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.p < 0.9) THEN 'ring_precision_mean' END, CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.r < 0.6) THEN 'ring_recall_mean' END, CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.i < 0.6) THEN 'ring_iou_mean' END], lambda x: x IS NOT NULL), ',') AS reasons FROM o""")
def projection_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ring"))
    return masks.projection_gate(masks.mask_projection(*_views(spark, sf_dir)), rings).select("registered", "measured", "passed", F.array_join("reasons", ",").alias("reasons"))


_ERODED = """i AS (SELECT m.image, m.y, m.x FROM m JOIN m q ON q.image = m.image AND q.x BETWEEN m.x - 2 AND m.x + 2 AND q.y BETWEEN m.y - 2 AND m.y + 2
  GROUP BY ALL HAVING count(*) = (least(m.x + 2, 127) - greatest(m.x - 2, 0) + 1) * (least(m.y + 2, 95) - greatest(m.y - 2, 0) + 1)),
e AS (SELECT * FROM m EXCEPT SELECT * FROM i)"""
_PARTS = """n AS (SELECT image, y, x, y * 128 + x AS id FROM m),
w AS (SELECT s.image, s.id AS u, t.id AS v FROM n s JOIN n t ON s.image = t.image AND abs(s.x - t.x) <= 1 AND abs(s.y - t.y) <= 1 AND s.id <> t.id),
l(image, id, root) USING KEY (image, id) AS (SELECT image, id, id AS root FROM n UNION SELECT w.image, w.v, min(l.root) FROM l JOIN w ON w.image = l.image AND w.u = l.id JOIN recurring.l AS o ON o.image = w.image AND o.id = w.v WHERE l.root < o.root GROUP BY w.image, w.v),
t AS (SELECT image, root, count(*) AS area FROM l GROUP BY image, root)"""


@_query(f"""WITH RECURSIVE {_PIXELS}, {_ERODED}, {_PARTS},
thin AS (SELECT n.image, n.y, n.x FROM n JOIN l USING (image, id) JOIN t USING (image, root) WHERE area < 256 AND EXISTS (SELECT 1 FROM e JOIN n k USING (image, y, x) JOIN l z ON z.image = k.image AND z.id = k.id WHERE z.image = t.image AND z.root = t.root)),
b AS (SELECT DISTINCT m.image, m.y, m.x FROM m JOIN e ON e.image = m.image AND e.x BETWEEN m.x - 3 AND m.x + 3 AND e.y BETWEEN m.y - 3 AND m.y + 3),
a AS (SELECT 'full' AS product, * FROM m UNION ALL SELECT 'mvs', * FROM m UNION ALL SELECT 'boundary', * FROM b UNION ALL SELECT 'feature', * FROM (SELECT * FROM i UNION SELECT * FROM thin))
SELECT image, product, y, count(*) AS pixels, CAST(sum(x * x) AS BIGINT) AS moment FROM a GROUP BY 1, 2, 3""")
def mask_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each row of each product, and the sum of the squares of their places."""
    runs = masks.mask_products(_runs(spark, sf_dir), _frames(spark, sf_dir))
    squares = lambda n: (n - 1) * n * (2 * n - 1) / 6
    return runs.groupBy("image", "product", "y").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"), F.sum(squares(F.col("x1")) - squares(F.col("x0"))).cast("bigint").alias("moment"))


@_query(f"""WITH RECURSIVE {_PIXELS}, {_PARTS}, k AS (SELECT image, arg_min(root, (-area, root)) AS root, sum(area) - max(area) AS removed FROM t GROUP BY image)
SELECT k.image, CAST(removed AS BIGINT) AS removed, count(*) AS kept, CAST(sum(n.x * n.y) AS BIGINT) AS moment FROM k JOIN l USING (image, root) JOIN n USING (image, id) GROUP BY 1, 2""")
def largest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each mask: pixels outside its largest part, pixels kept, and the sum of their x times y."""
    runs = masks._framed(_runs(spark, sf_dir), _frames(spark, sf_dir)).select("image", "y", "x0", "x1")
    kept, removed = masks.largest_part(runs)
    n = F.col("x1") - F.col("x0")
    sums = kept.groupBy("image").agg(F.sum(n).alias("kept"), F.sum(F.col("y") * n * (F.col("x0") + F.col("x1") - 1) / 2).cast("bigint").alias("moment"))
    return removed.join(sums, "image").select("image", "removed", "kept", "moment")


@_query(f"""WITH RECURSIVE {_PIXELS}, {_PARTS}, s AS (SELECT image, y, count(*) AS n FROM m GROUP BY 1, 2),
b AS (SELECT image, max(n) AS support FROM s WHERE y >= floor(96 * 0.72) GROUP BY 1), q AS (SELECT image, count(*) AS parts, list(area ORDER BY area DESC) AS areas FROM t GROUP BY 1),
z AS (SELECT image, count(*) AS pixels, min(x) AS x, min(y) AS top, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, avg(x) AS cx, avg(y) AS cy FROM m GROUP BY 1)
SELECT n_nationkey AS image, coalesce(pixels, 0) AS pixels, round(coalesce(pixels, 0) / (128 * 96), 6) AS fraction, coalesce(z.x, 0) AS x, coalesce(top, 0) AS top, coalesce(z.w, 0) AS w, coalesce(h, 0) AS h, round(cx, 6) AS cx, round(cy, 6) AS cy, coalesce(parts, 0) AS parts,
  round(coalesce(areas[1] / pixels, 0), 6) AS largest_fraction, round(coalesce(areas[2] / areas[1], 0), 6) AS second_fraction, coalesce(support, 0) AS base_support, coalesce(support, 0) > 128 * 0.45 AS base_warning
FROM nation LEFT JOIN z ON z.image = n_nationkey LEFT JOIN q ON q.image = n_nationkey LEFT JOIN b ON b.image = n_nationkey""")
def mask_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(masks.mask_diagnostics(_runs(spark, sf_dir), _frames(spark, sf_dir)), "fraction", "cx", "cy", "largest_fraction", "second_fraction")


@_query("""WITH l AS (SELECT vec_id, list_transform(embedding, lambda e: floor((CAST(e AS DOUBLE) + 1) * 127)) AS l FROM embeddings),
p AS (SELECT vec_id, l, i // 8 AS y, i % 8 AS x, l[i + 1] AS v FROM l, (SELECT unnest(range(0, 64)) AS i)),
b AS (SELECT vec_id, y, x, v, l[CASE y WHEN 0 THEN 1 ELSE y - 1 END * 8 + x + 1] + l[CASE y WHEN 7 THEN 6 ELSE y + 1 END * 8 + x + 1] + l[y * 8 + CASE x WHEN 0 THEN 1 ELSE x - 1 END + 1] + l[y * 8 + CASE x WHEN 7 THEN 6 ELSE x + 1 END + 1] - 4 * v AS d FROM p),
r AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS s FROM p, (SELECT unnest([0, 1, 2, 3]) AS e) WHERE (e = 0 AND y = 0) OR (e = 1 AND y = 7) OR (e = 2 AND x = 0) OR (e = 3 AND x = 7) GROUP BY 1),
m AS (SELECT vec_id, avg(v) AS m FROM p WHERE x IN (3, 4) AND y IN (3, 4) GROUP BY 1)
SELECT vec_id, round(var_pop(d) + 1e-7, 4) AS sharpness, round(avg(v) + 1e-7, 4) AS mean, round(quantile_cont(v, 0.01) + 1e-7, 4) AS p01, round(quantile_cont(v, 0.99) + 1e-7, 4) AS p99, round(avg((v <= 1 OR v >= 254)::INT) + 1e-7, 4) AS clipping, round(stddev_pop(v) + 1e-7, 4) AS contrast, round(abs(any_value(m.m) - any_value(r.m)) / (any_value(r.s) + 1) + 1e-7, 4) AS presence
FROM b JOIN r USING (vec_id) JOIN m USING (vec_id) GROUP BY vec_id""")
def picture_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as pictures of 8 by 8."""
    byte = lambda e: F.lpad(F.hex(F.floor((e.cast("double") + 1) * 127)), 2, "0")
    made = _t(spark, sf_dir, "embeddings").select("vec_id", F.unhex(F.array_join(F.transform("embedding", byte), "")).alias("values"))
    # Variances of small whole numbers are often ties of rounding, which the small number settles.
    return pictures.picture_quality(made, side=8, border=1, margin=3).select("vec_id", *[F.round(F.col(m) + 1e-7, 4).alias(m) for m in pictures.MEASURES])
