"""Queries of tracks from match rows, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import tracks
from .queries import _points, _rounded, _t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's lines, each matched with the next: suppliers are images, part and line number a keypoint; some contradict."""
    line = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_suppkey") + 1).alias("a"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("ka"), "l_orderkey")
    w = Window.partitionBy("part").orderBy("l_orderkey", "ka", "a")
    line = line.withColumns({"b": F.lead("a").over(w), "kb": F.lead("ka").over(w)}).where("a <> b")
    first = F.col("a") < F.col("b")
    side = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return line.select("part", E.pair_id("a", "b").alias("pair_id"), side("a", "b").alias("i1"), side("ka", "kb").alias("k1"), side("b", "a").alias("i2"), side("kb", "ka").alias("k2"))


_ROWS = """q AS (SELECT l_partkey AS part, l_suppkey + 1 AS a, l_partkey * 8 + l_linenumber AS ka, lead(l_suppkey + 1) OVER w AS b, lead(l_partkey * 8 + l_linenumber) OVER w AS kb FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_orderkey, l_partkey * 8 + l_linenumber, l_suppkey)),
rw AS (SELECT part, least(a, b) * 2147483647 + greatest(a, b) AS pair_id, CASE WHEN a < b THEN a ELSE b END AS i1, CASE WHEN a < b THEN ka ELSE kb END AS k1, CASE WHEN a < b THEN b ELSE a END AS i2, CASE WHEN a < b THEN kb ELSE ka END AS k2 FROM q WHERE a <> b),
st AS (SELECT pair_id, count(*) AS n FROM rw GROUP BY 1)"""


def _sql_tracks(order: str, most: int) -> str:
    """Rows of a part in order, each joining two of a list of tracks unless an image would be there twice; no row leads out of its part."""
    return f"""{_ROWS}, ls AS (SELECT part, list({{'u': i1 * 4294967296 + k1, 'v': i2 * 4294967296 + k2}} ORDER BY {order}) AS l FROM rw JOIN st USING (pair_id) GROUP BY part),
tk AS (SELECT part, list_reduce(l, lambda acc, x: list_transform([{{'m': coalesce(list_filter(acc.t, lambda t: list_contains(t, x.u))[1], [x.u]), 'n': coalesce(list_filter(acc.t, lambda t: list_contains(t, x.v))[1], [x.v]), 't': list_filter(acc.t, lambda t: NOT list_contains(t, x.u) AND NOT list_contains(t, x.v))}}],
    lambda p: CASE WHEN list_contains(p.m, x.v) THEN {{'t': list_append(p.t, p.m), 'r': acc.r}} WHEN list_has_any(list_transform(p.m, lambda o: o >> 32), list_transform(p.n, lambda o: o >> 32)) THEN {{'t': p.t || [p.m, p.n], 'r': acc.r + 1}} ELSE {{'t': list_append(p.t, p.m || p.n), 'r': acc.r}} END)[1], {{'t': CAST([] AS BIGINT[][]), 'r': 0}}) AS s FROM ls),
un AS (SELECT unnest(s.t) AS t FROM tk), rs AS (SELECT sum(s.r) AS refused FROM tk)"""


def _digest(made: DataFrame) -> DataFrame:
    o = E.observation_id("image", "keypoint")
    return made.groupBy("track").agg(F.count("*").alias("n"), F.sum(o % 1000003).alias("digest"))


_TRACK_ROWS = "SELECT list_min(t) AS track, len(t) AS n, CAST(list_sum(list_transform(t, lambda o: o % 1000003)) AS BIGINT) AS digest FROM un WHERE len(t) BETWEEN 2 AND {}"


@_query(f"WITH {_sql_tracks('pair_id, k1, k2', 372)} {_TRACK_ROWS.format(372)}")
def track_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(tracks.track_components(_rows(spark, sf_dir))[0])


@_query(f"WITH {_sql_tracks('n DESC, pair_id, k1, k2', 12)} {_TRACK_ROWS.format(12)}")
def strongest_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(tracks.track_components(_rows(spark, sf_dir), order="strongest", most=12)[0])


@_query(f"""WITH {_sql_tracks("pair_id % 10 > 0, n DESC, pair_id, k1, k2", 12)}, z AS (SELECT count(*) AS components, count(*) FILTER (len(t) BETWEEN 2 AND 12) AS tracks, count(*) FILTER (len(t) < 2) AS short, count(*) FILTER (len(t) > 12) AS large, CAST(sum(len(t) - 1) AS BIGINT) AS merges FROM un)
SELECT (SELECT count(*) FROM rw) AS match_rows, merges, CAST(refused AS BIGINT) AS refused, components, tracks, short, large FROM z, rs""")
def track_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How tracks came about with the pairs of every tenth id first."""
    rows = _rows(spark, sf_dir)
    return tracks.track_components(rows, order="priority", priority=rows.where("pair_id % 10 = 0").select("pair_id"), most=12)[1]


_CANDIDATES = """ca AS (SELECT o_custkey AS c, l_orderkey AS p, o_custkey * 2 + 1 AS i1, l_partkey % 6 AS k1, o_custkey * 2 + 2 AS i2, l_suppkey % 7 AS k2, l_discount AS e FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
cn AS (SELECT p, count(*) AS n FROM ca GROUP BY 1 HAVING n >= 2), cp AS (SELECT c, p, n, list({'u': k1, 'v': k2} ORDER BY e, k1, k2) AS l FROM ca JOIN cn USING (p) GROUP BY ALL), cc AS (SELECT c, list({'p': p, 'l': l} ORDER BY n, p) AS l FROM cp GROUP BY 1),
cr AS (SELECT c, list_reduce(l, lambda acc, x: list_transform([list_reduce(x.l, lambda a, y: CASE WHEN len(a.o) >= 3 OR list_contains(a.u, y.u) OR list_contains(a.v, y.v) THEN a ELSE {'u': a.u, 'v': a.v, 'o': list_append(a.o, {'p': x.p, 'k1': y.u, 'k2': y.v})} END, {'u': acc.u, 'v': acc.v, 'o': CAST([] AS STRUCT(p BIGINT, k1 BIGINT, k2 BIGINT)[])})],
    lambda r: CASE WHEN len(r.o) < 2 THEN acc ELSE {'u': acc.u || list_transform(r.o, lambda z: z.k1), 'v': acc.v || list_transform(r.o, lambda z: z.k2), 'o': acc.o || r.o} END)[1], {'u': CAST([] AS BIGINT[]), 'v': CAST([] AS BIGINT[]), 'o': CAST([] AS STRUCT(p BIGINT, k1 BIGINT, k2 BIGINT)[])}) AS r FROM cc)"""


@_query(f"WITH {_CANDIDATES} SELECT o.p AS pair_id, o.k1 AS k1, o.k2 AS k2 FROM (SELECT unnest(r.o) AS o FROM cr)")
def pair_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer as two images that its orders are pairs of, with lines as candidates; two to three of an order are taken."""
    line = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    c = line.select(F.col("l_orderkey").alias("pair_id"), (F.col("o_custkey") * 2 + 1).alias("i1"), (F.col("l_partkey") % 6).alias("k1"), (F.col("o_custkey") * 2 + 2).alias("i2"), (F.col("l_suppkey") % 7).alias("k2"), F.col("l_discount").alias("error"))
    return tracks.pair_tracks(c, least=2, most=3)


@_query("""WITH p AS (SELECT l_orderkey * 8 + l_linenumber AS pid, l_quantity / 10 - 2.5 AS x, l_discount * 20 - 1 AS y, l_tax * 20 + 2 AS z FROM lineitem)
SELECT pid, count(*) AS n, round(sum(x), 4) + 0.0 AS x, round(sum(y), 4) + 0.0 AS y, round(sum(z), 4) + 0.0 AS z, 0.0::DOUBLE AS error FROM p GROUP BY 1""")
def triangulated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points seen by two cameras, found again from what these see."""
    pose = lambda t: F.array(*[F.lit(float(v)) for v in (1, 0, 0, t, 0, 1, 0, 0, 0, 0, 1, 0)])
    see = {f"{a}{i}": (100 + 20 * i) * (F.col("x" if a == "u" else "y") + (t if a == "u" else 0.0)) / F.col("z") + 50 for i, t in ((1, 0.0), (2, -1.0)) for a in "uv"}
    m = _points(spark, sf_dir).select("pid", *[c.alias(k) for k, c in see.items()], pose(0).alias("m1"), pose(-1).alias("m2"), *[F.array(*[F.lit(float(v)) for v in (100 + 20 * i, 100 + 20 * i, 50, 50)]).alias(f"l{i}") for i in (1, 2)])
    out = tracks.triangulate(m, most_error=4.0)
    return out.groupBy("pid").agg(F.count("*").alias("n"), *[(F.round(F.sum(a), 4) + 0.0).alias(a) for a in "xyz"], F.abs(F.round(F.max("error"), 4)).alias("error"))


_SEEN = """ob AS (SELECT l_partkey % 40 AS track, l_suppkey AS image, l_linenumber AS keypoint, CASE WHEN l_orderkey % 13 > 0 THEN l_discount END AS error FROM lineitem),
bo AS (SELECT track, image, arg_min(keypoint, (coalesce(error, 'inf'::DOUBLE), keypoint)) AS keypoint, min(coalesce(error, 'inf'::DOUBLE)) AS error FROM ob GROUP BY 1, 2 QUALIFY count(*) OVER (PARTITION BY track) >= 3)"""


@_query(f"WITH {_SEEN} SELECT track, image, keypoint, round(error, 6) AS error FROM bo")
def best_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_observations(spark, sf_dir), "error")


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("track"), F.col("l_suppkey").alias("image"), F.col("l_linenumber").alias("keypoint"), F.when(F.col("l_orderkey") % 13 > 0, F.col("l_discount")).alias("error"))
    return tracks.best_observations(o)


@_query(f"""WITH RECURSIVE {_SEEN}, mr AS (SELECT DISTINCT a.l_suppkey AS i1, a.l_linenumber AS k1, b.l_suppkey AS i2, b.l_linenumber AS k2 FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND a.l_suppkey < b.l_suppkey WHERE a.l_orderkey % 3 = 0),
wi AS (SELECT x.track, x.image AS a, y.image AS b FROM mr JOIN bo x ON x.image = i1 AND x.keypoint = k1 JOIN bo y ON y.track = x.track AND y.image = i2 AND y.keypoint = k2),
ed AS (SELECT * FROM wi UNION ALL SELECT track, b, a FROM wi),
cp(track, id, root) USING KEY (track, id) AS (SELECT track, image AS id, image AS root FROM bo UNION SELECT e.track, e.b, min(r.root) FROM cp AS r JOIN ed e ON e.track = r.track AND e.a = r.id JOIN recurring.cp AS o ON o.track = e.track AND o.id = e.b WHERE r.root < o.root GROUP BY e.track, e.b),
sp AS (SELECT track, count(*) AS support FROM wi GROUP BY 1)
SELECT track, count(*) AS images, coalesce(any_value(support), 0) AS support, count(DISTINCT root) = 1 AS connected FROM cp LEFT JOIN sp USING (track) GROUP BY track""")
def track_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one order as matches of their suppliers' line numbers."""
    line = _t(spark, sf_dir, "lineitem").where("l_orderkey % 3 = 0")
    a, b = (line.select("l_orderkey", F.col("l_suppkey").alias(f"i{k}"), F.col("l_linenumber").alias(f"k{k}")) for k in (1, 2))
    return tracks.track_support(_observations(spark, sf_dir), a.join(b, "l_orderkey").where("i1 < i2").select("i1", "k1", "i2", "k2"))
