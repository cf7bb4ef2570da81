"""DuckDB SQL for the registered evidence queries."""

from ..operators.cloud import REGIONS

ORACLE: dict[str, str] = {}

_FRAMES = """f AS (
  SELECT user_id AS ring, event_id AS name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n
  FROM events),
p AS (SELECT *, pos / n AS phase FROM f)"""

ORACLE["phase_frames"] = f"WITH {_FRAMES} SELECT ring, name, pos, n, round(phase, 9) AS phase FROM p"

ORACLE["pair_schedule"] = f"""WITH {_FRAMES},
near AS (SELECT a.name AS x, b.name AS y FROM p a JOIN p b ON a.ring = b.ring, range(1, 4) s(k) WHERE k <= a.n - 1 AND b.pos = (a.pos + k) % a.n),
step AS (SELECT ring, lead(ring) OVER (ORDER BY ring) AS next FROM (SELECT DISTINCT ring FROM p)),
win AS (
  SELECT a.name, b.ring, b.pos, b.n,
         row_number() OVER (PARTITION BY a.name ORDER BY least(abs(a.phase - b.phase), 1 - abs(a.phase - b.phase)), b.name) AS r
  FROM p a JOIN step s ON a.ring = s.ring AND s.next = s.ring + 1 JOIN p b ON b.ring = s.next),
crossing AS (SELECT w.name AS x, b.name AS y FROM win w, range(-1, 2) s(k), p b WHERE w.r = 1 AND b.ring = w.ring AND b.pos = (w.pos + k + w.n) % w.n)
SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT * FROM near UNION ALL SELECT * FROM crossing) WHERE x <> y"""

ORACLE["offset_vote"] = f"""WITH {_FRAMES}, v AS (SELECT p.*, e.value FROM p JOIN events e ON p.name = e.event_id),
anchors AS (SELECT DISTINCT v.* FROM v, range(0, 8) s(k) WHERE v.n <= 8 OR v.pos = round_even(k * (v.n - 1) / 7.0, 0)),
tries AS (SELECT a.ring AS l, a.ring + 1 AS r, a.name, a.value, k / 20.0::DOUBLE AS o, CASE WHEN abs(t - 1) <= 1e-12 THEN 0.0 ELSE t END AS t
          FROM (SELECT *, fmod(phase + k / 20.0::DOUBLE, 1.0::DOUBLE) AS t FROM anchors, range(0, 20) s(k)) a),
near AS (SELECT t.l, t.r, t.o, t.name, t.value, b.value AS bv, row_number() OVER (PARTITION BY t.l, t.name, t.o ORDER BY least(abs(t.t - b.phase), 1 - abs(t.t - b.phase)), b.name) AS k
         FROM tries t JOIN v b ON b.ring = t.r),
votes AS (SELECT l, r, o, quantile_cont(round(100 - abs(value - bv), 4), 0.5) AS s FROM near WHERE k = 1 GROUP BY l, r, o),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY s DESC, o) AS k FROM votes),
b AS (SELECT l, r, max(o) FILTER (k = 1) AS o, max(s) FILTER (k = 1) AS best, max(s) FILTER (k = 2) AS second FROM ranked GROUP BY l, r)
SELECT l AS "left", r AS "right", round(o, 6) AS "offset", round(best, 6) AS best, round(best - second, 6) AS margin,
       round(CASE WHEN best = 0 AND second = 0 THEN 1.0 ELSE greatest(0.0, best - second) / greatest(abs(best), 1e-9) END, 6) AS confidence, best - second <= 0.5 AS ambiguous FROM b"""

ORACLE["cycle_split"] = """WITH e AS (SELECT label % 2 AS ring, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS sig, row_number() OVER (PARTITION BY label % 2 ORDER BY vec_id) - 1 AS pos FROM embeddings),
f AS (SELECT *, count(*) OVER (PARTITION BY ring) AS n FROM e),
b AS (SELECT DISTINCT ring, n, greatest(30, round_even(n * 0.30, 0)) AS least, least(12, greatest(5, n // 16)) AS w FROM f WHERE n >= 100),
s AS (SELECT ring, n, w, split FROM (SELECT *, unnest(range(CAST(greatest(least, round_even(n * 0.35, 0)) AS BIGINT), CAST(least(n - least, round_even(n * 0.75, 0)) AS BIGINT) + 1)) AS split FROM b) WHERE split + w < n),
d AS (
  SELECT s.ring, s.n, s.split, part, list_sum(list_transform(list_zip(x.sig, y.sig), lambda z: abs(z[1] - z[2]))) / len(x.sig) AS d
  FROM s, range(0, 12) r(i), (VALUES ('head'), ('tail')) q(part), f x, f y
  WHERE i < w AND x.ring = s.ring AND y.ring = s.ring
    AND x.pos = CASE part WHEN 'head' THEN i ELSE s.n - w + i END AND y.pos = CASE part WHEN 'head' THEN split + i ELSE split - w + i END)
SELECT ring, n, split, round((avg(d) FILTER (part = 'head') + avg(d) FILTER (part = 'tail')) / 2, 6) AS score FROM d GROUP BY ring, n, split"""

ORACLE["role_totals"] = """SELECT coalesce(role, 'unassigned') AS role, count(*) AS n FROM events LEFT JOIN (VALUES
  ('first', TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-10 11:59:59'), ('second', TIMESTAMP '2024-01-10 12:00:00', TIMESTAMP '2024-01-20 23:59:59'),
  ('third', TIMESTAMP '2024-01-22 00:00:00', TIMESTAMP '2024-01-28 00:00:00')) r(role, a, b) ON ts BETWEEN a AND b GROUP BY 1"""

ORACLE["exact_duplicates"] = """WITH d AS (SELECT doc_id AS "key", sha256(text) AS digest FROM documents), g AS (SELECT digest, count(*) AS copies, min("key") AS first_key FROM d GROUP BY digest HAVING count(*) > 1)
SELECT "key", digest, copies, first_key FROM d JOIN g USING (digest)"""

ORACLE["near_duplicate_anchor"] = """WITH w AS (SELECT label AS grp, vec_id AS "key", list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
a AS (SELECT grp, min("key") AS anchor FROM w GROUP BY grp),
x AS (SELECT w.grp, a.anchor, w."key", CAST(list_sum(list_transform(list_zip(w.b, o.b), lambda z: CASE WHEN z[1] = z[2] THEN 0 ELSE 1 END)) AS INTEGER) AS bits
      FROM w JOIN a USING (grp) JOIN w o ON o.grp = w.grp AND o."key" = a.anchor WHERE w."key" <> a.anchor)
SELECT grp, anchor, "key", bits FROM x WHERE bits <= 24"""

ORACLE["signature_distance"] = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
z AS (SELECT vec_id, label, list_transform(v, lambda x: (x - list_avg(v)) / CASE WHEN list_stddev_pop(v) < 1e-6 THEN 1.0 ELSE list_stddev_pop(v) END) AS z FROM e),
n AS (SELECT *, lead(z) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM z)
SELECT vec_id, round(list_sum(list_transform(list_zip(z, y), lambda q: abs(q[1] - q[2]))) / len(z), 6) AS distance FROM n WHERE y IS NOT NULL"""

_MATCHES = "m AS (SELECT l_partkey AS part, l_suppkey AS supp, count(*) AS rows, CAST(sum(l_quantity) AS BIGINT) AS inliers FROM lineitem GROUP BY ALL)"

ORACLE["pair_evidence"] = f"""WITH {_MATCHES}
SELECT 'p' || m.part AS first, 's' || m.supp AS second, inliers, CAST(m.part % 25 AS INTEGER) AS first_ring, p_size AS first_frame, s_nationkey AS second_ring, CAST(s_suppkey % 50 AS INTEGER) AS second_frame,
       m.part % 25 = s_nationkey AS same_ring, CASE WHEN m.part % 25 = s_nationkey THEN CAST(abs(p_size - s_suppkey % 50) AS INTEGER) END AS frame_distance
FROM m JOIN part ON p_partkey = m.part JOIN supplier ON s_suppkey = m.supp
WHERE (m.part % 25 = s_nationkey AND abs(p_size - s_suppkey % 50) <= 4) OR (m.part % 25 <> s_nationkey AND inliers >= 50)"""

ORACLE["trajectory_outliers"] = """WITH j AS (SELECT event_id, user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS jump FROM events),
k AS (SELECT *, quantile_cont(jump, 0.5) OVER (PARTITION BY user_id) AS med FROM j WHERE jump IS NOT NULL),
q AS (SELECT *, quantile_cont(abs(jump - med), 0.5) OVER (PARTITION BY user_id) AS mad FROM k)
SELECT event_id, user_id, round(jump, 6) AS jump, round(med, 6) AS med, round(mad, 6) AS mad, round(med + 1.5 * greatest(mad, 1e-9), 6) AS threshold, jump > med + 1.5 * greatest(mad, 1e-9) AS is_outlier FROM q"""

ORACLE["pair_classes"] = f"""WITH {_MATCHES},
r AS (SELECT part, supp, list_filter([
  CASE WHEN rows = 1 THEN 'calibrated_config_not_2' END, CASE WHEN supp % 7 = 0 THEN 'calibrated_rotation_not_so3' END,
  CASE WHEN part % 11 = 0 THEN 'calibrated_translation_missing_or_degenerate' END, CASE WHEN inliers < 30 THEN 'calibrated_inliers_below_floor' END,
  CASE WHEN supp % 5 = 0 OR inliers / 500.0::DOUBLE <= 0.05 THEN 'triangulation_angle_weak' END, CASE WHEN (inliers % 10) / 10.0::DOUBLE < 0.5 THEN 'calibrated_cheirality_weak' END,
  CASE WHEN part % 3 <> 0 AND (part % 10) / 10.0::DOUBLE > 0.8 THEN 'homography_dominant' END, CASE WHEN supp % 9 = 0 THEN 'essential_rank_defective' END], lambda x: x IS NOT NULL) AS r FROM m)
SELECT part, supp, array_to_string(r, ',') AS reasons, len(r) = 0 AS well_conditioned FROM r"""

_STEPS = """s AS (SELECT s_suppkey AS k, s_acctbal AS v, s_nationkey AS ring FROM supplier),
near AS (SELECT a.k AS a, a.v AS va, b.k AS b, b.v AS vb FROM s a JOIN s b ON b.k BETWEEN a.k + 1 AND a.k + 3)"""

ORACLE["triangle_cycles"] = f"""WITH {_STEPS},
e AS (SELECT a * 1000000 + b AS pair_id, a, b, (vb - va) % 60 + CASE WHEN (a + b) % 13 = 0 THEN 25.0 ELSE 0.0 END AS t FROM near),
d AS (SELECT pair_id, a, b, t FROM e UNION ALL SELECT pair_id, b, a, -t FROM e),
c AS (SELECT e.pair_id, degrees(acos(least(1, greatest(-1, cos(radians(x.t + y.t - e.t)))))) AS err
      FROM e JOIN d x ON x.a = e.a AND x.pair_id <> e.pair_id AND abs(x.b - e.a) <= 4 AND abs(x.b - e.b) <= 4 JOIN d y ON y.a = x.b AND y.b = e.b AND y.pair_id <> e.pair_id AND y.pair_id <> x.pair_id)
SELECT e.pair_id, round(coalesce(quantile_cont(err, 0.5), -1.0), 3) AS cycle_error, count(err) AS cycles FROM e LEFT JOIN c USING (pair_id) GROUP BY e.pair_id"""

ORACLE["source_selection"] = f"""WITH {_MATCHES},
e AS (SELECT m.part AS ref, m.supp AS source, m.part % 25 = s_nationkey AS same, CAST(abs(m.part % 25 - s_nationkey) AS DOUBLE) AS d FROM m JOIN part ON p_partkey = m.part JOIN supplier ON s_suppkey = m.supp),
r AS (SELECT *, row_number() OVER (PARTITION BY ref, same ORDER BY d, source) AS k FROM e),
c AS (SELECT *, CASE WHEN same AND k = 1 THEN 0 WHEN NOT same AND k <= 1 THEN 1 ELSE 2 END AS cls FROM r),
q AS (SELECT ref, source, CAST(row_number() OVER (PARTITION BY ref ORDER BY cls, CASE WHEN cls = 2 AND NOT same THEN 1 ELSE 0 END, d, source) AS INTEGER) AS rank FROM c)
SELECT ref, source, rank FROM q WHERE rank <= 6"""

ORACLE["capped_adjacency"] = f"""WITH {_STEPS}, o AS (SELECT k, row_number() OVER (ORDER BY v DESC, k) AS ord FROM s),
both_ AS (SELECT a AS ref, b AS source FROM near UNION SELECT b, a FROM near),
r AS (SELECT ref, source, CAST(row_number() OVER (PARTITION BY ref ORDER BY ord) AS INTEGER) AS rank FROM both_ JOIN o ON o.k = source)
SELECT * FROM r WHERE rank <= 4"""

ORACLE["support_sources"] = f"""WITH {_MATCHES}, e AS (SELECT part AS ref, supp AS source, part % 2 = supp % 2 AS same, inliers FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY ref, same ORDER BY inliers DESC, source) AS side FROM e),
r AS (SELECT ref, source, CAST(row_number() OVER (PARTITION BY ref ORDER BY (CASE WHEN same THEN side <= 2 ELSE side <= 1 END) DESC, same DESC, inliers DESC, source) AS INTEGER) AS rank FROM k)
SELECT * FROM r WHERE rank <= 4"""

ORACLE["exactly_once"] = """WITH w AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) GROUP BY 1), e AS (SELECT DISTINCT o_orderkey AS k FROM orders),
x AS (SELECT e.k AS e, w.k AS w, n FROM e FULL JOIN w ON e.k = w.k)
SELECT count(e) AS n_expected, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_written, count(w) AS n_distinct, count(*) FILTER (w IS NULL) AS n_missing, count(*) FILTER (e IS NULL) AS n_unexpected, count(*) FILTER (n > 1) AS n_repeated,
       count(*) FILTER (w IS NULL OR e IS NULL OR n > 1) = 0 AS passed FROM x"""

ORACLE["set_differences"] = """WITH x AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), y AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '5-LOW')
SELECT 'left' AS side, k FROM (SELECT k FROM x EXCEPT SELECT k FROM y) UNION ALL SELECT 'right', k FROM (SELECT k FROM y EXCEPT SELECT k FROM x)"""

ORACLE["pair_prune"] = "SELECT l_returnflag, count(*) AS rows, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1"

ORACLE["replaced_rows"] = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 3 THEN 'R' ELSE o_orderstatus END AS o_orderstatus FROM orders"

ORACLE["recompute_set"] = "SELECT doc_id, sha256(text) AS sha, source FROM documents WHERE source = 'src3'"

ORACLE["tile_audit"] = """WITH t AS (SELECT DISTINCT l_partkey % 24 AS tile, l_partkey AS ref, l_suppkey AS source FROM lineitem),
refs AS (SELECT ref, count(DISTINCT tile) AS tiles FROM t GROUP BY ref),
c AS (SELECT count(*) FILTER (tiles IS NULL) AS missing, count(*) FILTER (p_partkey IS NULL) AS extra, count(*) FILTER (tiles > 1) AS repeated FROM part FULL JOIN refs ON p_partkey = ref),
each_ AS (SELECT tile, ref, count(*) AS sources, count(*) FILTER (a.s_nationkey <> b.s_nationkey) AS x, count(*) FILTER (ref = source) AS self FROM t LEFT JOIN supplier a ON a.s_suppkey = ref LEFT JOIN supplier b ON b.s_suppkey = source GROUP BY tile, ref),
s AS (SELECT CAST(coalesce(sum(sources), 0) AS BIGINT) AS edges, CAST(coalesce(sum(x), 0) AS BIGINT) AS cross_ring_edges, count(*) FILTER (x = 0) AS no_cross, count(*) FILTER (sources > 6) AS over_cap, CAST(coalesce(sum(self), 0) AS BIGINT) AS self_edges FROM each_)
SELECT *, missing = 0 AND extra = 0 AND repeated = 0 AND no_cross = 0 AND over_cap = 0 AND self_edges = 0 AS passed FROM c, s"""

ORACLE["track_distribution"] = """WITH t AS (SELECT l_orderkey, count(*) AS len, count(DISTINCT l_suppkey) AS images FROM lineitem GROUP BY 1)
SELECT count(*) AS tracks, round(avg(len), 6) AS mean_length, max(len) AS max_length, quantile_cont(len::DOUBLE, 0.1) AS p10, quantile_cont(len::DOUBLE, 0.5) AS p50, quantile_cont(len::DOUBLE, 0.9) AS p90, quantile_cont(len::DOUBLE, 0.99) AS p99,
       round(avg((len = 2)::INT), 6) AS frac_2, round(avg((len >= 3)::INT), 6) AS frac_ge_3, round(avg((len >= 4)::INT), 6) AS frac_ge_4, count(*) FILTER (images < len) AS duplicate_image_tracks FROM t"""

_COVERAGE = """SELECT c_nationkey, count(*) FILTER (c_acctbal > 0) AS selected, count(*) FILTER (c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders)) AS registered FROM customer GROUP BY 1"""
ORACLE["ring_coverage"] = f"SELECT *, round(CASE WHEN selected > 0 THEN registered / selected ELSE 0.0 END, 6) AS fraction FROM ({_COVERAGE})"

ORACLE["summary_quantiles"] = """SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(min(l_extendedprice), 4) AS least FROM lineitem GROUP BY 1, 2"""

ORACLE["support_fraction"] = "SELECT l_orderkey, count(*) AS length, round(avg((l_discount < 0.07)::INT), 6) AS support FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND avg((l_discount < 0.07)::INT) >= 0.6"

ORACLE["centroid_spread"] = """WITH c AS (SELECT l_returnflag, avg(l_quantity) AS cx, avg(l_discount) AS cy, avg(l_tax) AS cz FROM lineitem GROUP BY 1),
d AS (SELECT c.*, sqrt((l_quantity - cx) ^ 2 + (l_discount - cy) ^ 2 + (l_tax - cz) ^ 2) AS r FROM lineitem JOIN c USING (l_returnflag))
SELECT l_returnflag, round(cx, 4) AS cx, round(cy, 4) AS cy, round(cz, 4) AS cz, round(quantile_cont(r, 0.5), 4) AS radius_median, round(stddev_pop(r), 4) AS radius_std, round(stddev_pop(r) / greatest(avg(r), 1e-9), 4) AS radius_cv FROM d GROUP BY l_returnflag, cx, cy, cz"""

ORACLE["robust_bounds"] = "SELECT count(*) AS n, " + ", ".join(f"round(min({a}), 4) AS {a}_min, round(max({a}), 4) AS {a}_max, round(quantile_cont({a}, 0.001), 4) AS {a}_low, round(quantile_cont({a}, 0.999), 4) AS {a}_high" for a in ("l_quantity", "l_extendedprice")) + " FROM lineitem"

ORACLE["even_sample"] = """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
SELECT DISTINCT pos, o_orderkey FROM r, range(0, 50) s(k) WHERE n <= 50 OR pos = round_even(k * (n - 1) / 49.0, 0)"""

ORACLE["lexicographic_best"] = """SELECT p_partkey, p_brand, p_size, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice, p_partkey DESC) AS k FROM part) WHERE k = 1"""

_REGIONS = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in REGIONS.items())
ORACLE["anatomy_regions"] = f"""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem),
p AS (SELECT greatest(0.0, least(1.0, (l_extendedprice - lo) / greatest(hi - lo, 1e-9))) AS h, l_discount < 0.08 AS ok, l_linenumber AS views FROM lineitem, q),
s AS (SELECT region, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM (VALUES {_REGIONS}) v(region, lo, hi)),
r AS (SELECT * FROM p JOIN s ON h BETWEEN lo AND hi)
SELECT region, count(*) AS points, count(*) FILTER (ok) AS supported, round(count(*) FILTER (ok) / count(*), 6) AS supported_fraction, round(count(*) FILTER (views >= 3) / count(*), 6) AS projected_fraction,
       round(quantile_cont(views::DOUBLE, 0.5), 6) AS median_views,
       round(({" + ".join(f"max((ok AND h >= lo + (hi - lo) / 8 * {i} AND h <= {'hi' if i == 7 else f'lo + (hi - lo) / 8 * {i + 1}'})::INT)" for i in range(8))}) / 8.0, 6) AS bin_occupancy
FROM r GROUP BY region"""

_CAMS = ", ".join(f"({i}, {x}, {z})" for i, (x, z) in enumerate(((0, 0), (1, 0), (-1, 1), (0, -3), (2, 2))))
ORACLE["contamination"] = f"""WITH p AS (SELECT row_number() OVER () AS pid, l_quantity / 10 - 2.5 AS x, l_discount * 20 - 1 AS y, l_tax * 20 + 2 AS z FROM lineitem),
v AS (SELECT pid, 100 * (x + cx) / (z + cz) + 64 AS u, 100 * y / (z + cz) + 48 AS v FROM p, (VALUES {_CAMS}) c(cam, cx, cz) WHERE z + cz > 1e-9),
k AS (SELECT pid, count(*) AS views, count(*) FILTER (u >= 0 AND u < 128 AND v >= 0 AND v < 96) AS inside, count(*) FILTER (v >= 96 * 0.84 AND NOT (u >= 0 AND u < 128 AND v >= 0 AND v < 96)) AS escapes FROM v GROUP BY pid)
SELECT coalesce(views, 0) AS views, coalesce(inside, 0) AS inside, coalesce(escapes, 0) AS escapes, count(*) AS points FROM p LEFT JOIN k USING (pid) GROUP BY 1, 2, 3"""

ORACLE["bottom_escape"] = """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.15) AS t FROM lineitem)
SELECT round(max(t), 6) AS low_threshold, round(avg((l_linenumber % 4 > 0)::INT), 6) AS escape_fraction, round(avg((l_extendedprice <= t AND l_linenumber % 4 >= 2)::INT), 6) AS webbing_fraction FROM lineitem, q"""

ORACLE["voxel_components"] = """WITH RECURSIVE p AS (SELECT c_acctbal / 1000 AS x, (c_custkey % 97)::DOUBLE AS y, (c_custkey * 7 % 89)::DOUBLE AS z FROM customer),
q AS (SELECT quantile_cont(x, 0.01) AS x0, quantile_cont(x, 0.99) AS x1, quantile_cont(y, 0.01) AS y0, quantile_cont(y, 0.99) AS y1, quantile_cont(z, 0.01) AS z0, quantile_cont(z, 0.99) AS z1 FROM p),
c AS (SELECT DISTINCT greatest(0, least(11, floor((x - x0) / greatest(x1 - x0, 1e-9) * 12)))::BIGINT AS a, greatest(0, least(11, floor((y - y0) / greatest(y1 - y0, 1e-9) * 12)))::BIGINT AS b, greatest(0, least(11, floor((z - z0) / greatest(z1 - z0, 1e-9) * 12)))::BIGINT AS c FROM p, q),
n AS (SELECT (a * 12 + b) * 12 + c AS id, a, b, c FROM c),
e AS (SELECT s.id AS u, t.id AS v FROM n s JOIN n t ON abs(s.a - t.a) <= 1 AND abs(s.b - t.b) <= 1 AND abs(s.c - t.c) <= 1 AND s.id <> t.id),
r(id, root) USING KEY (id) AS (SELECT id, id AS root FROM n UNION SELECT e.v, min(r.root) FROM r JOIN e ON e.u = r.id JOIN recurring.r AS o ON o.id = e.v WHERE r.root < o.root GROUP BY e.v),
g AS (SELECT root, count(*) AS k FROM r GROUP BY root)
SELECT CAST(sum(k) AS BIGINT) AS cells, count(*) AS components, round(max(k) / sum(k), 6) AS largest_fraction FROM g"""

ORACLE["connected_parts"] = """WITH RECURSIVE o AS (SELECT DISTINCT o_custkey * 2 AS u, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) * 2 + 1 AS v FROM orders),
e AS (SELECT u, v FROM o UNION SELECT v, u FROM o),
r(id, root) USING KEY (id) AS (SELECT DISTINCT u AS id, u AS root FROM e UNION SELECT e.v, min(r.root) FROM r JOIN e ON e.u = r.id JOIN recurring.r AS q ON q.id = e.v WHERE r.root < q.root GROUP BY e.v)
SELECT root, count(*) AS size FROM r GROUP BY root"""

ORACLE["url_basename"] = """SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$') || '_01.jpg', '\\.[^.]*$', ''), '_(\\d+)$', '') AS stem FROM pages"""

ORACLE["pair_ids"] = f"""WITH {_MATCHES} SELECT DISTINCT least(part + 1, supp + 1) * 2147483647 + greatest(part + 1, supp + 1) AS pair_id, least(part + 1, supp + 1) AS first, greatest(part + 1, supp + 1) AS second FROM m WHERE part <> supp"""

ORACLE["props_json"] = "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_max, count(json_extract(props, '$.k')) AS n FROM events GROUP BY 1"

ORACLE["gate_report"] = f"""WITH c AS (SELECT min(registered) > 0 AS a, count(*) > 0 AS b FROM ({_COVERAGE}))
SELECT false AS passed, array_to_string(list_filter([CASE WHEN NOT a THEN 'useful_ring_coverage' END, CASE WHEN NOT b THEN 'cross_ring_connectivity' END, 'cloth_measurement_available', 'cloth_not_dominant', 'visual_review'], lambda x: x IS NOT NULL), ',') AS reasons FROM c"""

ORACLE["component_gate"] = """WITH n AS (SELECT count(*) AS n FROM lineitem GROUP BY l_linestatus, l_returnflag), f AS (SELECT n / (SELECT sum(n) FROM n) AS f FROM n),
t AS (SELECT list_sort(list(f), 'DESC') AS f FROM f)
SELECT f[1] >= 0.95 AND coalesce(f[2], 0) <= 0.02 AS passed, array_to_string(list_filter([CASE WHEN NOT f[1] >= 0.95 THEN 'dominant_face_fraction' END, CASE WHEN NOT coalesce(f[2], 0) <= 0.02 THEN 'second_largest_face_fraction' END], lambda x: x IS NOT NULL), ',') AS reasons FROM t"""
