"""DuckDB SQL of the greedy selections: a fold over all pairs in their total order, with the parts as lists."""

from __future__ import annotations

_PAIRS = """pv AS (SELECT a + 1 AS i1, a + d + 1 AS i2, (a + 1) * 2147483647 + a + d + 1 AS pair_id, a % 5 = (a + d) % 5 AS same, a % 4 = 0 AS outlier, a % 3 = 0 AS cyc, d AS far, CAST(floor(abs(s_acctbal)) AS BIGINT) AS inliers
  FROM (SELECT s_suppkey AS a FROM supplier), (SELECT unnest([1, 2, 3]) AS d) JOIN supplier ON s_suppkey = a + d),
rw AS (SELECT pair_id, r, i1 * 4294967296 + r AS u, i2 * 4294967296 + r + CASE WHEN (i1 * 7 + r) % 17 = 0 THEN 1 ELSE 0 END AS v FROM pv, (SELECT unnest(range(0, 6)) AS r)),
rl AS (SELECT pair_id, list({'r': r, 'u': u, 'v': v} ORDER BY r) AS l FROM rw GROUP BY 1)"""


def joined(parts: str, u: str, v: str) -> str:
    """{t, bad} of a list of parts after joining those of u and v; bad, and as it was, if an image would be there twice."""
    return f"""list_transform([{{'m': coalesce(list_filter({parts}, lambda s: list_contains(s, {u}))[1], [{u}]), 'n': coalesce(list_filter({parts}, lambda s: list_contains(s, {v}))[1], [{v}]), 'o': list_filter({parts}, lambda s: NOT list_contains(s, {u}) AND NOT list_contains(s, {v}))}}],
  lambda j: CASE WHEN list_contains(j.m, {v}) THEN {{'t': list_append(j.o, j.m), 'bad': false}} WHEN list_has_any(list_transform(j.m, lambda q: q >> 32), list_transform(j.n, lambda q: q >> 32)) THEN {{'t': j.o || [j.m, j.n], 'bad': true}} ELSE {{'t': list_append(j.o, j.m || j.n), 'bad': false}} END)[1]"""


_ROW_ORDER = "far, inliers DESC, pair_id"
_NO_PARTS = "CAST([] AS BIGINT[][])"

ORACLE = {
    "conflict_free_pairs": f"""WITH {_PAIRS}, ls AS (SELECT list({{'p': pair_id, 'l': l}} ORDER BY same DESC, cyc DESC, {_ROW_ORDER}) AS l FROM pv JOIN rl USING (pair_id)),
f AS (SELECT list_reduce(l, lambda acc, x: list_transform([list_reduce(x.l, lambda a, y: CASE WHEN a.bad THEN a ELSE {joined("a.t", "y.u", "y.v")} END, {{'t': acc.t, 'bad': false}})],
  lambda w: {{'t': CASE WHEN w.bad THEN acc.t ELSE w.t END, 'o': list_append(acc.o, {{'p': x.p, 'ok': NOT w.bad}})}})[1], {{'t': {_NO_PARTS}, 'o': CAST([] AS STRUCT(p BIGINT, ok BOOLEAN)[])}}) AS z FROM ls)
SELECT o.p AS pair_id, o.ok AS accepted FROM (SELECT unnest(z.o) AS o FROM f)""",
    "conflict_free_rows": f"""WITH {_PAIRS}, ls AS (SELECT list({{'p': pair_id, 'cap': CASE WHEN outlier THEN 4 ELSE 1000 END, 'l': l}} ORDER BY same DESC, outlier, cyc DESC, {_ROW_ORDER}) AS l FROM pv JOIN rl USING (pair_id)),
f AS (SELECT list_reduce(l, lambda acc, x: list_transform([list_reduce(x.l, lambda a, y: CASE WHEN a.k >= x.cap THEN {{'t': a.t, 'k': a.k, 'o': list_append(a.o, {{'p': x.p, 'r': y.r, 'kept': false, 'capped': true}})}}
    ELSE list_transform([{joined("a.t", "y.u", "y.v")}], lambda h: {{'t': h.t, 'k': a.k + CASE WHEN h.bad THEN 0 ELSE 1 END, 'o': list_append(a.o, {{'p': x.p, 'r': y.r, 'kept': NOT h.bad, 'capped': false}})}})[1] END, {{'t': acc.t, 'k': 0, 'o': acc.o}})],
  lambda w: {{'t': w.t, 'o': w.o}})[1], {{'t': {_NO_PARTS}, 'o': CAST([] AS STRUCT(p BIGINT, r BIGINT, kept BOOLEAN, capped BOOLEAN)[])}}) AS z FROM ls)
SELECT o.p AS pair_id, o.r AS row, o.kept AS kept, o.capped AS capped FROM (SELECT unnest(z.o) AS o FROM f)""",
    "spanning_bridges": f"""WITH {_PAIRS}, ls AS (SELECT list({{'p': pair_id, 'u': i1 << 32, 'v': i2 << 32, 'b': same}} ORDER BY same DESC, inliers DESC, pair_id) AS l FROM pv),
f AS (SELECT list_reduce(l, lambda acc, x: list_transform([{joined("acc.t", "x.u", "x.v")}], lambda w: {{'t': w.t, 'o': list_append(acc.o, {{'p': x.p, 's': x.b OR NOT coalesce(list_contains(list_filter(acc.t, lambda s: list_contains(s, x.u))[1], x.v), false)}})}})[1],
  {{'t': {_NO_PARTS}, 'o': CAST([] AS STRUCT(p BIGINT, s BOOLEAN)[])}}) AS z FROM ls)
SELECT o.p AS pair_id, o.s AS selected FROM (SELECT unnest(z.o) AS o FROM f)""",
    "capped_matching": f"""WITH {_PAIRS}, ls AS (SELECT list({{'p': pair_id, 'a': i1, 'b': i2, 'near': i1 % 7 > 0}} ORDER BY inliers DESC, i1, i2) AS l FROM pv WHERE NOT same),
f AS (SELECT list_reduce(l, lambda acc, x: list_transform([CASE WHEN len(list_filter(acc.u, lambda s: s = x.a)) >= 2 OR len(list_filter(acc.u, lambda s: s = x.b)) >= 2 THEN 'per_image_cap' WHEN NOT x.near THEN 'non_adjacent_ring_edge' ELSE 'selected' END],
  lambda w: {{'u': CASE WHEN w = 'selected' THEN acc.u || [x.a, x.b] ELSE acc.u END, 'o': list_append(acc.o, {{'p': x.p, 'r': w}})}})[1], {{'u': CAST([] AS BIGINT[]), 'o': CAST([] AS STRUCT(p BIGINT, r VARCHAR)[])}}) AS z FROM ls)
SELECT o.p AS pair_id, o.r AS reason FROM (SELECT unnest(z.o) AS o FROM f)""",
}
