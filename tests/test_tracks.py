"""Tracks against brute force, with contradictions and odd rows."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from spanloom.operators import components, tracks

ROWS = "pair_id bigint, i1 bigint, k1 bigint, i2 bigint, k2 bigint"


def by_hand(rows, order, priority=(), most=372):
    """Sets of (image, keypoint) and the number of refused rows."""
    n = {p: sum(r[0] == p for r in rows) for p in {r[0] for r in rows}}
    key = {"pair_id": lambda r: (r[0],), "strongest": lambda r: (-n[r[0]], r[0]), "priority": lambda r: (r[0] not in priority, -n[r[0]], r[0])}[order]
    sets, refused = [], 0
    for r in sorted(rows, key=lambda r: (*key(r), r[2], r[4])):
        a, b = (next((s for s in sets if o in s), {o}) for o in ((r[1], r[2]), (r[3], r[4])))
        sets = [s for s in sets if s is not a and s is not b]
        if a is b or a == b:
            sets.append(a)
        elif {i for i, _ in a} & {i for i, _ in b}:
            sets += [a, b]
            refused += 1
        else:
            sets.append(a | b)
    return {frozenset(s) for s in sets}, refused


@pytest.mark.parametrize("order", tracks.ORDERS)
def test_components_against_brute_force(spark, order):
    rng = np.random.default_rng(4)
    rows = []
    for a, b in itertools.combinations(range(1, 8), 2):
        for _ in range(int(rng.integers(0, 5))):
            rows.append((a * 100 + b, a, int(rng.integers(0, 7)), b, int(rng.integers(0, 7))))
    rows += [(5050, 50, 1, 50, 1), (5051, 50, 2, 50, 3), (9091, 90, 1, 91, 1), (9091, 90, 1, 91, 1)]  # an observation with itself, one image with itself, a row twice
    want, refused = by_hand(rows, order, {304, 506})
    for most in (372, 3):
        made, row = tracks.track_components(spark.createDataFrame(rows, ROWS).repartition(3), order=order, priority=spark.createDataFrame([(304,), (506,)], "pair_id bigint"), most=most)
        got = {}
        for r in made.collect():
            got.setdefault(r.track, set()).add((r.image, r.keypoint))
        assert {frozenset(s) for s in got.values()} == {s for s in want if 2 <= len(s) <= most}
        assert all(t == min(i << 32 | k for i, k in s) for t, s in got.items())
        r = row.first()
        assert (r.match_rows, r.refused, r.components, r.merges) == (len(rows), refused, len(want), sum(len(s) - 1 for s in want))
        assert (r.tracks, r.short, r.large) == (len(got), sum(len(s) < 2 for s in want), sum(len(s) > most for s in want))
    assert refused > 5


def test_components_of_no_rows(spark):
    made, row = tracks.track_components(spark.createDataFrame([], ROWS))
    assert made.count() == 0 and tuple(row.first()) == (0,) * 7
    with pytest.raises(ValueError, match="order"):
        tracks.track_components(spark.createDataFrame([], ROWS), order="random")


def test_pair_tracks_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(a * 10 + b, a, int(rng.integers(0, 12)), b, int(rng.integers(0, 12)), float(rng.integers(0, 5))) for a, b in itertools.combinations(range(1, 6), 2) for _ in range(int(rng.integers(1, 14)))]
    by = {p: sorted(r for r in rows if r[0] == p) for p in {r[0] for r in rows}}
    used, want = set(), []
    for p in sorted((p for p in by if len(by[p]) >= 3), key=lambda p: (len(by[p]), p)):
        mine = []
        for _, i1, k1, i2, k2, _ in sorted(by[p], key=lambda r: (r[5], r[2], r[4])):
            # A candidate is not kept from its own pair's other candidates.
            if len(mine) < 5 and (i1, k1) not in used and (i2, k2) not in used:
                mine.append((i1, k1, i2, k2))
        if len(mine) >= 3:
            used |= {o for i1, k1, i2, k2 in mine for o in ((i1, k1), (i2, k2))}
            want += [(p, k1, k2) for _, k1, _, k2 in mine]
    got = tracks.pair_tracks(spark.createDataFrame(rows, "pair_id bigint, i1 bigint, k1 bigint, i2 bigint, k2 bigint, error double"), least=3, most=5)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 15


@pytest.mark.parametrize("small", [0, 20_000])
def test_pair_tracks_of_many_groups(spark, monkeypatch, small):
    """Pairs of separate images are told apart by their images, and need no graph of observations; large groups get one, with the same tracks."""
    monkeypatch.setattr(tracks, "SMALL_GROUP", small)
    linked = []
    keep = tracks.components
    monkeypatch.setattr(tracks, "components", lambda edges, u="u", v="v": linked.append(edges.count()) or keep(edges, u, v))
    rng = np.random.default_rng(4)
    rows = [(c * 10 + p, 2 * c + 1, int(rng.integers(0, 4)), 2 * c + 2, int(rng.integers(0, 5)), None if rng.random() < 0.2 else float(rng.integers(0, 3))) for c in range(30) for p in range(4) for _ in range(int(rng.integers(1, 5)))]
    want = []
    for c in range(30):
        used = set()
        by = {p: sorted((r for r in rows if r[0] == p), key=lambda r: (r[5] is None, r[5] or 0, r[2], r[4])) for p in range(c * 10, c * 10 + 4)}
        for p in sorted((p for p in by if len(by[p]) >= 2), key=lambda p: (len(by[p]), p)):
            mine = [r for r in by[p] if (1, r[2]) not in used and (2, r[4]) not in used][:3]
            if len(mine) >= 2:
                used |= {o for r in mine for o in ((1, r[2]), (2, r[4]))}
                want += [(p, r[2], r[4]) for r in mine]
    got = tracks.pair_tracks(spark.createDataFrame(rows, "pair_id bigint, i1 bigint, k1 bigint, i2 bigint, k2 bigint, error double"), least=2, most=3)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 40
    assert linked[0] == 30 and (linked[1] == 0) == (small > 0)


def test_triangulation(spark):
    lens = [100.0, 110.0, 50.0, 60.0]
    eye = lambda *t: [float(v) for v in (1, 0, 0, t[0], 0, 1, 0, t[1], 0, 0, 1, t[2])]

    def see(pose, p):
        c = np.array(pose).reshape(3, 4) @ [*p, 1.0]
        return float(100 * c[0] / c[2] + 50), float(110 * c[1] / c[2] + 60)

    a, b = eye(0, 0, 0), eye(-1, 0.5, 0.2)
    points = [(0.3, -0.2, 4.0), (2.0, 1.0, 9.0), (0.0, 0.0, -3.0)]
    rows = [(k, a, b, lens, lens, *see(a, p), *see(b, p)) for k, p in enumerate(points)]
    rows += [(3, a, a, lens, lens, 50.0, 60.0, 50.0, 60.0), (4, a, b, lens, lens, float("nan"), 1.0, 2.0, 3.0), (5, a, b, lens, lens, 50.0, 60.0, 10.0, 190.0)]
    kinds = "id int, m1 array<double>, m2 array<double>, l1 array<double>, l2 array<double>, u1 double, v1 double, u2 double, v2 double"
    got = {r.id: r for r in tracks.triangulate(spark.createDataFrame(rows, kinds)).collect()}
    for k in (0, 1):
        assert (got[k].x, got[k].y, got[k].z) == pytest.approx(points[k]) and got[k].error < 1e-6
    assert got[2].error == float("inf") and got[4].error == float("inf") and 4 < got[5].error < float("inf")
    assert {r.id for r in tracks.triangulate(spark.createDataFrame(rows, kinds), most_error=4.0).collect()} - {3} == {0, 1}


def test_support_within_tracks(spark):
    seen = [(1, i, 0) for i in range(4)] + [(2, i, 1) for i in range(3)] + [(3, 0, 0), (3, 1, 0)]
    rows = [(7, 0, 0, 1, 0), (7, 0, 0, 1, 0), (7, 1, 0, 2, 0), (7, 3, 0, 2, 0), (7, 0, 1, 1, 1), (7, 0, 1, 2, 0), (7, 1, 1, 2, 9)]
    got = {r.track: (r.images, r.support, r.connected) for r in tracks.track_support(spark.createDataFrame(seen, "track int, image bigint, keypoint bigint"), spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {1: (4, 3, True), 2: (3, 1, False), 3: (2, 1, True)}


def test_best_observation_of_each_image(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, 1, 5, 2.0), (1, 1, 4, 2.0), (1, 1, 3, nan), (1, 2, 1, inf), (1, 2, 0, None), (1, 3, 7, 0.0), (2, 1, 1, 0.0), (2, 1, 2, 0.0), (2, 2, 1, 0.0)]
    got = sorted((r.track, r.image, r.keypoint) for r in tracks.best_observations(spark.createDataFrame(rows, "track int, image int, keypoint int, error double")).collect())
    assert got == [(1, 1, 4), (1, 2, 0), (1, 3, 7)]


def test_components_whose_edges_lie_together(spark, monkeypatch):
    """Chains that a task has whole are settled in it; what is spread over chunks, names too, comes to the same as in rounds."""
    made = []
    keep = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label="t": made.append(label) or keep(df, label))
    chains = spark.range(0, 3000, 1, 3).where("id % 100 < 99").selectExpr("id AS u", "id + 1 AS v")
    got = {r.node: r.root for r in components.near_components(chains).collect()}
    assert got == {k: k - k % 100 for k in range(3000)} and len(made) < 9
    rng = np.random.default_rng(4)
    edges = [(f"é{a}" if a % 5 == 0 else f"n{a}", f"n{b}") for a, b in rng.integers(0, 300, (200, 2)).tolist()] + [(None, "n1"), ("n2", None), ("z", "z")]
    df = spark.createDataFrame(edges, "u string, v string").repartition(7)
    want = {r.node: r.root for r in components.components(df).collect()}
    assert {r.node: r.root for r in components.near_components(df).collect()} == want and len(set(want.values())) > 5
    monkeypatch.setattr(components, "CHUNK", 4)
    batches = [pa.RecordBatch.from_pydict({"u": [2 * k], "v": [2 * k - 1 if k else 9]}) for k in range(10)]
    assert [s.num_rows for s in components._stars(iter(batches))] == [8, 8, 4]
    assert not components.near_components(spark.createDataFrame([], "u bigint, v bigint")).count()


def test_an_observation_of_many_tracks(spark):
    """Each track that holds both ends of a row counts it."""
    seen = [(t, i, 0) for t in range(30) for i in range(3)] + [(99, 0, 0), (99, 7, 7)]
    rows = [(1, 0, 0, 1, 0), (2, 1, 0, 2, 0), (1, 0, 0, 1, 0), (3, 0, 0, 7, 7)]
    got = {r.track: (r.images, r.support, r.connected) for r in tracks.track_support(spark.createDataFrame(seen, "track int, image bigint, keypoint bigint"), spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {t: (3, 2, True) for t in range(30)} | {99: (2, 1, True)}
