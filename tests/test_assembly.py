"""Assembled graphs, tiles to do again, and depth between rings on small cases."""

import numpy as np
import pytest

from spanloom.operators import assembly
from spanloom.operators.graph import INLIER, OUTLIER
from spanloom.operators.rotation import SAME

PAIRS, META = "pair_id bigint, first string, second string, inliers bigint", "name string, ring string, frame bigint"


def test_corrected_graph(spark):
    meta = spark.createDataFrame([("a.jpg", "g1", 0), ("b.jpg", "g1", 1), ("b_01.jpg", "g1", 2), ("c.jpg", "g2", 0), ("d.jpg", "g2", 1), ("e.jpg", "g3", 0), ("f.jpg", "g1", 9)], META)
    pairs = [(1, "a.jpg", "b.jpg", 400), (2, "b.jpg", "b_01.jpg", 900), (3, "a.jpg", "b_01.jpg", 350), (4, "a.jpg", "c.jpg", 200), (5, "a.jpg", "d.jpg", 190), (6, "b.jpg", "c.jpg", 180), (7, "b_01.jpg", "d.jpg", 170), (8, "a.jpg", "f.jpg", 500), (9, "a.jpg", "x.jpg", 500), (10, "c.jpg", "e.jpg", 120), (11, "d.jpg", "e.jpg", 110), (12, "b.jpg", "e.jpg", 999), (13, "c.jpg", "d.jpg", 99), (14, "f.jpg", "c.jpg", 99)]
    run = lambda order, most: {r.pair_id: (r.selected, r.reason) for r in assembly.corrected_graph(spark.createDataFrame(pairs, PAIRS), meta, order, same_ring_inliers=100, cross_ring_inliers=100, most_cross=most).collect()}
    got = run(["g1", "g2", "g3"], 1)
    assert 9 not in got and {k for k, v in got.items() if v[0]} == {1, 3, 4, 7, 10}
    assert got[2][1] == got[8][1] == got[13][1] == "same_ring_duplicate_or_weak_or_nonlocal" and got[14][1] == "cross_ring_weak_verified_support"
    assert got[5][1] == got[6][1] == got[11][1] == "cross_ring_per_image_cap" and got[12][1] == "non_adjacent_ring_edge"
    # The cap leaves no pair of g2 and g3, so the strongest comes in all the same.
    assert got[10][1] == "boundary_bridge_rescue"
    free = run(None, 2)
    assert free[12] == (True, "cross_ring_verified_support_pending_cap") and free[10][1] != "boundary_bridge_rescue"


def test_mapper_graph(spark):
    rows = [(1, "a", "b", 50, SAME), (2, "b", "c", 40, OUTLIER), (3, "a", "c", 60, OUTLIER), (4, "c", "d", 9, INLIER), (5, "a", "d", 60, OUTLIER)]
    make = lambda rows: (spark.createDataFrame([(*r[:4], 1.0, 0.5) for r in rows], f"{PAIRS}, tri_angle double, homography double"), spark.createDataFrame([(r[1], r[2], r[4]) for r in rows], "first string, second string, status string"))
    got = {r.pair_id: r.kind for r in assembly.mapper_graph(*make(rows)).collect()}
    assert got == {1: "base", 2: "excluded", 3: "bridge", 4: "base", 5: "excluded"}
    records, consensus = make(rows)
    for match, args in (("consensus status None", (records, consensus.where("first <> 'c'"))), ("status 'odd'", make([*rows, (6, "d", "e", 5, "odd")])), ("parts remain", make([*rows, (6, "x", "y", 5, SAME)])), ("more than once", (records.unionByName(records), consensus))):
        with pytest.raises(ValueError, match=match):
            assembly.mapper_graph(*args)


def test_affected_tiles(spark):
    images = spark.createDataFrame([(f"i{k}", k) for k in range(7)], "name string, pos bigint")
    sources = spark.createDataFrame([("i0", "i6"), ("i0", "i1"), ("i5", "i2"), ("i6", "i5")], "ref string, source string")
    got = [tuple(r) for r in assembly.affected_tiles(images, sources, spark.createDataFrame([("i6",), ("i1",), ("gone",)], "name string"), size=2).orderBy("tile").collect()]
    assert got == [(0, 0, 2, ["i1"], ["i1", "i6"], True), (1, 2, 2, [], [], False), (2, 4, 2, [], [], False), (3, 6, 1, ["i6"], ["i6"], True)]


def test_even_spread(spark):
    edges = [(f"a{k:02}", f"b{k:02}", "r", "s") for k in range(11)] + [("b00", "a00", "s", "r"), ("a00", "a01", "r", "r")]
    got = assembly.spread_edges(spark.createDataFrame(edges, "ref string, source string, ring string, source_ring string"), 4).collect()
    assert sorted((r.ref, r.pairs) for r in got) == sorted([(f"a{int(i):02}", 11) for i in np.linspace(0, 10, 4, dtype=np.int64)] + [("b00", 1)])
    rng = np.random.default_rng(1)
    spots = sorted({(int(y), int(x)) for y, x in rng.integers(0, 30, (200, 2))})
    depth = spark.createDataFrame([("m", x, y, 1.0) for y, x in spots] + [("n", 3, 4, 2.0)], "image string, x bigint, y bigint, depth double").repartition(3)
    for most in (1, 7, 60, 1000):
        got = [(r.y, r.x) for r in assembly.spread_pixels(depth, most).where("image = 'm'").collect()]
        want = spots if len(spots) <= most else [spots[int(i)] for i in np.linspace(0, len(spots) - 1, most, dtype=np.int64)]
        assert sorted(got) == sorted(want)


def test_depth_of_one_plane_agrees(spark):
    eye = lambda x: [float(v) for v in (1, 0, 0, -x, 0, 1, 0, 0, 0, 0, 1, 0)]
    lens = [10.0, 10.0, 8.0, 6.0]
    cameras = spark.createDataFrame([("a", eye(0), lens), ("b", eye(0.8), lens), ("c", eye(100), lens), ("d", eye(0), lens), ("e", eye(0), lens)], "image string, m array<double>, k array<double>")
    plane = lambda n, z, inside=True: [(n, x, y, float(z), inside) for x in range(16) for y in range(12)]
    depth = spark.createDataFrame(plane("a", 4.0) + plane("b", 4.0) + plane("c", 4.0) + plane("d", 4.2) + plane("e", 4.0, False), "image string, x bigint, y bigint, depth double, inside boolean")
    edges = [("a", "b", "r", "s"), ("a", "c", "r", "s"), ("a", "d", "r", "q"), ("e", "a", "t", "r"), ("a", "z", "r", "u")]
    edges = spark.createDataFrame(edges, "ref string, source string, ring string, source_ring string")
    got = {(r.ref, r.source): r for r in assembly.depth_pairs(edges, depth, cameras).collect()}
    ab = got["a", "b"]
    # The step of two pixels loses two columns of sixteen.
    assert (ab.status, ab.sampled, ab.coverage, ab.consistency, ab.median) == ("measured", 192, 14 / 16, 1.0, 0.0)
    ad = got["a", "d"]
    assert ad.consistency == 0.0 and ad.median == pytest.approx(0.4 / 8.2)
    assert [got[k].status for k in (("a", "c"), ("e", "a"), ("a", "z"))] == ["no_cross_view_overlap", "reference_depth_has_no_valid_pixels", "depth_map_missing"]
    judged = {(r.ring, r.source_ring): (r.status, r.diagnostic_status, r.measured_pairs, r.selected_pairs) for r in assembly.ring_transitions(edges, depth, cameras).collect()}
    assert judged == {("r", "s"): ("failed", "below_threshold", 1, 2), ("r", "q"): ("passed", "below_threshold", 1, 1), ("t", "r"): ("failed", "below_threshold", 0, 1), ("r", "u"): ("failed", "below_threshold", 0, 1)}
