import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom import state
from spanloom.operators import audits, cloud, dedupe, evidence, gates, graph, phases, selection, stats
from spanloom.operators.components import components


def frames(spark, **rings):
    rows = [(r, f"{r}_{i}", i, len(ps), float(p)) for r, ps in rings.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "ring string, name string, pos bigint, n bigint, phase double")


def even(n):
    return [i / n for i in range(n)]


def order(spark, *rings):
    return spark.createDataFrame([(r, i) for i, r in enumerate(rings)], "ring string, ord int")


def pairs_of(df):
    return {(r.a, r.b) for r in df.collect()}


def test_schedule_closes_the_ring(spark):
    got = phases.pair_schedule(frames(spark, g8=even(4), g9=even(3)), order(spark, "g8", "g9"), same=1, wider=0, cross=0)
    rows = [(r.a, r.b) for r in got.collect()]
    assert len(rows) == len(set(rows)) and all(a < b for a, b in rows) and ("g8_0", "g8_3") in rows


def test_nearest_phase_is_not_the_same_index(spark):
    got = pairs_of(phases.pair_schedule(frames(spark, low=even(4), high=even(3)), order(spark, "low", "high"), same=1, wider=0, cross=0))
    assert ("high_2", "low_3") in got and ("high_0", "low_3") not in got


def test_offset_shifts_the_target(spark):
    f = frames(spark, low=even(4), high=[0.25, 0.5, 0.75])
    offs = spark.createDataFrame([("low", 0.25)], "ring string, offset double")
    got = pairs_of(phases.pair_schedule(f, order(spark, "low", "high"), same=1, wider=0, cross=0, offsets=offs))
    assert ("high_0", "low_0") in got


def test_nearest_phase_against_brute_force(spark):
    rng = np.random.default_rng(5)
    left = [("k", f"l{i}", float(x)) for i, x in enumerate(rng.integers(0, 20, 40) / 20)]
    right = [("k", f"r{i:02d}", float(x), i, 15) for i, x in enumerate(rng.integers(0, 20, 15) / 20)]
    got = phases.nearest_phase(spark.createDataFrame(left, "key string, name string, target double"), spark.createDataFrame(right, "key string, name string, phase double, pos bigint, n bigint")).collect()
    dist = lambda a, b: min(abs(a - b), 1 - abs(a - b))
    want = {n: min(right, key=lambda r: (dist(t, r[2]), r[1]))[1] for _, n, t in left}
    assert {r.name: r.nearest for r in got} == want


def test_best_offset(spark):
    v = spark.createDataFrame([("a", "b", 0.0, 10.0), ("a", "b", 0.25, 7.0), ("a", "b", 0.5, 2.0)], "left string, right string, offset double, score double")
    r = phases.best_offset(v, 2.0).first()
    assert r.offset == 0 and r.margin == 3 and not r.ambiguous
    assert phases.best_offset(v.where("offset <> .25").unionByName(v.limit(1).selectExpr("left", "right", "0.25 as offset", "9.5D as score")), 1.0).first().ambiguous


def test_repeated_cycle_is_found(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(80, 16))
    sig = np.vstack([base, base[:40] + rng.normal(size=(40, 16)) * 0.01])
    df = spark.createDataFrame([("r", i, s.tolist()) for i, s in enumerate(sig)], "ring string, pos bigint, sig array<double>")
    r = phases.repeated_cycle(phases.cycle_splits(df)).first()
    assert r.split == 80 and r.repeated


def test_prioritized_sources(spark):
    names = {"a": ("g1", 0), "b": ("g1", 0.25), "c": ("g2", 0.5), "d": ("g2", 0.75)}
    rows = []
    for x in names:
        for i, y in enumerate(names):
            if x != y:
                d = abs(names[x][1] - names[y][1])
                rows.append((x, y, names[x][0] == names[y][0], min(d, 1 - d), i))
    got = selection.prioritized_sources(spark.createDataFrame(rows, "ref string, source string, same_ring boolean, distance double, ord int"), most=2)
    by = {}
    for r in got.orderBy("ref", "rank").collect():
        by.setdefault(r.ref, []).append(r.source)
    assert by["a"] == ["b", "d"] and by["c"] == ["d", "b"]


def test_capped_adjacency(spark):
    p = spark.createDataFrame([("a", "c"), ("b", "a"), ("d", "c")], "a string, b string")
    o = spark.createDataFrame([(x, i) for i, x in enumerate("abcd")], "name string, ord int")
    got = {}
    for r in selection.capped_adjacency(p, o).orderBy("rank").collect():
        got.setdefault(r.ref, []).append(r.source)
    assert got == {"a": ["b", "c"], "b": ["a"], "c": ["a", "d"], "d": ["c"]}
    assert {r.ref: r.source for r in selection.capped_adjacency(p, o, 1).collect()} == {"a": "b", "b": "a", "c": "a", "d": "c"}


def test_exactly_once(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    r = audits.exactly_once(e, spark.createDataFrame([("a",), ("a",)], "k string"), "k").first()
    assert (r.n_missing, r.n_repeated, r.passed) == (2, 1, False)
    assert audits.exactly_once(e, e, "k").first().passed


def test_bottom_escape(spark):
    df = spark.createDataFrame(list(zip([0.8, 0.7, -1.0, -0.9], [3, 1, 0, 2])), "h double, o int")
    r = cloud.bottom_escape(df, "h", "o", 0.5).first()
    assert r.escape_fraction == 0.75 and r.webbing_fraction == 0.25


def test_a_point_outside_the_frame_still_counts_as_seen(spark):
    p = spark.createDataFrame([(1, 100.0, 0.0, 1.0), (2, 0.0, 0.0, -1.0)], "pid int, x double, y double, z double")
    cams = spark.sql("select 0 cam, array(1D,0D,0D,0D,0D,1D,0D,0D,0D,0D,1D,0D) m, array(10D,10D,5D,5D) k, 10 width, 10 height")
    inside = lambda s: (s["p"]["u"] >= 0) & (s["p"]["u"] < s["width"])
    got = {r.pid: (r.views, r["inside"]) for r in cloud.contamination(p, cams, inside, lambda s: s["p"]["v"] >= 8).collect()}
    assert got == {1: (1, 0), 2: (0, 0)}


def test_region_edges_count_twice(spark):
    lo, hi = cloud.REGIONS["base"]
    edge = lo + (hi - lo) / 8 * 4
    p = spark.createDataFrame([(edge, True, 3)], "h double, supported boolean, views int")
    r = {x.region: x for x in cloud.region_evidence(p).collect()}["base"]
    assert r.bin_occupancy == 2 / 8


def test_keypoints_in_mask(spark):
    pts = [(10.2, 5.1), (12.5, 10.5), (2.0, 2.0), (29.0, 19.0), (float("nan"), 3.0)]
    k = spark.createDataFrame([("i", n, *p) for n, p in enumerate(pts)], "image string, idx int, x double, y double")
    mask = spark.createDataFrame([("i", x, y) for y in range(5, 15) for x in range(10, 20)], "image string, px bigint, py bigint")
    edge = spark.createDataFrame([("i", x, 5) for x in range(10, 20)], "image string, px bigint, py bigint")
    assert [r.idx for r in cloud.keypoints_in_mask(k, mask, edge).collect()] == [1]


def test_components_and_mesh(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u bigint, v bigint")
    got = {r.node: r.root for r in components(e).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and len(got) == 63
    faces = spark.createDataFrame([(i, 0, 1, 2) for i in range(199)] + [(199, 3, 4, 5)], "face bigint, a bigint, b bigint, c bigint")
    assert graph.drop_small_components(faces, 0.01).count() == 199


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "pair_id bigint, same_ring boolean, status string, cycle_consistent boolean, frame_distance bigint, inliers bigint, tri_angle double, homography double")


def _rows(spark, table):
    return spark.createDataFrame([(p, i, a, x, b, y) for p, a, b, ms in table for i, (x, y) in enumerate(ms)], "pair_id bigint, row bigint, i1 bigint, k1 bigint, i2 bigint, k2 bigint")


def test_conflict_free_pairs(spark):
    p = _pairs(spark, [(1, True, "", False, 1, 100, 1.0, 0.5), (2, True, "", False, 1, 90, 1.0, 0.5), (3, True, "", False, 2, 80, 1.0, 0.5)])
    r = _rows(spark, [(1, 1, 2, [(0, 0)]), (2, 2, 3, [(0, 0)]), (3, 1, 3, [(1, 0)])])
    assert {x.pair_id: x.accepted for x in graph.conflict_free_pairs(p, r).collect()} == {1: True, 2: True, 3: False}


def test_consensus_first_turns_the_choice(spark):
    p = _pairs(spark, [(1, True, "", False, 1, 2000, 1.0, 0.5), (2, True, "", False, 1, 2000, 1.0, 0.5), (3, False, graph.OUTLIER, False, None, 1000, 1.0, 0.5), (4, False, graph.INLIER, False, None, 10, 1.0, 0.5)])
    both = [(0, 0), (1, 1)]
    r = _rows(spark, [(1, 1, 2, both), (2, 3, 4, both), (3, 1, 3, [(1, 0)]), (4, 2, 4, [(0, 0)])])
    plain = {x.pair_id: x.accepted for x in graph.conflict_free_pairs(p, r).collect()}
    turned = {x.pair_id: x.accepted for x in graph.conflict_free_pairs(p, r, consensus_first=True).collect()}
    assert plain[3] and not plain[4] and turned[4] and not turned[3]


def test_conflict_free_rows(spark):
    p = _pairs(spark, [(1, True, "", False, 1, 100, 1.0, 0.5), (2, True, "", False, 1, 90, 1.0, 0.5), (3, True, "", False, 2, 80, 1.0, 0.5)])
    r = _rows(spark, [(1, 1, 2, [(0, 0), (1, 1)]), (2, 2, 3, [(0, 0), (1, 1)]), (3, 1, 3, [(1, 0), (0, 1), (2, 2)])])
    got = graph.conflict_free_rows(p, r, least_rows=1).collect()
    assert {x.pair_id for x in got if x.kept} == {1, 2, 3} and sum(not x.kept for x in got) == 2
    with pytest.raises(Exception, match="fewer than"):
        graph.conflict_free_rows(p, r, least_rows=2).collect()


def test_cap_on_outlier_rows(spark):
    p = _pairs(spark, [(1, False, graph.OUTLIER, False, None, 9, 1.0, 0.5)]).withColumn("cap", F.lit(1).cast("bigint"))
    got = graph.conflict_free_rows(p, _rows(spark, [(1, 1, 2, [(0, 0), (1, 1), (2, 2)])]), least_rows=1).collect()
    assert sum(x.kept for x in got) == 1 and sum(x.capped for x in got) == 2


def test_bridges_and_matching(spark):
    e = spark.createDataFrame([(1, "a", "b", True, 10, 1.0, 0.1), (2, "b", "c", False, 5, 1.0, 0.1), (3, "a", "c", False, 9, 1.0, 0.1), (4, "c", "d", False, 1, 1.0, 0.0)], "pair_id bigint, a string, b string, base boolean, inliers bigint, tri_angle double, homography double")
    assert {x.pair_id: x.selected for x in graph.spanning_bridges(e).collect()} == {1: True, 2: False, 3: True, 4: True}
    m = graph.capped_matching(e.withColumn("adjacent", F.col("pair_id") != 2), most=1).collect()
    assert {x.pair_id: x.reason for x in m} == {1: "selected", 3: "per_image_cap", 2: "per_image_cap", 4: "selected"}


def test_rotation_averaging_recovers_poses(spark):
    def rz(t):
        c, s = math.cos(t), math.sin(t)
        return np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])

    t = [0, 0.3, 0.9, 1.4, 2.0]
    rows = [("g", f"n{i}", f"n{j}", (rz(t[j]) @ rz(t[i]).T).ravel().tolist(), 100, True) for i in range(5) for j in range(i + 1, 5)]
    got = graph.ring_orientations(spark.createDataFrame(rows, "ring string, a string, b string, rotation array<double>, inliers int, conditioned boolean")).collect()
    for r in got:
        assert np.allclose(np.array(r.rotation).reshape(3, 3), rz(t[int(r.name[1])]), atol=1e-8)
    votes = spark.createDataFrame([("x", f"a{i}", f"b{i}", rz(0.2 if i else 2.0).ravel().tolist(), 1.0) for i in range(4)], "transition string, a string, b string, rotation array<double>, weight double")
    r = graph.transition_consensus(votes).first()
    assert r.inliers == 3 and np.allclose(np.array(r.rotation).reshape(3, 3), rz(0.2), atol=1e-8)


def test_centers_from_directions(spark):
    c = {"a": (0, 0, 0), "b": (1, 0, 0), "c": (0, 1, 0), "d": (0, 0, 1)}
    rows = []
    for x in c:
        for y in c:
            if x < y:
                d = np.subtract(c[y], c[x])
                rows.append((x, y, *(d / np.linalg.norm(d)).tolist(), 1.0))
    got = {r.name: np.array(r.center) for r in graph.solve_centers(spark.createDataFrame(rows, "a string, b string, dx double, dy double, dz double, weight double")).collect()}
    unit = got["b"] / np.linalg.norm(got["b"])
    assert np.allclose(unit, [1, 0, 0], atol=1e-2) and np.allclose(got["a"], 0)


def test_ring_components(spark):
    rings = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "ring string")
    e = spark.createDataFrame([("g2", "g3", 100), ("g1", "g2", 3)], "ring_a string, ring_b string, inliers int")
    assert {r.ring: r.component for r in graph.ring_components(rings, e, 50).collect()} == {"g1": "g1", "g2": "g2", "g3": "g2"}


def test_outliers_and_classes(spark):
    df = spark.createDataFrame([("r", float(i % 3)) for i in range(30)] + [("r", 1000.0)], "ring string, jump double")
    assert evidence.robust_outliers(df, ["ring"], "jump").where("is_outlier").count() == 1
    row = spark.sql("select 2 config, array(1D,0D,0D,0D,1D,0D,0D,0D,1D) rotation, array(0D,0D,1D) translation, 150 inliers, 1D tri_angle, .9D cheirality, cast(null as double) homography, cast(null as double) rank_ratio")
    r = evidence.classify_pairs(row).first()
    assert r.reasons == ["essential_rank_defective"] and not r.well_conditioned


def test_duplicates_of_the_first_only(spark):
    df = spark.createDataFrame([("g", 1, 0), ("g", 2, 0b111111), ("g", 3, 0b111111111111)], "grp string, key int, word bigint")
    assert [r.key for r in dedupe.near_anchor_duplicates(df, "grp", "key", F.col("word")).collect()] == [2]


def test_gates_fail_closed(spark):
    df = spark.createDataFrame([([0.6657, 0.22, 0.1143],), ([0.965, 0.012, 0.008, 0.005],), ([],)], "fractions array<double>")
    assert [r.passed for r in gates.component_gate(df).collect()] == [False, True, False]
    row = spark.sql("select 1 min_registered, 2 cross_ring_connections, .1D board_fraction, double('nan') cloth_fraction, 'passed' trajectory_status, 'passed' visual_status")
    r = gates.sparse_gate(row).first()
    assert not r.passed and r.reasons == ["cloth_measurement_available", "cloth_not_dominant"]


def test_review_and_dense_gates(spark):
    h = {v: f"{i:064x}" for i, v in enumerate(gates.VIEWS)}
    good = {
        "contamination_metrics": {k: 0.01 for k in gates.CONTAMINATION_LIMITS}, "contamination_findings": dict(gates.CONTAMINATION_FINDINGS), "board_point_fraction": 0.01,
        "previews": {v: (f"{v}.png", x, x) for v, x in h.items()}, "regions": dict.fromkeys(gates.REGIONS, True), "review_findings": dict(gates.CONTAMINATION_FINDINGS), "reviewer": "Ann", "approver": "Bo", "review_status": "passed", "approval_status": "passed",
        "finite_xyz_fraction": 1.0, "point_count": 9, "rank": 3, "smoke_status": "passed", "depth_normal_count": 2, "visual_status": "passed",
        "vertex_count": 4, "face_count": 2, "mesh_finite_xyz_fraction": 1.0, "mesh_rank": 3, "required_regions": dict.fromkeys(gates.REGIONS, True), "raw_board_fraction": 0.01, "raw_cloth_fraction": 0.01,
    }
    types = {dict: "map<string,boolean>", str: "string", float: "double", int: "bigint"}
    kinds = {"contamination_metrics": "map<string,double>", "previews": "map<string,struct<path:string,sha256:string,actual_sha256:string>>"}
    schema = ", ".join(f"{k} {kinds.get(k, types[type(v)])}" for k, v in good.items())
    review = {"visual_review"}
    cases = [
        ({}, set(), set(), set(), set()),
        ({"contamination_findings": good["contamination_findings"] | {"board_slab_detected": True}}, {"board_slab_absent"}, set(), {"board_slab_absent"}, {"board_slab_absent"}),
        ({"board_point_fraction": 0.02}, {"board_fraction_inputs_consistent"}, set(), {"board_fraction_inputs_consistent"}, {"board_fraction_inputs_consistent"}),
        ({"previews": good["previews"] | {"side": ("side.png", h["side"], h["front"])}}, set(), {"four_semantic_views", "preview_hashes_verified", "preview_views_distinct"}, review, review | {"review_regions_match"}),
        ({"previews": good["previews"] | {"side": ("front.png", h["side"], h["side"])}}, set(), {"preview_views_distinct"}, review, review | {"review_regions_match"}),
        ({"approver": " ANN "}, set(), {"approval_independent"}, review, review | {"review_regions_match"}),
        ({"regions": good["regions"] | {"more": True}}, set(), {"required_regions_confirmed"}, review, review | {"review_regions_match"}),
        ({"approval_status": None}, set(), {"approval_status_passed"}, review, review | {"review_regions_match"}),
        ({"rank": 2, "mesh_rank": None}, set(), set(), {"rank_3"}, {"mesh_rank_3"}),
        ({"raw_cloth_fraction": 0.03}, set(), set(), set(), {"raw_cloth_fraction_input_matches_measurement"}),
    ]
    df = spark.createDataFrame([tuple((good | c[0]).values()) for c in cases], schema).coalesce(1)
    for i, g in enumerate((gates.contamination_gate, gates.review_gate, gates.dense_gate, gates.raw_visual_gate), 1):
        for c, r in zip(cases, g(df).collect(), strict=True):
            assert set(r.reasons) == c[i] and r.passed == (not c[i]), (g.__name__, c[0])
    empty = spark.createDataFrame([(None,) * len(good)], schema)
    for g in (gates.contamination_gate, gates.review_gate, gates.dense_gate, gates.raw_visual_gate):
        r = g(empty).first()
        assert not r.passed and set(r.checks) - set(r.reasons) <= {"cloth_fraction_inputs_consistent"}  # no column, nothing to compare

def test_empty_groups_are_zero(spark):
    r = stats.track_distribution(spark.createDataFrame([], "t bigint, i bigint"), "t", "i").first()
    assert r.tracks == 0 and r.p50 == 0 and r.frac_2 == 0


def test_even_sample(spark):
    got = selection.even_sample(spark.range(1000).withColumnRenamed("id", "x"), [F.col("x")], 5).collect()
    assert sorted(r.x for r in got) == [0, 250, 500, 749, 999]


def test_stage_table(spark):
    s = state.complete(state.begin(state.new_state(spark, ["a", "b", "c"]), "a", {"x": "1"}, "cfg"), "a", {"out": "h"})
    assert state.reusable(s, "a", {"x": "1"}, "cfg", {"out": "h"}).first().reusable
    assert not state.reusable(s, "a", {"x": "1"}, "cfg", {"out": "changed"}).first().reusable
    assert not state.reusable(s, "a", {"x": "2"}, "cfg", {"out": "h"}).first().reusable
    done = state.complete(state.begin(s, "b", {}, ""), "b", {})
    assert [r.status for r in state.invalidate_from(done, "b").orderBy("ordinal").collect()] == ["complete", "pending", "pending"]


def test_transition_rule(spark):
    row = "measured_pairs int, selected_pairs int, mean_coverage double, mean_consistency double"
    cases = [((3, 3, 0.01, 0.1), ("passed", "below_threshold")), ((3, 3, 1.0, 0.5), ("passed", "passed")), ((2, 3, 0.5, 0.9), ("failed", "below_threshold")), ((0, 0, 0.5, 0.9), ("failed", "below_threshold")), ((3, 3, float("nan"), 0.9), ("failed", "below_threshold")), ((3, 3, 0.5, float("nan")), ("passed", "below_threshold")), ((3, 3, 0.009, 0.9), ("failed", "below_threshold")), ((3, None, 0.5, 0.9), ("failed", "below_threshold"))]
    for values, want in cases:
        r = gates.transition_gate(spark.createDataFrame([values], row)).first()
        assert (r.status, r.diagnostic_status) == want, values


def test_bounds_rule(spark):
    good = {"x_lo": 0.0, "x_hi": 1.0, "ref_x_lo": 0.0, "ref_x_hi": 1.0}
    row = {k.replace("x", a, 1) if k[0] == "x" else k.replace("_x_", f"_{a}_"): v for a in "xyz" for k, v in good.items()} | {"coverage": 0.99}
    changes = [({}, True), ({"coverage": None}, True), ({"coverage": 0.98}, False), ({"ref_y_hi": 0.0}, False), ({"z_hi": 0.0}, False), ({"x_hi": float("inf")}, False), ({"x_hi": 2.0}, True), ({"x_hi": 2.1}, False), ({"x_lo": None}, False)]
    for change, want in changes:
        values = row | change
        df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values))
        assert gates.bounds_gate(df).first().passed == want, change


def test_trajectory_outliers(spark):
    rows = [(i, "r", True, 1.0 + i % 3, 5.0) for i in range(20)] + [(100, "r", True, 99.0, 5.0), (101, "r", True, float("nan"), 5.0), (102, "r", False, 99.0, 99.0), (103, "r", True, 1.0, 50.0), (104, "r", True, None, 99.0), (105, None, True, 99.0, 99.0), (106, "alone", True, float("nan"), None)]
    got = evidence.trajectory_outliers(spark.createDataFrame(rows, "k int, ring string, same boolean, c double, ray double"), "ring", "c", "ray", "same")
    assert {r.k for r in got.where("is_outlier").collect()} == {100, 103} and got.count() == len(rows)


def test_finishing_gates(spark):
    nothing = spark.createDataFrame([(1, None, None, None, None, None)], "k int, residuals int, configured int, termination string, promotion_allowed boolean, eligible boolean")
    assert gates.process_gate(nothing, ["k"]).first().reasons == ["bundle_adjustment_not_successfully_executed", "promotion_not_allowed", "full_sparse_candidate_not_eligible"]
    assert not gates.adjustment_gate(nothing).first().passed
    nan = float("nan")
    ratios = spark.createDataFrame([(1, 0.9, 0.8, True), (2, 0.9, 0.8, False), (3, nan, 0.8, True), (4, 0.9, nan, True), (5, None, None, True)], "k int, baseline_ratio double, candidate_ratio double, candidate_resolved boolean")
    assert [r.promote for r in gates.upper_recovery(ratios, ["k"]).orderBy("k").collect()] == [True, False, True, False, False]
    stages = spark.createDataFrame([("a", s, True) for s in range(14, 18)] + [("b", s, True) for s in (14, 15, 16)] + [("c", s, s != 15) for s in range(14, 18)] + [("d", 3, True)], "run string, stage int, passed boolean")
    assert {r.run: r.passed for r in gates.integrated_success(stages, ["run"]).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_pose_delta_of_nothing(spark):
    none = spark.createDataFrame([], "name string, rotation array<double>, center array<double>")
    r = evidence.pose_delta(none, none).first()
    assert (r.common_view_count, r.rotation_geodesic_max_deg, r.pose_field_unchanged) == (0, float("inf"), False)
    eye = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [1.0, 2.0, 3.0])], none.schema)
    assert evidence.pose_delta(eye, eye).first().pose_field_unchanged


def test_a_refused_pair_leaves_the_sets_as_they_were():
    """All joins of a pair or none, against sets that are merged and searched; nothing is joined and undone."""
    import random

    met = {True: 0, False: 0}
    for seed in range(200):
        r = random.Random(seed)
        sets, made = graph._Disjoint(), []
        for _ in range(15):
            i, j = r.sample(range(6), 2)
            ends = [((i << 32) + r.randrange(3), (j << 32) + r.randrange(3)) for _ in range(r.randint(1, 4))]
            trial = [set(s) for s in made]
            for e in ends:
                joined = set(e).union(*[s for s in trial if not s.isdisjoint(e)])
                trial = [s for s in trial if s.isdisjoint(e)] + [joined]
            fits = all(len({x >> 32 for x in s}) == len(s) for s in trial)
            before = {x: sets.find(x) for s in made for x in s}
            assert sets.join_all(ends) == fits
            made = trial if fits else made
            assert fits or before == {x: sets.find(x) for x in before}
            assert all(len({sets.find(x) for x in s}) == 1 for s in made)
            met[fits] += 1
    assert min(met.values()) > 500


def test_greedy_selections_read_components_over_batches(spark):
    """Batches of three rows, and components that share a task."""
    p = _pairs(spark, [(k, True, "", False, 1, 100 - k, 1.0, 0.5) for k in range(1, 9)])
    r = _rows(spark, [(k, 10 * (k // 3) + k % 3, 10 * (k // 3) + (k + 1) % 3, [(0, 0), (1, 1), (2, 2 + (k % 3 == 2))]) for k in range(1, 9)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        pairs = {x.pair_id: x.accepted for x in graph.conflict_free_pairs(p, r).collect()}
        rows = [(x.pair_id, x.row) for x in graph.conflict_free_rows(p, r, least_rows=0).collect() if not x.kept]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pairs == {k: k not in (5, 8) for k in range(1, 9)} and sorted(rows) == [(5, 2), (8, 2)]
