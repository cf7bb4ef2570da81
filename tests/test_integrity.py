"""The gate of a sparse model: a model that passes, and what each fault does to it."""

import pytest

from spanloom.operators import cloud, evidence, integrity, stats

NAMES = [f"{r}{i}.jpg" for r in "ab" for i in range(4)]
AUDIT = "first string, second string, ring string, second_ring string, same_ring boolean, near_duplicate boolean, calibrated_conditioned boolean, verified_inliers bigint, rotation_disagreement_deg double, shared_final_tracks bigint, trajectory_outlier boolean"


def pair(a, b, inliers=400, turn=1.0, shared=60, jump=False, same=True, near=False, conditioned=True):
    return (a, b, None, None, same, near, conditioned, inliers, turn, shared, jump)


BASE = [pair("a0.jpg", "a1.jpg"), pair("a1.jpg", "a2.jpg"), pair("b0.jpg", "b1.jpg"), pair("a0.jpg", "b0.jpg", 80, same=False)]


def gates(spark, **passed):
    views = ("all_registered_views_measured", "view_precision_p10", "view_recall_p10", "view_iou_p10", "all_selected_rings_measured", "ring_precision_mean", "ring_recall_mean", "ring_iou_mean")
    moves = ("direction_error_p90", "positive_projected_scale_fraction", "orthogonal_residual_p90")
    for kind, names in (("tracks", ()), ("masks", views), ("centers", moves)):
        yield spark.createDataFrame([(passed.get(kind, True), {n: passed.get(n, True) for n in names})], "passed boolean, checks map<string,boolean>")


def judge(spark, audit=BASE, registered=NAMES, expected=NAMES, exclusions=None, independent=True, params=((100.0, 50.0, 50.0),), gate_flags=(), **model):
    images = spark.createDataFrame([(n, n[0], True) for n in NAMES], "name string, ring string, selected boolean")
    names = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    row = {"model_count": 1, "model_sha256": "c" * 64, "expected_model_sha256": None, "snapshot_sha256": "a" * 64, "logical_sha256": "B" * 64, "registered_images": len(registered), "sparse_points": 100, "observations": 1000, "mean_reprojection_error": 3.0} | model
    kinds = "model_count bigint, model_sha256 string, expected_model_sha256 string, snapshot_sha256 string, logical_sha256 string, registered_images bigint, sparse_points bigint, observations bigint, mean_reprojection_error double"
    excuses = None if exclusions is None else spark.createDataFrame(exclusions, "first string, second string, status string, evidence string")
    return integrity.integrity_gate(
        images, names(registered), spark.createDataFrame(audit, AUDIT), spark.createDataFrame([tuple(row.values())], kinds), spark.createDataFrame([(list(p),) for p in params], "params array<double>"), *gates(spark, **dict(gate_flags)),
        exclusions=excuses, expected=None if expected is None else names(expected), independent=independent,
    ).first()


def test_a_sound_model_passes(spark):
    r = judge(spark)
    assert r.passed and len(r.checks) == 19 and all(r.checks.values()) and (r.pairs, r.relevant, r.ring_parts) == (4, 3, 1)


ONE = [("a1.jpg", "a0.jpg", "independently_degenerate", "flat")]
EXCUSED = {"audit_exclusion_justifications_bound", "same_ring_pose_consistency", "shared_track_continuity", "trajectory_continuity"}
STRAY = {"registered_image_set_exact", "single_coherent_model"}
# Faults of checks that have nothing to do with each other share a row.
FAULTS = [
    ({"independent": False, "model_sha256": None, "params": ((0.0, 1.0, 1.0),)}, {"independent_audit_evidence_bound", "stable_model_hash_bound", "camera_intrinsics_integrity"}),
    ({"audit": [], "gate_flags": {"tracks": False}}, {"independent_audit_evidence_bound", "cross_ring_graph_connected", "independent_multiview_track_distribution"}),
    ({"exclusions": [("a0.jpg", "a1.jpg", "because", "flat")], "logical_sha256": "xyz"}, EXCUSED | {"sqlite_snapshot_lineage_bound"}),
    ({"exclusions": [("a0.jpg", "a3.jpg", "independently_erroneous", "flat")], "params": ((1.0, 1.0),)}, EXCUSED | {"camera_intrinsics_integrity"}),
    ({"exclusions": ONE, "audit": [pair("a0.jpg", "a1.jpg", turn=90.0, shared=0, jump=True), *BASE[1:]], "expected_model_sha256": "C" * 64}, set()),
    ({"registered": NAMES[:-1], "params": ((1.0, 1.0, float("nan")), (1.0, 1.0, 1.0))}, STRAY | {"all_selected_rings_registered", "camera_intrinsics_integrity"}),
    ({"registered": [*NAMES, "z.jpg"], "sparse_points": 99, "observations": 999, "mean_reprojection_error": float("inf")}, STRAY | {"sparse_point_health", "observation_health", "mean_reprojection_health"}),
    ({"expected": None, "expected_model_sha256": "d" * 64}, STRAY | {"stable_model_hash_bound"}),
    ({"audit": [*BASE, pair("a2.jpg", "a3.jpg", turn=30.5)], "gate_flags": {"view_iou_p10": False}}, {"same_ring_pose_consistency", "mask_projection_per_view"}),
    ({"audit": [*BASE, pair("a2.jpg", "a3.jpg", turn=None, shared=0)], "gate_flags": {"ring_recall_mean": None}}, {"same_ring_pose_consistency", "mask_projection_per_ring"}),
    ({"audit": [*BASE, pair("a2.jpg", "a3.jpg", shared=19)], "gate_flags": {"centers": False}}, {"shared_track_continuity", "camera_center_translation_scale_consistency"}),
    ({"audit": [*BASE, pair("a2.jpg", "a3.jpg", shared=None), pair("a1.jpg", "a3.jpg", jump=True)], "model_count": 2}, {"shared_track_continuity", "trajectory_continuity", "single_coherent_model"}),
    ({"audit": [*BASE, pair("a2.jpg", "a3.jpg", inliers=99, turn=90.0), pair("a2.jpg", "a3.jpg", near=True, turn=90.0), pair("a2.jpg", "a3.jpg", conditioned=False, turn=120.0, shared=0)]}, set()),
    ({"audit": [*BASE[:3], pair("a0.jpg", "b0.jpg", 49, same=False), pair("a2.jpg", "a3.jpg", conditioned=None, same=None, turn=90.0)], "params": ()}, {"cross_ring_graph_connected", "same_ring_pose_consistency", "camera_intrinsics_integrity"}),
    ({"audit": [*BASE[:3], pair("a0.jpg", "unknown.jpg", 490, same=False)]}, {"cross_ring_graph_connected"}),
]


@pytest.mark.parametrize("changes,failed", FAULTS, ids=range(len(FAULTS)))
def test_each_fault_fails_its_checks(spark, changes, failed):
    r = judge(spark, **changes)
    assert set(r.reasons) == failed and r.passed == (not failed)


SOURCE = "source string, independent_graph boolean, independent_graph_sha256 string, constructed_pairwise_tracks boolean"


def test_track_gate(spark):
    bound = spark.createDataFrame([("verified_graph", True, "a" * 64, False)], SOURCE)
    seen = lambda *tracks: spark.createDataFrame([(t, i) for t, images in enumerate(tracks) for i in images], "track int, image int")
    good = integrity.track_gate(seen(*[(1, 2, 3, 4)] * 9, (7,)), bound).first()
    assert good.passed and good.tracks == 9
    pairs = integrity.track_gate(seen(*[(1, 2)] * 8), spark.createDataFrame([("verified_graph", True, "a" * 64, True)], SOURCE)).first()
    assert set(pairs.reasons) == {"pair_local_track_partition_rejected", "multi_view_track_fraction", "track_length_p50", "track_length_p90"}
    assert integrity.track_gate(seen((1, 2, 2, 3, 4)), bound).first().reasons == ["no_duplicate_image_observations"]
    none = integrity.track_gate(seen(), spark.createDataFrame([(" ", None, None, None)], SOURCE)).first()
    assert set(none.reasons) == {"track_evidence_available", "independent_track_provenance_bound", "multi_view_track_fraction", "track_length_p50", "track_length_p90"}


def test_translation_gate(spark):
    unit = [float(i % 4 == 0) for i in range(9)]
    cameras = spark.createDataFrame([("a", [0.0, 0.0, 0.0], unit), ("b", [1.0, 0.0, 0.0], unit)], "name string, center array<double>, rotation array<double>")
    edges = lambda t: spark.createDataFrame([(1, "a", "b", t, True)], "pair_id int, first string, second string, translation array<double>, conditioned boolean")
    assert integrity.translation_gate(evidence.translation_edges(edges([-1.0, 0.0, 0.0]), cameras), cameras).first().passed
    off = integrity.translation_gate(evidence.translation_edges(edges([1.0, 0.0, 0.0]), cameras), cameras).first()
    assert off.reasons == ["direction_error_p90", "positive_projected_scale_fraction"]
    none = integrity.translation_gate(evidence.translation_edges(edges([0.0, 0.0, 0.0]), cameras), cameras.limit(0)).first()
    assert len(none.reasons) == 5


def test_infinite_jumps_are_outliers(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(k, "r", True, float(k % 3), 1.0) for k in range(9)] + [(9, "r", True, inf, 1.0), (10, "r", True, nan, 1.0), (11, "r", True, None, 99.0), (12, "r", False, inf, 1.0), (13, "q", True, inf, nan), (14, "q", True, inf, 1e9), (15, "r", True, 1.0, inf)]
    got = evidence.trajectory_outliers(spark.createDataFrame(rows, "k int, ring string, same boolean, c double, v double"), "ring", "c", "v", "same")
    # A ring whose jumps are all infinite has no threshold that one could be over.
    assert {r.k for r in got.where("is_outlier").collect()} == {9, 15}


def test_bottom_escape_of_no_points_and_of_odd_heights(spark):
    frame = lambda rows: spark.createDataFrame(rows, "h double, o int")
    r = cloud.bottom_escape(frame([]), "h", "o").first()
    assert (r.low_threshold, r.escape_fraction, r.webbing_fraction) == (0.0, 1.0, 1.0)
    for odd in ((float("nan"), 1), (float("inf"), 1), (0.5, -1)):
        with pytest.raises(Exception, match="heights must be finite"):
            cloud.bottom_escape(frame([(1.0, 0), odd]), "h", "o").collect()


def test_spread_of_rings(spark):
    rows = [("a", True, float(x), float(y), 0.0) for x in (-1, 1) for y in (-1, 1)] + [("a", True, float("nan"), 0.0, 0.0), ("a", False, 9.0, 9.0, 9.0), (None, True, 1.0, 2.0, 3.0)]
    got = {r.ring: r for r in stats.trajectory_spread(spark.createDataFrame(rows, "ring string, registered boolean, x double, y double, z double")).collect()}
    a, u = got["a"], got["unknown"]
    assert (a.registered_count, a.centroid_x, a.centroid_z) == (4, 0.0, 0.0) and (a.radius_median, a.radius_std, a.radius_cv) == pytest.approx((2**0.5, 0, 0), abs=1e-12)
    assert (u.registered_count, u.centroid_y, u.radius_median, u.radius_std, u.radius_cv) == (1, 2.0, 0.0, 0.0, 0.0)
