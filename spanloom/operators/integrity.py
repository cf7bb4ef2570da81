"""Acceptance of a sparse model: its evidence tables, and the gate of nineteen checks over them.

Each table of evidence is brought down to one row of counts, and the rows are
joined; nothing is collected.  What is missing fails.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..scratch import materialize, small_side
from .gates import gate
from .graph import ring_components
from .stats import quantiles

#: The limits of a defensible sparse model.
LIMITS = {
    "verified_inliers": 100, "shared_tracks": 20, "rotation_disagreement_deg": 30.0, "cross_ring_inliers": 50, "ring_registration_fraction": 0.95,
    "mean_reprojection_error": 3.0, "sparse_points": 100, "observations": 1000, "multi_view_track_fraction": 0.50, "track_length_p50": 3.0, "track_length_p90": 4.0,
    "direction_error_p90": 35.0, "positive_fraction": 0.95, "orthogonal_residual_p90": 0.60,
}
#: Why a pair may be left out of the audit.
JUSTIFIED = ("independently_degenerate", "independently_erroneous")


def track_gate(observations: DataFrame, provenance: DataFrame) -> DataFrame:
    """One row (tracks, passed, checks, reasons): lengths of the tracks of two or more observations (track, image), and where they come from.

    ``provenance`` is one row: source, independent_graph, independent_graph_sha256
    and constructed_pairwise_tracks.
    """
    t = observations.groupBy("track").agg(F.count("*").alias("len"), F.count_distinct("image").alias("images"))
    long = F.when(F.col("len") >= 2, F.col("len"))
    one = t.agg(F.count(long).alias("tracks"), F.count_if(F.col("images") < F.col("len")).alias("repeated"), F.avg((long >= 3).cast("double")).alias("three"), F.percentile(long, F.array(F.lit(0.5), F.lit(0.9))).alias("q"))
    met = _side_by_side(one, provenance)
    bound = (F.trim("source") != "") & E.is_sha256("independent_graph_sha256") & F.col("independent_graph")
    return gate(met, {
        "track_evidence_available": F.col("tracks") > 0,
        "no_duplicate_image_observations": F.col("repeated") == 0,
        "independent_track_provenance_bound": bound,
        "pair_local_track_partition_rejected": ~F.coalesce("constructed_pairwise_tracks", F.lit(False)),
        "multi_view_track_fraction": F.col("three") >= LIMITS["multi_view_track_fraction"],
        "track_length_p50": F.get("q", F.lit(0)) >= LIMITS["track_length_p50"],
        "track_length_p90": F.get("q", F.lit(1)) >= LIMITS["track_length_p90"],
    }, ["tracks"])


def translation_gate(edges: DataFrame, centers: DataFrame) -> DataFrame:
    """One row (edges, passed, checks, reasons) of ``evidence.translation_edges`` and the camera centres (center) they were made with."""
    p90 = lambda c: quantiles(c, 0.9)[0]
    one = edges.agg(F.count("*").alias("edges"), p90("direction_error_deg").alias("direction"), p90("orthogonal_residual_fraction").alias("residual"), F.avg((F.col("projected_scale") > 0).cast("double")).alias("positive"))
    known = centers.agg(F.count_if((F.size("center") == 3) & F.forall("center", E.is_finite)).alias("centers"))
    return gate(_side_by_side(one, known), {
        "translation_evidence_available": F.col("edges") > 0,
        "finite_camera_centers": F.col("centers") > 0,
        "direction_error_p90": F.col("direction") <= LIMITS["direction_error_p90"],
        "positive_projected_scale_fraction": F.col("positive") >= LIMITS["positive_fraction"],
        "orthogonal_residual_p90": F.col("residual") <= LIMITS["orthogonal_residual_p90"],
    }, ["edges"])


def _side_by_side(*rows: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    return reduce(lambda a, b: a.join(F.broadcast(b), "one"), [r.withColumn("one", F.lit(1)) for r in rows]).drop("one")


def _pair(first: Column, second: Column) -> tuple[Column, Column]:
    return F.least(first, second), F.greatest(first, second)


def audit_flags(audit: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """``audit`` with excluded, relevant, and the failures of a relevant pair: disagrees, unshared and jumps.

    A pair is relevant if it is of one ring, no near duplicate, well
    conditioned, strong enough and not excluded; a flag that is missing counts
    as of one ring and well conditioned.  A rotation that is missing disagrees.
    """
    if exclusions is None:
        met = audit.withColumn("excluded", F.lit(False))
    else:
        a, b = _pair(F.col("first"), F.col("second"))
        gone = exclusions.select(*[c.alias(k) for k, c in zip(("xa", "xb"), _pair(F.col("first"), F.col("second")), strict=True)], F.lit(True).alias("excluded")).distinct()
        met = audit.join(small_side(gone), (a == F.col("xa")) & (b == F.col("xb")), "left").drop("xa", "xb").withColumn("excluded", F.coalesce("excluded", F.lit(False)))
    yes, no = (lambda c: F.coalesce(c, F.lit(True))), (lambda c: F.coalesce(c, F.lit(False)))
    relevant = yes(F.col("same_ring")) & ~no(F.col("near_duplicate")) & yes(F.col("calibrated_conditioned")) & no(F.col("verified_inliers") >= LIMITS["verified_inliers"]) & ~F.col("excluded")
    turn = F.col("rotation_disagreement_deg")
    return met.withColumn("relevant", relevant).withColumns({
        "disagrees": F.col("relevant") & yes(turn > LIMITS["rotation_disagreement_deg"]),
        "unshared": F.col("relevant") & turn.isNotNull() & (F.coalesce("shared_final_tracks", F.lit(0)) < LIMITS["shared_tracks"]),
        "jumps": F.col("relevant") & no(F.col("trajectory_outlier")),
    })


def cross_ring_edges(audit: DataFrame, images: DataFrame, registered: DataFrame) -> DataFrame:
    """(ring_a, ring_b, inliers) of the audited pairs of registered images in two selected rings.

    An image's ring is that of ``images``, else the one the pair carries.
    """
    own = images.groupBy("name").agg(F.min("ring").alias("of"))
    known = registered.select("name").distinct().join(own, "name", "left")
    met = audit.select("first", "second", "ring", "second_ring", F.col("verified_inliers").alias("inliers"))
    for side, ring in (("first", "ring"), ("second", "second_ring")):
        met = met.join(known.select(F.col("name").alias(side), F.col("of").alias(f"{side}_of")), side).withColumn(f"{side}_of", F.coalesce(f"{side}_of", ring))
    rings = small_side(images.where("selected").select(F.col("ring").alias("r")).distinct())
    edges = met.where("first_of <> second_of").select(F.least("first_of", "second_of").alias("ring_a"), F.greatest("first_of", "second_of").alias("ring_b"), "inliers")
    return edges.join(rings, F.col("ring_a") == F.col("r"), "left_semi").join(rings, F.col("ring_b") == F.col("r"), "left_semi")


def integrity_gate(images: DataFrame, registered: DataFrame, audit: DataFrame, model: DataFrame, cameras: DataFrame, tracks: DataFrame, masks: DataFrame, centers: DataFrame, *, exclusions: DataFrame | None = None, expected: DataFrame | None = None, independent: bool = True) -> DataFrame:
    """One row: the counts of failures, passed, checks (19) and reasons.

    ``images`` (name, ring, selected); ``registered`` and ``expected`` (name);
    ``audit`` (first, second, ring, second_ring, same_ring, near_duplicate,
    calibrated_conditioned, verified_inliers, rotation_disagreement_deg,
    shared_final_tracks, trajectory_outlier), taken before any pruning if
    ``independent``; ``exclusions`` (first, second, status, evidence);
    ``model``, one row: model_count, model_sha256, expected_model_sha256,
    snapshot_sha256, logical_sha256, registered_images, sparse_points,
    observations, mean_reprojection_error; ``cameras`` (params); ``tracks``,
    ``masks`` and ``centers``: the rows of their gates.
    """
    flags = materialize(audit_flags(audit, exclusions), "audit")
    count = lambda c: F.count_if(F.col(c)).alias(c)
    audited = flags.agg(F.count("*").alias("pairs"), *[count(c) for c in ("excluded", "relevant", "disagrees", "unshared", "jumps")])

    names = registered.select("name").distinct()
    chosen = images.where("selected").groupBy("ring").agg(F.count("*").alias("selected"))
    present = names.join(images.select("name", "ring").distinct(), "name").groupBy("ring").agg(F.count("*").alias("registered"))
    share = chosen.join(present, "ring", "left").select((F.coalesce("registered", F.lit(0)) / F.col("selected")).alias("share"))
    rings = share.agg(F.count("*").alias("rings"), F.min("share").alias("least_share"))
    if expected is None:
        exact = audited.select(F.lit(None).cast("bigint").alias("expected"), F.lit(None).cast("bigint").alias("strays"))
    else:
        both = names.withColumn("r", F.lit(1)).join(expected.select("name").distinct().withColumn("e", F.lit(1)), "name", "full")
        exact = both.agg(F.count("e").alias("expected"), F.count_if(F.col("r").isNull() | F.col("e").isNull()).alias("strays"))

    edges = materialize(cross_ring_edges(audit, images, registered), "ring_edges")
    parts = ring_components(images.where("selected").select("ring").distinct(), edges, LIMITS["cross_ring_inliers"])
    graph = parts.agg(F.count_distinct("component").alias("ring_parts"))

    if exclusions is None:
        excuses = audited.select(F.lit(True).alias("justified"))
    else:
        key = _pair(F.col("first"), F.col("second"))
        known = audit.select(*[c.alias(k) for k, c in zip(("a", "b"), key, strict=True)]).distinct().withColumn("known", F.lit(True))
        met = exclusions.select(*[c.alias(k) for k, c in zip(("a", "b"), key, strict=True)], "status", "evidence").join(known, ["a", "b"], "left")
        fine = F.coalesce(F.col("status").isin(*JUSTIFIED) & (F.trim("evidence") != "") & F.col("known"), F.lit(False))
        excuses = met.agg(F.coalesce(F.min(fine), F.lit(True)).alias("justified"))

    sound = F.coalesce((F.size("params") >= 3) & F.forall("params", E.is_finite) & (F.get("params", F.lit(0)) > 0), F.lit(False))
    lenses = cameras.agg(F.coalesce(F.min(sound), F.lit(False)).alias("sound"))
    given = [t.select(F.col("passed").alias(f"{k}_passed"), F.col("checks").alias(f"{k}_checks")) for k, t in (("tracks", tracks), ("masks", masks), ("centers", centers))]
    row = _side_by_side(audited, rings, exact, graph, excuses, lenses, model, *given)
    of = lambda k, *names: reduce(lambda a, b: a & b, [F.try_element_at(f"{k}_checks", F.lit(n)) for n in names])
    justified = F.col("justified")
    one_set = F.col("strays") == 0
    hash_fits = F.col("expected_model_sha256").isNull() | (F.col("model_sha256") == F.lower("expected_model_sha256"))
    return gate(row, {
        "independent_audit_evidence_bound": F.lit(independent) & (F.col("pairs") > 0),
        "audit_exclusion_justifications_bound": justified,
        "all_selected_rings_registered": (F.col("rings") > 0) & (F.col("least_share") >= LIMITS["ring_registration_fraction"]),
        "registered_image_set_exact": one_set,
        "same_ring_pose_consistency": (F.col("disagrees") == 0) & justified,
        "shared_track_continuity": (F.col("unshared") == 0) & justified,
        "trajectory_continuity": (F.col("jumps") == 0) & justified,
        "cross_ring_graph_connected": F.col("ring_parts") == 1,
        "single_coherent_model": (F.col("model_count") == 1) & (F.col("expected") > 0) & one_set & (F.col("registered_images") == F.col("expected")),
        "stable_model_hash_bound": (F.col("model_sha256") != "") & hash_fits,
        "sqlite_snapshot_lineage_bound": E.is_sha256("snapshot_sha256") & E.is_sha256("logical_sha256"),
        "camera_intrinsics_integrity": F.col("sound"),
        "sparse_point_health": F.col("sparse_points") >= LIMITS["sparse_points"],
        "observation_health": F.col("observations") >= LIMITS["observations"],
        "mean_reprojection_health": E.is_finite("mean_reprojection_error") & (F.col("mean_reprojection_error") <= LIMITS["mean_reprojection_error"]),
        "independent_multiview_track_distribution": F.col("tracks_passed"),
        "mask_projection_per_view": of("masks", "all_registered_views_measured", "view_precision_p10", "view_recall_p10", "view_iou_p10"),
        "mask_projection_per_ring": of("masks", "all_selected_rings_measured", "ring_precision_mean", "ring_recall_mean", "ring_iou_mean"),
        "camera_center_translation_scale_consistency": F.col("centers_passed") & of("centers", "direction_error_p90", "positive_projected_scale_fraction", "orthogonal_residual_p90"),
    }, ["pairs", "excluded", "relevant", "disagrees", "unshared", "jumps", "ring_parts"])
