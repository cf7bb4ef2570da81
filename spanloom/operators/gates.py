"""Gates: named checks over a row of evidence; whatever is missing fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import is_finite, is_sha256


def gate(df: DataFrame, checks: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` as (keep..., passed, checks, reasons): a null check is false, reasons are the failed names in order."""
    done = {k: F.coalesce(c.cast("boolean"), F.lit(False)) for k, c in checks.items()}
    passed = F.lit(True)
    for c in done.values():
        passed = passed & c
    table = F.map_from_arrays(F.array(*[F.lit(k) for k in done]), F.array(*done.values()))
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(k)) for k, c in done.items()]))
    return df.select(*(keep or []), passed.alias("passed"), table.alias("checks"), failed.alias("reasons"))


def measured(x: str) -> Column:
    """A finite fraction of 0 to 1."""
    return is_finite(x) & F.col(x).between(0.0, 1.0)


def sparse_gate(df: DataFrame) -> DataFrame:
    """min_registered, cross_ring_connections, board_fraction, cloth_fraction, trajectory_status, visual_status."""
    return gate(df, {
        "useful_ring_coverage": F.col("min_registered") > 0,
        "cross_ring_connectivity": F.col("cross_ring_connections") > 0,
        "coherent_trajectories": F.col("trajectory_status") == "passed",
        "board_measurement_available": measured("board_fraction"),
        "board_not_dominant": measured("board_fraction") & (F.col("board_fraction") < 0.20),
        "cloth_measurement_available": measured("cloth_fraction"),
        "cloth_not_dominant": measured("cloth_fraction") & (F.col("cloth_fraction") < 0.10),
        "visual_review": F.col("visual_status") == "passed",
    })


def component_gate(df: DataFrame, dominant: float = 0.95, second: float = 0.02) -> DataFrame:
    """fractions (array): the greatest and the next one, in any order; no evidence fails."""
    f = F.sort_array(F.filter("fractions", is_finite), asc=False)
    rows = df.withColumns({"__n": F.size(f), "__first": F.coalesce(F.get(f, F.lit(0)), F.lit(0.0)), "__second": F.coalesce(F.get(f, F.lit(1)), F.lit(0.0))})
    return gate(rows, {"component_evidence_available": F.col("__n") > 0, "dominant_face_fraction": F.col("__first") >= dominant, "second_largest_face_fraction": F.col("__second") <= second})


#: Contamination fractions with their limits, findings with what they must be, and the views and regions of a review.
CONTAMINATION_LIMITS = {"board_point_fraction": 0.20, "pedestal_board_webbing_point_fraction": 0.05, "cloth_or_background_point_fraction": 0.10}
CONTAMINATION_FINDINGS = {"board_slab_detected": False, "pedestal_board_webbing_detected": False, "cloth_or_background_structure_detected": False, "vessel_identity_confirmed": True}
VIEWS = ("front", "quarter", "side", "top_oblique")
REGIONS = ("bowl_and_interior", "globe_or_shoulder", "neck_lid_or_finial", "pedestal_and_base")


def _value(column: str, key: str) -> Column:
    return F.try_element_at(column, F.lit(key))


def _fraction(key: str) -> Column:
    """A contamination fraction, null unless it is finite and of 0 to 1."""
    x = _value("contamination_metrics", key)
    return F.when(is_finite(x) & x.between(0.0, 1.0), x)


def _same(column: str, key: str) -> Column:
    return is_finite(column) & (F.col(column).cast("double") == _fraction(key))


def _exact(column: str, keys) -> Column:
    """A map with these keys and no others."""
    return (F.size(column) == len(keys)) & (F.size(F.array_except(F.map_keys(column), F.array(*[F.lit(k) for k in keys]))) == 0)


def _all(*checks: Column) -> Column:
    out = F.lit(True)
    for c in checks:
        out = out & F.coalesce(c, F.lit(False))
    return out


def _contamination_checks(df: DataFrame) -> dict[str, Column]:
    board, webbing, cloth = CONTAMINATION_LIMITS
    finding = {k: _value("contamination_findings", k) for k in CONTAMINATION_FINDINGS}
    return {
        "contamination_metrics_explicit": _all(*[_fraction(k).isNotNull() for k in CONTAMINATION_LIMITS]),
        "board_not_dominant": _fraction(board) < CONTAMINATION_LIMITS[board],
        "pedestal_board_webbing_not_dominant": _fraction(webbing) < CONTAMINATION_LIMITS[webbing],
        "cloth_or_background_not_dominant": _fraction(cloth) < CONTAMINATION_LIMITS[cloth],
        "board_fraction_inputs_consistent": _same("board_point_fraction", board) if "board_point_fraction" in df.columns else F.lit(True),
        "cloth_fraction_inputs_consistent": _same("cloth_point_fraction", cloth) if "cloth_point_fraction" in df.columns else F.lit(True),
        "board_slab_absent": ~finding["board_slab_detected"],
        "pedestal_board_webbing_absent": ~finding["pedestal_board_webbing_detected"],
        "cloth_or_background_absent": ~finding["cloth_or_background_structure_detected"],
        "vessel_identity_confirmed": finding["vessel_identity_confirmed"],
        "contamination_findings_explicit": _all(*[x.isNotNull() for x in finding.values()]),
    }


def contamination_gate(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """contamination_metrics (map of fractions) and contamination_findings (map of booleans); the columns board_point_fraction and cloth_point_fraction, if there are any, must equal the metrics."""
    return gate(df, _contamination_checks(df), keep)


def transition_gate(df: DataFrame) -> DataFrame:
    """measured_pairs, selected_pairs, mean_coverage, mean_consistency of a ring transition: status, diagnostic_status and acceptance_basis.

    A transition passes if all its selected pairs were measured with an overlap
    of 1 % or more.  Consistency is a diagnostic only and never decides.
    """
    complete = _all(F.col("selected_pairs") > 0, F.col("measured_pairs") == F.col("selected_pairs"), is_finite("mean_coverage") & F.col("mean_coverage").between(0.01, 1.0))
    steady = complete & F.coalesce(is_finite("mean_consistency") & (F.col("mean_consistency") >= 0.5), F.lit(False))
    return df.select(
        *[c for c in df.columns if c not in ("measured_pairs", "selected_pairs", "mean_coverage", "mean_consistency")],
        F.when(complete, "passed").otherwise("failed").alias("status"), F.when(steady, "passed").otherwise("below_threshold").alias("diagnostic_status"),
        F.when(complete, "all_selected_source_z_pairs_measured_with_masked_overlap").otherwise("incomplete_or_insufficient_source_z_measurements").alias("acceptance_basis"),
    )


def _bounds_checks() -> dict[str, Column]:
    checks = {}
    for a in "xyz":
        low, high, ref_low, ref_high = (F.col(f"{k}{a}_{e}") for k in ("", "ref_") for e in ("lo", "hi"))
        span = ref_high - ref_low
        checks[f"{a}_finite"] = is_finite(low) & is_finite(high)
        checks[f"{a}_reference_span"] = is_finite(span) & (span > 0)
        checks[f"{a}_not_empty"] = high > low
        checks[f"{a}_within_span"] = (low >= ref_low - span) & (high <= ref_high + span)
    return checks | {"coverage": F.coalesce("coverage", F.lit(1.0)) >= 0.99}


def bounds_gate(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Bounds (lo, hi of each axis), finite and not empty, within a span of the reference's, which isn't empty either, and coverage .99 or more (1 if it is missing)."""
    return gate(df, _bounds_checks(), keep)


def lineage_gate(df: DataFrame, hashes: list[str], expected: str | None = None) -> DataFrame:
    """Every named hash is a SHA-256, and the first equals ``expected`` (a column) if one is given."""
    checks = {f"{h}_valid": is_sha256(h) for h in hashes}
    if expected:
        checks["bound_to_expected"] = is_sha256(hashes[0]) & (F.lower(hashes[0]) == F.lower(expected))
    return gate(df, checks)


def _stripped(x: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(x), F.lit("")), r"^\s+|\s+$", "")


def _review_checks() -> dict[str, Column]:
    views = [_value("previews", v) for v in VIEWS]
    digest = [F.lower(F.trim(v["sha256"])) for v in views]
    there = _all(_exact("previews", VIEWS), *[F.length(v["path"]) > 0 for v in views])
    hashed = _all(there, *[is_sha256(v["sha256"]) & (F.lower(v["actual_sha256"]) == d) for v, d in zip(views, digest, strict=True)])
    distinct = _all(hashed, *[F.size(F.array_distinct(F.array(*x))) == len(VIEWS) for x in ([v["path"] for v in views], digest)])
    reviewer, approver = _stripped("reviewer"), _stripped("approver")
    return {
        "four_semantic_views": hashed,
        "preview_hashes_verified": hashed,
        "preview_views_distinct": distinct,
        "required_regions_confirmed": _all(_exact("regions", REGIONS), *[_value("regions", r) for r in REGIONS]),
        "contamination_findings_explicit": _all(_exact("review_findings", CONTAMINATION_FINDINGS), *[_value("review_findings", k) == want for k, want in CONTAMINATION_FINDINGS.items()]),
        "reviewer_identified": reviewer != "",
        "approval_independent": (reviewer != "") & (approver != "") & (F.lower(reviewer) != F.lower(approver)),
        "review_status_passed": _stripped("review_status") == "passed",
        "approval_status_passed": _stripped("approval_status") == "passed",
    }


def review_gate(df: DataFrame) -> DataFrame:
    """previews (map of views to path, sha256 and actual_sha256, the digest of the file as read), regions and review_findings (maps of booleans), reviewer, approver, review_status, approval_status; a row of nulls is a missing review."""
    return gate(df, _review_checks())


def dense_gate(df: DataFrame) -> DataFrame:
    """finite_xyz_fraction, point_count, rank, smoke_status, depth_normal_count and visual_status, with the columns of the contamination and review gates."""
    return gate(df, {
        "finite_xyz": F.col("finite_xyz_fraction") == 1.0,
        "nonzero_points": F.col("point_count") > 0,
        "rank_3": F.col("rank") == 3,
        "cuda_smoke_passed": (F.col("smoke_status") == "passed") & (F.col("depth_normal_count") > 0),
        "visual_review": (F.col("visual_status") == "passed") & _all(*_review_checks().values()),
    } | _contamination_checks(df))


def raw_visual_gate(df: DataFrame) -> DataFrame:
    """point_count, vertex_count, face_count, mesh_finite_xyz_fraction, mesh_rank, visual_status, required_regions (map of booleans), raw_board_fraction and raw_cloth_fraction, with the columns of the contamination and review gates."""
    board, _, cloth = CONTAMINATION_LIMITS
    values, review = F.map_values("required_regions"), _all(*_review_checks().values())
    return gate(df, {
        "fused_nonzero": F.col("point_count") > 0,
        "mesh_vertices": F.col("vertex_count") > 0,
        "mesh_faces": F.col("face_count") > 0,
        "mesh_finite": F.col("mesh_finite_xyz_fraction") == 1.0,
        "mesh_rank_3": F.col("mesh_rank") == 3,
        "required_regions": (F.size("required_regions") > 0) & F.forall(values, lambda v: F.coalesce(v, F.lit(False))),
        "raw_board_fraction_input_matches_measurement": _same("raw_board_fraction", board),
        "raw_cloth_fraction_input_matches_measurement": _same("raw_cloth_fraction", cloth),
        # A review that passed has all its regions true.
        "review_regions_match": review & _all(_exact("required_regions", REGIONS), *[_value("required_regions", r) for r in REGIONS]),
        "visual_review": (F.col("visual_status") == "passed") & review,
    } | _contamination_checks(df))


def role_gate(counts: DataFrame, contract: dict[str, int]) -> DataFrame:
    """(role, n) against the contracted numbers; a role that is missing has 0."""
    row = counts.agg(*[F.coalesce(F.max(F.when(F.col("role") == r, F.col("n"))), F.lit(0)).alias(f"__{i}") for i, r in enumerate(contract)])
    return gate(row, {r: F.col(f"__{i}") == n for i, (r, n) in enumerate(contract.items())})


def _solid_checks() -> dict[str, Column]:
    return {"finite": F.col("finite_xyz_fraction") == 1.0, "spatial_rank_3": F.col("rank") == 3, "plausible_bounds": _all(*_bounds_checks().values()), "visual": F.col("visual_status") == "passed"}


def cloud_gate(df: DataFrame, keep: list[str] | None = None, *, sparse_points: int = 6099, target: int = 60990) -> DataFrame:
    """point_count, has_color, finite_xyz_fraction, rank, visual_status and the columns of ``bounds_gate``; quality_target_met is told but doesn't decide."""
    met = F.coalesce(F.col("point_count") >= target, F.lit(False))
    more = {"more_than_sparse": F.col("point_count") > sparse_points, "reference_coverage": F.coalesce("coverage", F.lit(1.0)) >= 0.99, "color": F.col("has_color")}
    return gate(df.withColumn("quality_target_met", met), more | _solid_checks(), [*(keep or []), "quality_target_met"])


def mesh_gate(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """vertex_count, face_count, dominant_fraction, finite_xyz_fraction, rank, visual_status and the columns of ``bounds_gate``."""
    return gate(df, {"vertices": F.col("vertex_count") > 0, "faces": F.col("face_count") > 0, "dominant_component": F.col("dominant_fraction") >= 0.3} | _solid_checks(), keep)


def integrated_success(stages: DataFrame, by: list[str], first: int = 14, last: int = 17) -> DataFrame:
    """Groups of (stage, passed): whether each stage from ``first`` to ``last`` is there and passed, in all of its rows."""
    within = F.col("stage").between(first, last)
    there, sound = F.count_distinct(F.when(within, F.col("stage"))), F.bool_and(F.when(within, F.coalesce("passed", F.lit(False))))
    return stages.groupBy(*by).agg(((there == last - first + 1) & F.coalesce(sound, F.lit(False))).alias("passed"))


def _has(column: str, *names: str) -> Column:
    return _all(*[F.array_contains(column, n) for n in names])


def scene_gate(df: DataFrame, keep: list[str] | None = None, *, collections: list[str], raw: str, clean: str, final: str, material: str) -> DataFrame:
    """objects, collections and materials (arrays of names), final_vertex_count, final_face_count, sane_transforms of a scene."""
    return gate(df, {
        "collections": _has("collections", *collections),
        "raw_preserved": _has("objects", raw),
        "clean_high_present": _has("objects", clean),
        "final_present": _has("objects", final),
        "brass_material": _has("materials", material),
        "nonzero_mesh": (F.col("final_vertex_count") > 0) & (F.col("final_face_count") > 0),
        "sane_transforms": F.col("sane_transforms"),
    }, keep)


def export_gate(df: DataFrame, keep: list[str] | None = None, *, material: str) -> DataFrame:
    """vertex_count, face_count, materials (array), textures_resolve, sane_bounds, normals_ok and only_final_exported of an exported file."""
    flags = ("textures_resolve", "sane_bounds", "normals_ok", "only_final_exported")
    return gate(df, {"mesh_nonzero": (F.col("vertex_count") > 0) & (F.col("face_count") > 0), "material_present": _has("materials", material)} | {f: F.col(f) for f in flags}, keep)


def process_gate(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """residuals, termination, promotion_allowed and eligible of a candidate's solver; the reasons say what is lacking."""
    end = F.upper(F.coalesce("termination", F.lit("")))
    return gate(df, {
        "bundle_adjustment_not_successfully_executed": (F.col("residuals") > 0) & ~end.contains("FAILURE") & ~end.contains("NO_CONVERGENCE"),
        "promotion_not_allowed": F.col("promotion_allowed"),
        "full_sparse_candidate_not_eligible": F.col("eligible"),
    }, keep)


#: Terminations of a solver that count as success.
CONVERGED = ("SUCCESS", "CONVERGENCE", "USER_SUCCESS")


def adjustment_gate(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """configured, residuals and termination (a name, qualified or not) of a bundle adjustment."""
    end = F.upper(F.element_at(F.split("termination", r"\."), -1))
    return gate(df, {"residuals_configured": F.col("configured") > 0, "residuals_reported": F.col("residuals") > 0, "converged": end.isin(*CONVERGED)}, keep)


def completion_class(df: DataFrame) -> DataFrame:
    """``df`` (passed, reasons, ...) labelled as strict or best-defensible evidence; work may go on in both cases, and a failure keeps its reasons."""
    strict = F.coalesce(F.col("passed"), F.lit(False))
    return df.select(
        *[c for c in df.columns if c not in ("passed", "reasons")], strict.alias("strict_gate_passed"), (~strict).alias("best_defensible"), F.lit(True).alias("continuation_allowed"),
        F.when(strict, "dense_evidence_passed").otherwise("dense_best_defensible").alias("status"), F.coalesce("reasons", F.array().cast("array<string>")).alias("strict_failure_reasons"),
    )


def detached_components(df: DataFrame, keep: list[str], default: float = 0.02) -> DataFrame:
    """face_counts (array, greatest first), second_fraction and second_max (``default`` if it is missing): a proxy that never passes, as sizes prove nothing of what a component is."""
    fraction, limit = F.coalesce("second_fraction", F.lit(0.0)), F.coalesce("second_max", F.lit(default))
    return df.select(*keep, F.lit(False).alias("passed"), F.coalesce(F.get("face_counts", F.lit(1)), F.lit(0)).alias("second_faces"), fraction.alias("second_fraction"), limit.alias("threshold"), (fraction <= limit).alias("fraction_proxy_passed"))


def upper_recovery(df: DataFrame, keep: list[str]) -> DataFrame:
    """baseline_ratio, candidate_ratio (infinite unless finite) and candidate_resolved: a candidate is promoted if it is resolved and narrower."""
    ratio = lambda c: F.when(is_finite(c), F.col(c).cast("double")).otherwise(F.lit(float("inf")))
    better = ratio("candidate_ratio") < ratio("baseline_ratio")
    promote = better & F.coalesce("candidate_resolved", F.lit(False))
    return df.select(*keep, promote.alias("promote"), F.when(promote, "upper_recovery_improved").otherwise("recovery_exhausted_unresolved").alias("status"), better.alias("ratio_improved"))


#: Checks that a model's provenance and its set of images need, and the number of images.
PROVENANCE_CHECKS = ("stable_model_hash_bound", "sqlite_snapshot_lineage_bound", "cross_ring_graph_connected")
EXACT_CHECKS = ("registered_image_set_exact", "single_coherent_model")
EXACT_IMAGES = 372


def defensible_candidate(df: DataFrame, keep: list[str], images: int = EXACT_IMAGES) -> DataFrame:
    """registered_images, model_count, gate_checks (map of booleans), rotation_failures, trajectory_failures, independent_graph, constructed_pairwise_tracks (true if missing) and process_valid (true if the candidate has no solver).

    The candidate is defensible if its model is exact, its poses and
    trajectories are clean, its provenance is clean and its solver is valid;
    the strict gate's failed checks are told by name, in order.
    """
    named = lambda names: _all(*[_value("gate_checks", k) for k in names])
    exact = _all(F.col("registered_images") == images, F.col("model_count") == 1, named(EXACT_CHECKS))
    clean = (F.coalesce("rotation_failures", F.lit(0)) == 0) & (F.coalesce("trajectory_failures", F.lit(0)) == 0)
    sound = _all(F.col("independent_graph"), ~F.col("constructed_pairwise_tracks"), named(PROVENANCE_CHECKS))
    failed = F.array_sort(F.map_keys(F.map_filter("gate_checks", lambda _, v: ~F.coalesce(v, F.lit(False)))))
    process = F.coalesce("process_valid", F.lit(True))
    return df.select(
        *keep, exact.alias("exact_model"), clean.alias("pose_and_trajectory_clean"), sound.alias("provenance_clean"), process.alias("process_valid"),
        F.coalesce(failed, F.array().cast("array<string>")).alias("strict_gate_failures"), (exact & clean & sound & process).alias("defensible"),
    )
