"""Pair evidence: joins of pairs with their two ends, classification, cycles, robust outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E


def with_ends(pairs: DataFrame, meta: DataFrame, how: str = "inner", first: str = "first", second: str = "second", key: str = "name") -> DataFrame:
    """``pairs`` joined twice with ``meta``: its other columns as first_* and second_*."""
    rest = [c for c in meta.columns if c != key]
    for side, c in (("first", first), ("second", second)):
        role = meta.select(F.col(key).alias(f"__{side}"), *[F.col(x).alias(f"{side}_{x}") for x in rest])
        pairs = pairs.join(role, F.col(c) == F.col(f"__{side}"), how).drop(f"__{side}")
    return pairs


def pair_evidence(pairs: DataFrame, meta: DataFrame, *, window: int = 4, cross_floor: int = 50) -> DataFrame:
    """Pairs (first, second, inliers) with ring and frame of both ends, kept if they are close on one ring or strong across rings."""
    p = with_ends(pairs, meta)
    same = F.col("first_ring") == F.col("second_ring")
    p = p.withColumns({"same_ring": same, "frame_distance": F.when(same, F.abs(F.col("first_frame") - F.col("second_frame")))})
    return p.where((F.col("same_ring") & (F.col("frame_distance") <= window)) | (~F.col("same_ring") & (F.col("inliers") >= cross_floor)))


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that are true, in order; null counts as true (evidence that is missing fails)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in rules.items()]))


def classify_pairs(df: DataFrame, *, least_inliers: int = 100, least_tri: float = 0.05, least_cheirality: float = 0.5, most_homography: float = 0.8, most_rank_ratio: float = 1e-3) -> DataFrame:
    """Eight rules over calibrated evidence (config, rotation, translation, inliers, tri_angle, cheirality, homography, rank_ratio): ``reasons`` and ``well_conditioned``."""
    rules = {
        "calibrated_config_not_2": F.coalesce("config", F.lit(-1)) != 2,
        "calibrated_rotation_not_so3": ~E.is_rotation("rotation"),
        "calibrated_translation_missing_or_degenerate": ~E.is_direction("translation"),
        "calibrated_inliers_below_floor": F.coalesce("inliers", F.lit(0)) < least_inliers,
        "triangulation_angle_weak": ~E.is_finite("tri_angle") | (F.col("tri_angle") <= least_tri),
        "calibrated_cheirality_weak": F.coalesce("cheirality", F.lit(0.0)) < least_cheirality,
        "homography_dominant": F.coalesce("homography", F.lit(0.0)) > most_homography,
        "essential_rank_defective": F.coalesce("rank_ratio", F.lit(float("inf"))) > most_rank_ratio,
    }
    return df.withColumn("reasons", reasons(rules)).withColumn("well_conditioned", F.size("reasons") == 0)


def triangle_cycles(edges: DataFrame, window: int = 4) -> DataFrame:
    """For each edge (pair_id, a, b, frame_a, frame_b, rotation) the median angle of R(m,b) R(a,m) against R(a,b) over the third frames m within ``window`` of both; null without any."""
    both = edges.select("pair_id", "a", "b", "frame_a", "frame_b", "rotation").unionByName(edges.select("pair_id", F.col("b").alias("a"), F.col("a").alias("b"), F.col("frame_b").alias("frame_a"), F.col("frame_a").alias("frame_b"), E.transpose("rotation").alias("rotation")))
    x = both.select(F.col("a").alias("a"), F.col("b").alias("m"), F.col("pair_id").alias("p1"), F.col("rotation").alias("r1"), F.col("frame_b").alias("fm"))
    y = both.select(F.col("a").alias("m"), F.col("b").alias("b"), F.col("pair_id").alias("p2"), F.col("rotation").alias("r2"))
    three = edges.join(x, "a").where((F.col("p1") != F.col("pair_id")) & (F.abs(F.col("fm") - F.col("frame_a")) <= window) & (F.abs(F.col("fm") - F.col("frame_b")) <= window)).join(y, ["m", "b"]).where("p2 <> pair_id and p1 <> p2")
    error = E.geodesic_deg(E.matmul("r2", "r1"), F.col("rotation"))
    found = three.groupBy("pair_id").agg(F.percentile(error, F.lit(0.5)).alias("cycle_error"), F.count("*").alias("cycles"))
    return edges.select("pair_id").join(found, "pair_id", "left")


def median_mad(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``df`` with med and mad (median absolute deviation about it) of ``value`` in each group."""
    w = Window.partitionBy(*by)
    df = df.withColumn("med", F.percentile(value, F.lit(0.5)).over(w))
    return df.withColumn("mad", F.percentile(F.abs(F.col(value) - F.col("med")), F.lit(0.5)).over(w))


def robust_outliers(df: DataFrame, by: list[str], value: str, scale: float = 8.0) -> DataFrame:
    """``df`` with threshold = median + scale * max(MAD, 1e-9) and is_outlier."""
    df = median_mad(df, by, value).withColumn("threshold", F.col("med") + scale * F.greatest("mad", F.lit(1e-9)))
    return df.withColumn("is_outlier", F.coalesce(F.col(value) > F.col("threshold"), F.lit(False)))


def nearest_by_score(pairs: DataFrame, ref: str, candidate: str, score: str, most: float) -> DataFrame:
    """For each reference the candidate of least score, by name of equal ones; none if the score is over ``most``."""
    best = pairs.groupBy(ref).agg(F.min(F.struct(score, candidate)).alias("b"))
    return best.select(ref, F.when(F.col(f"b.{score}") <= most, F.col(f"b.{candidate}")).alias(candidate), F.col(f"b.{score}").alias(score))


def bind_on_key(evidence: DataFrame, *others: DataFrame, key: str = "pair_id") -> DataFrame:
    """``evidence`` left joined with each table on the key; a miss leaves nulls."""
    for o in others:
        evidence = evidence.join(o, key, "left")
    return evidence


def trajectory_outliers(df: DataFrame, ring: str, center: str, ray: str, same_ring: str, scale: float = 8.0) -> DataFrame:
    """``df`` with is_outlier: a centre or ray jump of a same-ring pair over median + scale * max(MAD, 1e-9) of its ring.

    Thresholds of centre jumps are of the finite ones; an infinite jump is over
    any threshold, NaN is over none and a missing jump is none.  Of ray jumps
    all that are there count, so a ring with a NaN among them has no ray
    threshold.  Medians are of a table of each ring's distinct values and
    counts, so that no window holds a ring.
    """
    used = F.coalesce(F.col(same_ring), F.lit(True)) & F.col(ring).isNotNull() & F.col(center).isNotNull()
    thresholds = None
    for jump, counts in ((center, E.is_finite(center)), (ray, F.col(ray).isNotNull())):
        rows = df.select(F.col(ring).alias("r"), F.when(used & counts, F.col(jump).cast("double")).alias("x")).where("x is not null")
        med = rows.groupBy("r").agg(F.percentile("x", F.lit(0.5)).alias("med"), F.max(F.isnan("x")).alias("odd"))
        mad = rows.join(med, "r").groupBy("r", "med", "odd").agg(F.percentile(F.abs(F.col("x") - F.col("med")), F.lit(0.5)).alias("mad"))
        threshold = F.when(~F.col("odd") & E.is_finite("med"), F.col("med") + scale * F.greatest("mad", F.lit(1e-9)))
        found = mad.select(F.col("r").alias(ring), threshold.alias(f"{jump}_threshold"))
        thresholds = found if thresholds is None else thresholds.join(found, ring, "full")
    out = df.join(thresholds, ring, "left")
    over = [F.coalesce(~F.isnan(j) & (F.col(j) > F.col(f"{j}_threshold")), F.lit(False)) for j in (center, ray)]
    return out.withColumn("is_outlier", used & (over[0] | over[1]))


def translation_edges(edges: DataFrame, cameras: DataFrame) -> DataFrame:
    """Edges (pair_id, first, second, translation, conditioned) against camera centres: projected_scale, orthogonal_residual_fraction and direction_error_deg.

    ``cameras``: name, center (3) and rotation (9, from the world).  Edges that
    are badly conditioned, lack a camera or have no direction or distance are
    left out.
    """
    known = cameras.where((F.size("center") == 3) & F.forall("center", E.is_finite) & (F.size("rotation") == 9) & F.forall("rotation", E.is_finite))
    e = with_ends(edges.where("conditioned is distinct from false"), known)
    e = e.where((F.size("translation") == 3) & F.forall("translation", E.is_finite)).withColumn("len", E.norm("translation")).where("len > 1e-9")
    away = F.transform(E.matvec(E.transpose("second_rotation"), F.transform("translation", lambda x: x / F.col("len"))), lambda x: -x)
    e = e.withColumn("away", away).withColumn("delta", F.zip_with("second_center", "first_center", lambda b, a: b - a)).withColumn("distance", E.norm("delta")).where(E.is_finite("distance") & (F.col("distance") > 1e-9))
    e = e.withColumn("away", F.transform("away", lambda x: x / F.greatest(E.norm("away"), F.lit(1e-12)))).withColumn("projected_scale", E.dot("delta", "away"))
    rest = E.norm(F.zip_with("delta", "away", lambda d, a: d - F.col("projected_scale") * a)) / F.col("distance")
    return e.select("pair_id", "first", "second", F.col("distance").alias("center_distance"), "projected_scale", rest.alias("orthogonal_residual_fraction"), E.angle_deg(F.col("projected_scale") / F.col("distance")).alias("direction_error_deg"))


def translation_summary(edges: DataFrame) -> DataFrame:
    """One row of ``translation_edges``: their number, the 90th percentiles of error and residual, and the share of positive scales."""
    p90 = lambda c: F.percentile(c, F.lit(0.9))
    return edges.agg(F.count("*").alias("evaluated_edge_count"), p90("direction_error_deg").alias("direction_error_p90"), p90("orthogonal_residual_fraction").alias("orthogonal_residual_p90"), F.coalesce(F.avg((F.col("projected_scale") > 0).cast("double")), F.lit(0.0)).alias("positive_fraction"))


def shared_tracks(pairs: DataFrame, observations: DataFrame) -> DataFrame:
    """``pairs`` (first, second, ...) with shared_tracks: the tracks that both images of (image, track) observations see; 0 if there is none."""
    seen = observations.select("image", "track").where("track is not null").distinct()
    first, second = (seen.select(F.col("image").alias(c), "track") for c in ("first", "second"))
    ends = pairs.select("first", "second").distinct()
    n = ends.join(first, "first").join(second, ["second", "track"]).groupBy("first", "second").agg(F.count("*").alias("shared_tracks"))
    return pairs.join(n, ["first", "second"], "left").withColumn("shared_tracks", F.coalesce("shared_tracks", F.lit(0)))


def pose_delta(source: DataFrame, result: DataFrame) -> DataFrame:
    """One row over the views of both models (name, rotation, center): their number, the greatest turn and move (infinite without any), and whether the poses are unchanged."""
    both = source.select("name", F.col("rotation").alias("r1"), F.col("center").alias("c1")).join(result.select("name", F.col("rotation").alias("r2"), F.col("center").alias("c2")), "name")
    inf = F.lit(float("inf"))
    most = lambda x: F.coalesce(F.max(x), inf)
    out = both.agg(F.count("*").alias("common_view_count"), most(E.geodesic_deg("r1", "r2")).alias("rotation_geodesic_max_deg"), most(E.norm(F.zip_with("c2", "c1", lambda b, a: b - a))).alias("center_delta_max_m"))
    return out.withColumn("pose_field_unchanged", (F.col("common_view_count") > 0) & (F.col("rotation_geodesic_max_deg") <= 1e-5) & (F.col("center_delta_max_m") <= 1e-9))


def conditioned_records(audit: DataFrame, classification: DataFrame) -> DataFrame:
    """Audit rows of a pair_id with well_conditioned_calibrated of the classification (one row a pair); false if it is missing there."""
    known = classification.select("pair_id", "well_conditioned_calibrated").where("pair_id is not null")
    out = audit.drop("well_conditioned_calibrated").where("pair_id is not null").join(known, "pair_id", "left")
    return out.withColumn("well_conditioned_calibrated", F.coalesce("well_conditioned_calibrated", F.lit(False)))


def image_rings(edges: DataFrame, order: str) -> DataFrame:
    """(name, ring) from both ends of the edges (first, ring, second, second_ring); the last edge by ``order`` decides, and of one edge its second end."""
    end = lambda name, ring, side: F.struct(F.col(name).alias("name"), F.col(ring).alias("ring"), F.struct(F.col(order).alias("at"), F.lit(side).alias("side")).alias("at"))
    ends = edges.select(F.explode(F.array(end("first", "ring", 0), end("second", "second_ring", 1))).alias("e")).select("e.*")
    return ends.groupBy("name").agg(F.max_by("ring", "at").alias("ring"))


def verified_support(geometries: DataFrame, images: DataFrame) -> DataFrame:
    """(first, second, inliers) by names in order, from geometries (pair_id, inliers) and images (image_id, name); pairs of unknown images are left out and missing inliers are 0."""
    pairs = geometries.select(E.decode_pair_id("pair_id").alias("p"), F.coalesce("inliers", F.lit(0)).alias("inliers")).select(F.col("p.first").alias("i"), F.col("p.second").alias("j"), "inliers")
    named = with_ends(pairs, images, first="i", second="j", key="image_id")
    return named.select(F.least("first_name", "second_name").alias("first"), F.greatest("first_name", "second_name").alias("second"), "inliers")


def verified_graph(pairs: DataFrame, support: DataFrame, rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges both ways (ref, source, inliers, same_ring) of pairs (first, second) with verified support, and what is wrong as (problem, first, second).

    ``rings`` (name, ring) lists the registered views.  Wrong are pairs of an
    unknown view or of one view with itself, pairs without inliers, and views
    without an edge.
    """
    low, high = F.least("first", "second"), F.greatest("first", "second")
    p = with_ends(pairs.select("first", "second"), rings.withColumn("known", F.lit(True)), "left")
    known = F.col("first_known").isNotNull() & F.col("second_known").isNotNull() & (F.col("first") != F.col("second"))
    best = support.groupBy(F.col("first").alias("low"), F.col("second").alias("high")).agg(F.max("inliers").alias("inliers"))
    p = p.withColumns({"known": known, "low": low, "high": high}).join(best, ["low", "high"], "left").withColumn("inliers", F.coalesce("inliers", F.lit(0)))
    sound = p.where(F.col("known") & (F.col("inliers") > 0))
    way = lambda a, b: F.struct(F.col(a).alias("ref"), F.col(b).alias("source"))
    edges = sound.select(F.explode(F.array(way("first", "second"), way("second", "first"))).alias("e"), "inliers", F.col("first_ring").eqNullSafe(F.col("second_ring")).alias("same_ring")).select("e.*", "inliers", "same_ring").distinct()
    problem = F.when(~F.col("known"), "unknown_or_self").otherwise("unsupported")
    wrong = p.where(~F.col("known") | (F.col("inliers") <= 0)).select(problem.alias("problem"), "first", "second")
    alone = rings.select(F.col("name").alias("ref")).join(edges.select("ref").distinct(), "ref", "left_anti")
    return edges, wrong.unionByName(alone.select(F.lit("isolated").alias("problem"), F.col("ref").alias("first"), F.lit(None).cast(wrong.schema["second"].dataType).alias("second")))
