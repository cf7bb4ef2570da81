"""Summary statistics with the empty-group and interpolation rules of evidence reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, small_side


def quantiles(value: str, *points: float) -> Column:
    """Linearly interpolated quantiles, as an array."""
    return F.percentile(value, F.array(*[F.lit(p) for p in points]))


def exact_quantiles(df: DataFrame, points: dict[str, list[float]], *, accuracy: int = 10_000, most: int = 100_000) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of whole columns, nulls apart; null for a column without values.

    An approximate quantile on either side of each rank bounds it, counts prove
    that it does (else the bounds are set wider), and what lies within, at most
    ``most`` distinct values, is read in order.  No task sees the whole column.
    """
    df = df.select(*[F.col(c).cast("double").alias(c) for c in points])
    n = df.agg(*[F.count(c).alias(c) for c in points]).first()
    open_ = [{"c": c, "i": i, "at": (n[c] - 1) * p, "low": None, "high": None, "below": 0, "m": n[c], "eps": 2.0 / accuracy, "done": False} for c, ps in points.items() for i, p in enumerate(ps) if n[c]]
    found: dict[str, list[float | None]] = {c: [None] * len(ps) for c, ps in points.items()}

    def within(t: dict, low=None, high=None) -> Column:
        low, high = t["low"] if low is None else low, t["high"] if high is None else high
        keep = F.col(t["c"]).isNotNull()
        keep = keep if low is None else keep & (F.col(t["c"]) >= F.lit(low))
        return keep if high is None else keep & (F.col(t["c"]) <= F.lit(high))

    while large := [t for t in open_ if t["m"] > most and not t["done"]]:
        part = [[min(1.0, max(0.0, (k - t["below"]) / t["m"] + side * t["eps"])) for k, side in ((math.floor(t["at"]), -1), (math.ceil(t["at"]), 1))] for t in large]
        near = df.agg(*[F.percentile_approx(F.when(within(t), F.col(t["c"])), F.array(*[F.lit(x) for x in q]), accuracy).alias(f"q{i}") for i, (t, q) in enumerate(zip(large, part, strict=True))]).first()
        bounds = [(t["low"] if q[0] <= 0 else near[i][0], t["high"] if q[1] >= 1 else near[i][1]) for i, (t, q) in enumerate(zip(large, part, strict=True))]
        count = df.agg(*[c for i, (t, (low, high)) in enumerate(zip(large, bounds, strict=True)) for c in (F.count_if(F.lit(False) if low is None else F.col(t["c"]) < F.lit(low)).alias(f"b{i}"), F.count_if(within(t, low, high)).alias(f"m{i}"))]).first()
        for i, (t, (low, high)) in enumerate(zip(large, bounds, strict=True)):
            below, m = count[f"b{i}"], count[f"m{i}"]
            if below <= math.floor(t["at"]) and math.ceil(t["at"]) < below + m:
                # Bounds that don't narrow hold repeats of few values.
                t.update(low=low, high=high, below=below, m=m, done=m == t["m"] or low == high)
            else:
                t["eps"] *= 8
        if any(t["eps"] > 64 for t in large):
            raise RuntimeError("quantiles did not settle")
    for t in open_:
        place, value, seen = t["at"], [], t["below"]
        for v, k in df.where(within(t)).groupBy(t["c"]).count().orderBy(t["c"]).collect():
            value += [v for at in (math.floor(place), math.ceil(place)) if seen <= at < seen + k]
            seen += k
        a, b = value
        found[t["c"]][t["i"]] = a if a == b or place == math.floor(place) else (math.ceil(place) - place) * a + (place - math.floor(place)) * b
    return found


def summary_quantiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, p10, p50 and least of each group; zeros for a group without values."""
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), quantiles(value, 0.1, 0.5).alias("q"), F.min(value).alias("least"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(*by, zero(F.col("mean")).alias("mean"), zero(F.get("q", F.lit(0))).alias("p10"), zero(F.get("q", F.lit(1))).alias("p50"), zero(F.col("least").cast("double")).alias("least"))


def track_distribution(observations: DataFrame, track: str, image: str) -> DataFrame:
    """One row: tracks, mean and greatest length, quantiles, shares of lengths 2, 3 and more, 4 and more, and tracks that see an image twice."""
    t = observations.groupBy(track).agg(F.count("*").alias("len"), F.count_distinct(image).alias("images"))
    n = F.coalesce(F.count("*"), F.lit(0))
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    q = quantiles("len", 0.1, 0.5, 0.9, 0.99)
    out = t.agg(n.alias("tracks"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("mean_length"), F.coalesce(F.max("len"), F.lit(0)).alias("max_length"), q.alias("q"), share(F.col("len") == 2).alias("frac_2"), share(F.col("len") >= 3).alias("frac_ge_3"), share(F.col("len") >= 4).alias("frac_ge_4"), F.count_if(F.expr("images < len")).alias("duplicate_image_tracks"))
    names = ("p10", "p50", "p90", "p99")
    return out.select("tracks", "mean_length", "max_length", *[F.coalesce(F.get("q", F.lit(i)), F.lit(0.0)).alias(k) for i, k in enumerate(names)], "frac_2", "frac_ge_3", "frac_ge_4", "duplicate_image_tracks")


def coverage(df: DataFrame, by: str, selected: Column, registered: Column) -> DataFrame:
    """Selected and registered rows of each group and their ratio (0 if none is selected)."""
    out = df.groupBy(by).agg(F.count_if(selected).alias("selected"), F.count_if(selected & registered).alias("registered"))
    return out.withColumn("fraction", F.when(F.col("selected") > 0, F.col("registered") / F.col("selected")).otherwise(0.0))


def role_totals(df: DataFrame, ranges: DataFrame, at: str) -> DataFrame:
    """Rows by role; ``ranges`` (role, start, end) is a small closed-interval dimension, and a time in none has the role ``unassigned``."""
    roles = df.join(F.broadcast(ranges), F.col(at).between(F.col("start"), F.col("end")), "left")
    return roles.groupBy(F.coalesce("role", F.lit("unassigned")).alias("role")).agg(F.count("*").alias("n"))


def support_fractions(observations: DataFrame, track: str, inside: Column, *, least_fraction: float, least_length: int) -> DataFrame:
    """Tracks with their support fraction, those of enough length and support."""
    t = observations.groupBy(track).agg(F.count("*").alias("length"), F.avg(inside.cast("double")).alias("support"))
    return t.where((F.col("length") >= least_length) & (F.col("support") >= least_fraction))


def centroid_spread(points: DataFrame, by: str, x: str, y: str, z: str) -> DataFrame:
    """Centroid of each group, and median, deviation and relative deviation of the distances from it."""
    c = points.groupBy(by).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.avg(z).alias("cz"))
    d = points.join(c, by).withColumn("r", F.sqrt((F.col(x) - F.col("cx")) ** 2 + (F.col(y) - F.col("cy")) ** 2 + (F.col(z) - F.col("cz")) ** 2))
    out = d.groupBy(by, "cx", "cy", "cz").agg(F.percentile("r", F.lit(0.5)).alias("radius_median"), F.stddev_pop("r").alias("radius_std"), F.avg("r").alias("m"))
    return out.withColumn("radius_cv", F.col("radius_std") / F.greatest("m", F.lit(1e-9))).drop("m")


def robust_bounds(points: DataFrame, axes: list[str], low: float = 0.001, high: float = 0.999) -> DataFrame:
    """One row: count, and least, greatest and robust least and greatest of each axis."""
    q = exact_quantiles(points, {a: [low, high] for a in axes})
    aggs = [F.count("*").alias("n")]
    for a in axes:
        aggs += [F.min(a).alias(f"{a}_min"), F.max(a).alias(f"{a}_max"), F.lit(q[a][0]).cast("double").alias(f"{a}_low"), F.lit(q[a][1]).cast("double").alias(f"{a}_high")]
    return points.agg(*aggs)


def database_counts(images: DataFrame, cameras: DataFrame, keypoints: DataFrame, matches: DataFrame, geometries: DataFrame, rows: str = "rows") -> DataFrame:
    """(metric, value): counts of the tables of a match database, and sums of their ``rows``."""
    total = lambda df: df.agg(F.coalesce(F.sum(rows), F.lit(0)).cast("bigint").alias("value"))
    count = lambda df: df.agg(F.count("*").alias("value"))
    parts = {
        "image_count": count(images), "camera_count": count(cameras), "keypoint_rows": total(keypoints), "match_pair_rows": count(matches), "raw_match_rows": total(matches),
        "verified_pair_rows": count(geometries.where(F.col(rows) > 0)), "verified_inlier_rows": total(geometries),
    }
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("metric"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def logical_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: number of rows, and a digest of them that no order of rows changes: the sum of 60 bits of each row's MD5."""
    body = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])
    bits = F.conv(F.substring(F.md5(body), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("digest"))


def public_rows(df: DataFrame, fields: list[str]) -> DataFrame:
    """The fields in their order, as text; what is missing is empty."""
    return df.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields])


def pairing_summary(frames: DataFrame, pairs: DataFrame, offsets: DataFrame) -> DataFrame:
    """(metric, value) of a pair schedule: selected frames, pairs, frames in pairs, frames in none, and ambiguous offsets.

    The pairs are made once, as a table, and so are the frames and what is paired.
    """
    frames = materialize(frames.select("name"), "frames")
    ends = materialize(pairs.select("a", "b"), "pairs")
    paired = materialize(ends.select(F.explode(F.array("a", "b")).alias("name")).distinct(), "paired")
    pairs = ends
    parts = {
        "selected_geometry_count": frames.agg(F.count_distinct("name").alias("value")), "schedule_pair_count": pairs.agg(F.count("*").alias("value")), "schedule_image_coverage": paired.agg(F.count("*").alias("value")),
        "images_without_pair": frames.select("name").distinct().join(paired, "name", "left_anti").agg(F.count("*").alias("value")), "ambiguous_offset_count": offsets.agg(F.count_if("ambiguous").alias("value")),
    }
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("metric"), "value")
        out = row if out is None else out.unionByName(row)
    return out


#: The map files of a dense workspace, by folder and ending.
MAP_FILES = {"photometric_depth_count": ("depth_maps", "photometric"), "photometric_normal_count": ("normal_maps", "photometric"), "geometric_depth_count": ("depth_maps", "geometric"), "geometric_normal_count": ("normal_maps", "geometric")}


def map_file_counts(files: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """Numbers of depth and normal maps of each kind among listed files."""
    return files.groupBy(*by).agg(*[F.count_if(F.col(path).rlike(rf"(^|/)stereo/{folder}/[^/]*\.{kind}\.bin$")).alias(name) for name, (folder, kind) in MAP_FILES.items()])


def region_means(regions: DataFrame, by: list[str], fields: list[str], least_regions: int = 8) -> DataFrame:
    """Means of measured fractions over all regions of a group; null for a group that lacks a region or has a fraction out of 0 to 1."""
    valid = F.lit(True)
    for f in fields:
        x = F.col(f).cast("double")
        valid = valid & F.coalesce(~F.isnan(x) & x.between(0.0, 1.0), F.lit(False))
    out = regions.groupBy(*by).agg(F.count("*").alias("n"), F.bool_and(valid).alias("valid"), *[F.avg(f).alias(f) for f in fields])
    return out.select(*by, *[F.when(F.col("valid") & (F.col("n") == least_regions), F.col(f)).alias(f"{f}_mean") for f in fields])


def metric_record(value: str, count: str, denominator: str, method: str, evidence: Column) -> Column:
    """A measured metric with the hash of its evidence."""
    return F.struct(F.col(value).cast("double").alias("value"), F.col(count).cast("bigint").alias("count"), F.col(denominator).cast("bigint").alias("denominator"), F.lit(method).alias("measurement_method"), evidence.alias("evidence_sha256"))


def _finite(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return out


def model_summary(images: DataFrame, points: DataFrame, observations: DataFrame) -> DataFrame:
    """One row on a sparse model: images (ring, registered, x, y, z of the centre), points (x, y, z) and observations.

    Bounds are of finite points and null without any; a trajectory is coherent
    if every ring with a finite centre has three or more.
    """
    place = [F.col(a).cast("double") for a in "xyz"]
    one = F.lit(1).alias("one")
    total = images.agg(F.count("*").alias("total_images"), F.count_if("registered").alias("registered_images"), one)
    bounds = [f(F.when(_finite(*place), c)).alias(f"{a}_{f.__name__}") for a, c in zip("xyz", place, strict=True) for f in (F.min, F.max)]
    cloud = points.agg(F.count("*").alias("sparse_points"), F.count_if(_finite(*place)).alias("finite_sparse_points"), *bounds, one)
    rings = images.where("registered").where(_finite(*place)).groupBy(F.coalesce("ring", F.lit("unknown")).alias("ring")).count()
    rings = rings.agg(F.count("*").alias("trajectory_ring_count"), F.coalesce(F.min("count") >= 3, F.lit(False)).alias("trajectory_coherent_candidate"), one)
    out = total.join(F.broadcast(cloud), "one").join(F.broadcast(rings), "one").join(F.broadcast(observations.agg(F.count("*").alias("observations"), one)), "one").drop("one")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumns({"registration_fraction": share("registered_images", "total_images"), "mean_track_length": share("observations", "sparse_points"), "mean_observations_per_image": share("observations", "registered_images")})


def trajectory_spread(images: DataFrame) -> DataFrame:
    """Of each ring's registered images (ring, registered, x, y, z): their number, centroid, and median, deviation (of the whole) and variation of the distances from it.

    Centres that are not finite are left out; a missing ring is ``unknown``.
    The centroids are a row for each ring and go to a second pass over the images.
    """
    place = [F.col(a).cast("double") for a in "xyz"]
    own = images.where("registered").where(_finite(*place)).select(F.coalesce("ring", F.lit("unknown")).alias("ring"), *[c.alias(a) for a, c in zip("xyz", place, strict=True)])
    middle = own.groupBy("ring").agg(F.count("*").alias("registered_count"), *[F.avg(a).alias(f"centroid_{a}") for a in "xyz"])
    radius = F.sqrt(sum((F.col(a) - F.col(f"centroid_{a}")) ** 2 for a in "xyz"))
    by = ["ring", "registered_count", *[f"centroid_{a}" for a in "xyz"]]
    spread = own.join(small_side(middle), "ring").withColumn("radius", radius).groupBy(*by)
    return spread.agg(F.percentile("radius", F.lit(0.5)).alias("radius_median"), F.stddev_pop("radius").alias("radius_std"), (F.stddev_pop("radius") / F.greatest(F.avg("radius"), F.lit(1e-9))).alias("radius_cv"))


def negative_evidence(manifest: DataFrame, records: DataFrame, passes: list[str], rings: list[str], *, role: str = "empty_board", deferred: str = "deferred_until_registered_empty_reference") -> DataFrame:
    """(kind, name, n, least_frame, greatest_frame): frames of each approved pass in the manifest (role, pass_id, frame), numbers of each refinement status of the records (ring, status), and what follows from them.

    A pass without frames has 0; a missing status is ``missing``.
    """
    frames = manifest.where((F.col("role") == role) & F.col("pass_id").isin(*passes)).groupBy(F.col("pass_id").alias("name")).agg(F.count("*").alias("n"), F.min("frame").cast("bigint").alias("least_frame"), F.max("frame").cast("bigint").alias("greatest_frame"))
    listed = manifest.sparkSession.createDataFrame([(p,) for p in passes], "name string")
    frames = listed.join(frames, "name", "left").fillna({"n": 0}).select(F.lit("pass").alias("kind"), "name", "n", "least_frame", "greatest_frame")
    none = F.lit(None).cast("bigint")
    states = records.where(F.col("ring").isin(*rings)).groupBy(F.coalesce("status", F.lit("missing")).alias("name")).agg(F.count("*").alias("n"))
    status = F.when(F.count_if(F.col("name") == deferred) > 0, deferred).otherwise("not_evaluable")
    shape = lambda kind, df: df.select(F.lit(kind).alias("kind"), "name", "n", none.alias("least_frame"), none.alias("greatest_frame"))
    return frames.unionByName(shape("status", states)).unionByName(shape("result", states.agg(status.alias("name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))))
