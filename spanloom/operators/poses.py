"""Poses of pairs: what the final model says of them, pose overrides with their matrices, and the basis that an object stands in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..scratch import materialize, small_side
from .cloud import principal_axes


def _cross(a: Column, b: Column) -> Column:
    return F.array(*[a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)])


def _scaled(a: Column, by: Column) -> Column:
    return F.array(*[a[i] * by for i in range(3)])


def pose_metrics(pairs: DataFrame, cameras: DataFrame) -> DataFrame:
    """``pairs`` (first, second, ...) with relative_rotation, rotation_deg, center_jump and ray_jump_deg of the final poses.

    ``cameras``: name, rotation (from the world) and center.  A camera looks
    along the third row of its rotation.  All four are null if an end has no pose.
    """
    for side in ("first", "second"):
        pairs = pairs.join(cameras.select(F.col("name").alias(side), F.col("rotation").alias(f"{side}_r"), F.col("center").alias(f"{side}_c")), side, "left")
    ray = lambda side: F.slice(f"{side}_r", 7, 3)
    both = F.col("first_r").isNotNull() & F.col("second_r").isNotNull()
    jump = E.norm(F.zip_with("second_c", "first_c", lambda b, a: b - a))
    out = pairs.withColumns({
        "relative_rotation": F.when(both, E.matmul("second_r", E.transpose("first_r"))),
        "rotation_deg": F.when(both, E.geodesic_deg("second_r", "first_r")),
        "center_jump": F.when(both, jump),
        "ray_jump_deg": F.when(both, E.angle_between_deg(ray("first"), ray("second"))),
    })
    return out.drop("first_r", "second_r", "first_c", "second_c")


def projective_error(actual: Column | str, expected: Column | str) -> Column:
    """Greatest difference of two 3x3 matrices after the best scaling of the second; infinite unless both are whole and the second isn't zero."""
    a, b = E.col(actual), E.col(expected)
    whole = F.coalesce((F.size(a) == 9) & (F.size(b) == 9) & F.forall(a, E.is_finite) & F.forall(b, E.is_finite), F.lit(False))
    power = E.dot(b, b)
    scale = E.dot(a, b) / power
    return F.when(whole & (power > 0), F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - scale * y)))).otherwise(F.lit(float("inf")))


def pose_overrides(pairs: DataFrame) -> DataFrame:
    """``pairs`` (rotation, translation, k1, k2) with translation made a unit, essential and fundamental.

    k1 and k2 are fx, fy, cx and cy of the two cameras.  A rotation that is not
    whole or whose determinant is off 1 by over 1e-4, and a translation without
    direction, are errors.
    """
    r, t = F.col("rotation"), F.col("translation")
    det = E.dot(F.slice(r, 1, 3), _cross(F.slice(r, 4, 3), F.slice(r, 7, 3)))
    sound = F.coalesce((F.size(r) == 9) & F.forall(r, E.is_finite), F.lit(False))
    length = E.norm(t)
    moves = F.coalesce((F.size(t) == 3) & E.is_finite(length) & (length > 1e-12), F.lit(False))
    checked = F.when(~sound, F.raise_error(F.lit("a rotation must be a whole 3x3 matrix"))).when(F.abs(det - 1) > 1e-4, F.raise_error(F.lit("a rotation must have determinant 1"))).when(~moves, F.raise_error(F.lit("a translation must have a direction"))).otherwise(F.transform(t, lambda x: x / length))
    own = pairs.withColumn("translation", checked)
    # Row i of the cross product's matrix times the rotation, column by column.
    column = lambda j: F.array(r[j], r[3 + j], r[6 + j])
    turned = [_cross(F.col("translation"), column(j)) for j in range(3)]
    own = own.withColumn("essential", F.array(*[turned[j][i] for i in range(3) for j in range(3)]))

    def inverse(k: str) -> Column:
        fx, fy, cx, cy = (F.col(k)[i] for i in range(4))
        zero, one = F.lit(0.0), F.lit(1.0)
        return F.array(1 / fx, zero, -cx / fx, zero, 1 / fy, -cy / fy, zero, zero, one)

    return own.withColumn("fundamental", E.matmul(E.matmul(E.transpose(inverse("k2")), "essential"), inverse("k1")))


def vertical_basis(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """One row: center, vertical, front and right, each of three numbers, of points (x, y, z) seen by cameras (name, x, y, z).

    The centre is the median of each axis.  The vertical is the axis of least
    spread of the camera centres, or of most spread of the points with fewer
    than three cameras, and its sign the one by which the median height is not
    negative.  The front is towards the first camera by name (else the second
    axis), across the vertical.
    """
    axes = ["x", "y", "z"]
    middle = points.agg(F.array(*[F.percentile(a, F.lit(0.5)) for a in axes]).alias("center"))
    own = principal_axes(points, axes).select(F.col("vectors").alias("axes"))
    enough = cameras.limit(3).count() >= 3
    seen = principal_axes(cameras if enough else points, axes).select(F.col("vectors").alias("camera_axes"))
    first = cameras.agg(F.count("*").alias("cameras"), F.min_by(F.array(*axes), "name").alias("eye"))
    one = middle
    for part in (own, seen, first):
        one = one.join(F.broadcast(part), F.lit(True), "left")
    raw = F.when(F.col("cameras") >= 3, F.slice("camera_axes", 7, 3)).otherwise(F.slice("axes", 1, 3))
    one = materialize(one.withColumn("raw", raw), "basis")
    height = E.dot(F.array(*[F.col(a) - F.col("center")[i] for i, a in enumerate(axes)]), F.col("raw"))
    middle_height = points.join(small_side(one.select("center", "raw")), F.lit(True)).agg(F.percentile(height, F.lit(0.5)).alias("h"))
    one = one.join(F.broadcast(middle_height), F.lit(True)).withColumn("vertical", F.when(F.col("h") < 0, _scaled(F.col("raw"), F.lit(-1.0))).otherwise(F.col("raw")))

    def across(v: Column) -> Column:
        share = E.dot(v, F.col("vertical"))
        return F.array(*[v[i] - F.col("vertical")[i] * share for i in range(3)])

    second = F.slice("axes", 4, 3)
    one = one.withColumn("ahead", across(F.when(F.col("cameras") > 0, F.array(*[F.col("eye")[i] - F.col("center")[i] for i in range(3)])).otherwise(second)))
    one = one.withColumn("ahead", F.when(E.norm("ahead") < 1e-12, across(second)).otherwise(F.col("ahead")))
    one = one.withColumn("front", _scaled(F.col("ahead"), 1 / F.greatest(E.norm("ahead"), F.lit(1e-12))))
    side = _cross(F.col("vertical"), F.col("front"))
    one = one.withColumn("side", side)
    return one.select("center", "vertical", "front", _scaled(F.col("side"), 1 / F.greatest(E.norm("side"), F.lit(1e-12))).alias("right"))


def registered_manifest(records: DataFrame, names: DataFrame, expected: int) -> DataFrame:
    """The ``records`` (filename, ...) of ``names`` (filename); names that repeat or are another number, and records that miss or repeat, are errors."""
    found = names.agg(F.count("*").alias("n"), F.count_distinct("filename").alias("d")).first()
    if (found.n, found.d) != (expected, expected):
        raise ValueError(f"{found.d} different of {found.n} names, {expected} expected")
    out = records.join(names.select("filename"), "filename", "left_semi")
    if (n := out.count()) != expected:
        raise ValueError(f"{n} records of {expected} names")
    return out.select(records.columns)
