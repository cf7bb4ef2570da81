"""Binary masks as runs of image rows (image, y, x0, x1), x1 exclusive: set algebra, morphology, parts, and projection of clouds against them.

Everything is done on runs by (image, y), so no pixel of a mask is ever a row
of its own.  ``frames`` are (image, width, height); a frame without runs is an
empty mask.  Rows of an image are bounded by its width, so windows over them
are small, however many images there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import is_finite
from ..scratch import materialize, small_side
from .components import components
from .gates import gate
from .stats import quantiles

_ROW = ["image", "y"]


def union_runs(runs: DataFrame) -> DataFrame:
    """The runs that the pixels of ``runs`` make: none overlap or touch, and empty ones are gone."""
    w = Window.partitionBy(*_ROW).orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begun = runs.where("x1 > x0").select(*_ROW, "x0", "x1", F.coalesce(F.col("x0") > reach, F.lit(True)).cast("int").alias("new"))
    return begun.withColumn("part", F.sum("new").over(w)).groupBy(*_ROW, "part").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("part")


def _sweep(steps: DataFrame, keep: Column) -> DataFrame:
    """Runs of the places where ``keep`` holds of c0 and c1, the numbers of runs of two sets there; ``steps`` are (image, y, x, d0, d1)."""
    at = steps.groupBy(*_ROW, "x").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    w = Window.partitionBy(*_ROW).orderBy("x")
    seen = at.select(*_ROW, F.col("x").alias("x0"), F.lead("x").over(w).alias("x1"), F.sum("d0").over(w).alias("c0"), F.sum("d1").over(w).alias("c1"))
    return union_runs(seen.where(keep & F.col("x1").isNotNull()).select(*_ROW, "x0", "x1"))


def _steps(runs: DataFrame, second: bool) -> DataFrame:
    d = lambda v: (F.lit(0 if second else v).alias("d0"), F.lit(v if second else 0).alias("d1"))
    return runs.where("x1 > x0").select(*_ROW, F.inline(F.array(F.struct(F.col("x0").alias("x"), *d(1)), F.struct(F.col("x1").alias("x"), *d(-1)))))


def intersect_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sweep(_steps(a, False).unionByName(_steps(b, True)), (F.col("c0") > 0) & (F.col("c1") > 0))


def subtract_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sweep(_steps(a, False).unionByName(_steps(b, True)), (F.col("c0") > 0) & (F.col("c1") == 0))


def _framed(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """Runs with the size of their frame, cut to it."""
    met = runs.join(small_side(frames.select("image", "width", "height")), "image").where("y >= 0 and y < height")
    return met.withColumns({"x0": F.greatest("x0", F.lit(0)), "x1": F.least("x1", "width")}).where("x1 > x0")


def dilate(runs: DataFrame, frames: DataFrame, radius: int) -> DataFrame:
    """Pixels within a square of 2 radius + 1 of a pixel of the mask, cut to the frame."""
    wide = _framed(runs, frames).select(*_ROW, "height", F.greatest(F.col("x0") - radius, F.lit(0)).alias("x0"), F.least(F.col("x1") + radius, F.col("width")).alias("x1"))
    merged = union_runs(wide).join(small_side(frames.select("image", "height")), "image")
    tall = merged.select("image", F.explode(F.sequence(F.greatest(F.col("y") - radius, F.lit(0)), F.least(F.col("y") + radius, F.col("height") - 1))).alias("y"), "x0", "x1")
    return union_runs(tall)


def erode(runs: DataFrame, frames: DataFrame, radius: int) -> DataFrame:
    """Pixels whose square of 2 radius + 1, as far as it is in the frame, is all in the mask."""
    own = _framed(union_runs(runs), frames)
    thin = own.withColumns({"x0": F.when(F.col("x0") > 0, F.col("x0") + radius).otherwise(F.col("x0")), "x1": F.when(F.col("x1") < F.col("width"), F.col("x1") - radius).otherwise(F.col("x1"))}).where("x1 > x0")
    near = F.sequence(F.greatest(F.col("y") - radius, F.lit(0)), F.least(F.col("y") + radius, F.col("height") - 1))
    tall = thin.select("image", "height", F.explode(near).alias("y"), "x0", "x1")
    steps = tall.select(*_ROW, "height", F.inline(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d0")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d0")))))
    at = steps.groupBy(*_ROW, "height", "x").agg(F.sum("d0").alias("d0"))
    w = Window.partitionBy(*_ROW).orderBy("x")
    seen = at.select(*_ROW, "height", F.col("x").alias("x0"), F.lead("x").over(w).alias("x1"), F.sum("d0").over(w).alias("c"))
    rows = F.least(F.col("y") + radius, F.col("height") - 1) - F.greatest(F.col("y") - radius, F.lit(0)) + 1
    return union_runs(seen.where((F.col("c") == rows) & F.col("x1").isNotNull()).select(*_ROW, "x0", "x1"))


def label_runs(runs: DataFrame) -> DataFrame:
    """Runs with the 8-connected part they belong to, named after its first run in raster order, and the part's area."""
    name = F.concat_ws("|", F.col("image").cast("string"), F.lpad(F.col("y").cast("string"), 9, "0"), F.lpad(F.col("x0").cast("string"), 9, "0"))
    own = materialize(union_runs(runs).withColumn("run", name), "runs")
    below = own.select("image", (F.col("y") - 1).alias("y"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("run").alias("v"))
    links = own.join(below, _ROW).where("x0 <= bx1 and bx0 <= x1").select(F.col("run").alias("u"), "v")
    found = components(links).withColumnRenamed("node", "run")
    out = own.join(found, "run", "left").select(*_ROW, "x0", "x1", F.coalesce("root", "run").alias("part"))
    area = out.groupBy("part").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))
    return out.join(area, "part")


def largest_part(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runs of each image's largest part (of equal ones the first), and (image, removed) pixels of the others."""
    labelled = materialize(label_runs(runs), "parts")
    parts = labelled.groupBy("image", "part").agg(F.max("area").alias("area"))
    best = parts.groupBy("image").agg(F.max_by(F.struct("part", "area"), F.struct(F.col("area"), -_order(parts))).alias("b"), F.sum("area").alias("all"))
    kept = best.select(F.col("b.part").alias("part"))
    return labelled.join(kept, "part", "left_semi").select(*_ROW, "x0", "x1"), best.select("image", (F.col("all") - F.col("b.area")).alias("removed"))


def _order(parts: DataFrame) -> Column:
    """The place of a part's first run in raster order, as a number."""
    at = F.split(F.col("part"), r"\|")
    return F.element_at(at, -2).cast("bigint") * 1_000_000_000 + F.element_at(at, -1).cast("bigint")


#: Fixed value: a part of fewer pixels that erosion would touch is kept whole.
THIN_AREA = 256


def mask_products(runs: DataFrame, frames: DataFrame, *, margin: int = 2, band: int = 3, keep_thin: bool = True) -> DataFrame:
    """Runs (image, product, y, x0, x1) of the products ``full``, ``feature``, ``mvs`` and ``boundary`` of each mask.

    The feature mask is the mask eroded by ``margin``, with small parts that
    this would touch whole; the boundary is what the erosion takes, widened by
    ``band`` within the mask; the mvs mask is the mask.
    """
    full = materialize(union_runs(_framed(runs, frames)), "full")
    eroded = materialize(erode(full, frames, margin) if margin > 0 else full, "eroded")
    boundary = materialize(subtract_runs(full, eroded), "boundary")
    feature = eroded
    if keep_thin:
        small = label_runs(full).where(F.col("area") < THIN_AREA)
        hit = small.join(boundary.select(*_ROW, F.col("x0").alias("bx0"), F.col("x1").alias("bx1")), _ROW).where("x0 < bx1 and bx0 < x1").select("part").distinct()
        feature = union_runs(eroded.unionByName(small.join(hit, "part", "left_semi").select(*_ROW, "x0", "x1")))
    if band > 0:
        boundary = intersect_runs(dilate(boundary, frames, band), full)
    products = {"full": full, "feature": feature, "mvs": full, "boundary": boundary}
    out = None
    for name, made in products.items():
        made = made.select("image", F.lit(name).alias("product"), "y", "x0", "x1")
        out = made if out is None else out.unionByName(made)
    return out


def mask_diagnostics(runs: DataFrame, frames: DataFrame, *, base: float = 0.72, widest: float = 0.45) -> DataFrame:
    """A row for each frame: pixels, share, box, centre, parts, shares of the largest and second part, and the widest row of the base."""
    own = materialize(label_runs(_framed(runs, frames).select(*_ROW, "x0", "x1")), "labelled")
    n = F.col("x1") - F.col("x0")
    by_row = own.join(small_side(frames.select("image", "height")), "image").groupBy(*_ROW).agg(F.sum(n).alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum(n * (F.col("x0") + F.col("x1") - 1) / 2).alias("sx"), F.max(F.col("y") >= F.floor(F.col("height") * base)).alias("low"))
    whole = by_row.groupBy("image").agg(F.sum("n").alias("pixels"), F.min("x0").alias("x"), F.min("y").alias("top"), (F.max("x1") - F.min("x0")).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), (F.sum("sx") / F.sum("n")).alias("cx"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("cy"), F.max(F.when(F.col("low"), F.col("n"))).alias("base_support"))
    parts = own.groupBy("image", "part").agg(F.max("area").alias("area")).groupBy("image").agg(F.count("*").alias("parts"), F.max("area").alias("first"), F.sort_array(F.collect_list("area"), asc=False).alias("areas"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    met = frames.select("image", "width", "height").join(whole, "image", "left").join(parts, "image", "left")
    second = F.get("areas", F.lit(1)) / F.get("areas", F.lit(0))
    return met.select(
        "image", zero(F.col("pixels")).alias("pixels"), (zero(F.col("pixels")) / F.greatest(F.col("width") * F.col("height"), F.lit(1))).alias("fraction"),
        *[zero(F.col(c)).alias(c) for c in ("x", "top", "w", "h")], "cx", "cy", zero(F.col("parts")).alias("parts"), F.coalesce(F.col("first") / F.col("pixels"), F.lit(0.0)).alias("largest_fraction"), F.coalesce(second, F.lit(0.0)).alias("second_fraction"),
        zero(F.col("base_support")).alias("base_support"), (zero(F.col("base_support")) > F.col("width") * widest).alias("base_warning"),
    )


# Projection against masks ------------------------------------------------------


def projected_pixels(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """(image, px, py, n): how many points (x, y, z) fall on each pixel of each camera (image, m, k, width, height).

    A point counts if it is finite, ahead of the camera and within the frame,
    before and after rounding half to even.  Every point meets every camera, as
    the measure is of all views; equal pixels are counted within the task first.
    """
    solid = points.where(is_finite("x") & is_finite("y") & is_finite("z")).select("x", "y", "z")
    met = solid.join(small_side(cameras.select("image", "m", "k", "width", "height")), F.lit(True))
    cam = [F.col("m")[4 * i] * F.col("x") + F.col("m")[4 * i + 1] * F.col("y") + F.col("m")[4 * i + 2] * F.col("z") + F.col("m")[4 * i + 3] for i in range(3)]
    # A generator is a step of its own, so that no filter after it makes these numbers once more for each use.
    at = met.select("image", "width", "height", "k", F.inline(F.array(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cam)])))).where(is_finite("c0") & is_finite("c1") & is_finite("c2") & (F.col("c2") > 0))
    seen = F.struct((F.col("k")[0] * F.col("c0") / F.col("c2") + F.col("k")[2]).alias("u"), (F.col("k")[1] * F.col("c1") / F.col("c2") + F.col("k")[3]).alias("v"))
    at = at.select("image", "width", "height", F.inline(F.array(seen)))
    at = at.where("u >= 0 and u < width and v >= 0 and v < height").select("image", "width", "height", F.rint("u").cast("bigint").alias("px"), F.rint("v").cast("bigint").alias("py"))
    return at.where("px < width and py < height").groupBy("image", "px", "py").agg(F.count("*").alias("n"))


def mask_projection(points: DataFrame, cameras: DataFrame, masks: DataFrame, mask_frames: DataFrame, *, radius: int = 5) -> DataFrame:
    """A row for each camera (image, ring, m, k, width, height): status, projected and inside points, mask area, precision, recall and iou.

    Recall and iou compare the mask with the footprint, that is the projected
    pixels dilated by ``radius``.  A view whose mask is missing or of another
    size has that as its status and no figures.
    """
    size = mask_frames.select(F.col("image"), F.col("width").alias("mw"), F.col("height").alias("mh"))
    met = cameras.join(size, "image", "left")
    status = F.when(F.col("mw").isNull() | F.col("mh").isNull(), "missing_mask").when((F.col("mw") != F.col("width")) | (F.col("mh") != F.col("height")), "shape_mismatch").otherwise("measured")
    views = materialize(met.withColumn("status", status).drop("mw", "mh"), "views")
    good = views.where("status = 'measured'")
    pixels = materialize(projected_pixels(points, good), "pixels")
    mask = materialize(union_runs(_framed(masks, good)), "masks")
    hit = pixels.join(mask, (pixels["image"] == mask["image"]) & (pixels["py"] == mask["y"]) & (pixels["px"] >= mask["x0"]) & (pixels["px"] < mask["x1"]), "left_semi")
    foot = materialize(dilate(pixels.select("image", F.col("py").alias("y"), F.col("px").alias("x0"), (F.col("px") + 1).alias("x1")), good, radius), "footprint")
    both = foot.join(mask.select(*_ROW, F.col("x0").alias("mx0"), F.col("x1").alias("mx1")), _ROW).where("x0 < mx1 and mx0 < x1")
    length = F.col("x1") - F.col("x0")
    parts = {
        "projected": pixels.groupBy("image").agg(F.sum("n").alias("projected")), "inside": hit.groupBy("image").agg(F.sum("n").alias("inside")), "mask_area": mask.groupBy("image").agg(F.sum(length).alias("mask_area")),
        "footprint": foot.groupBy("image").agg(F.sum(length).alias("footprint")), "shared": both.groupBy("image").agg(F.sum(F.least("x1", "mx1") - F.greatest("x0", "mx0")).alias("shared")),
    }
    out = views.select("image", "ring", "status")
    for part in parts.values():
        out = out.join(part, "image", "left")
    done = F.col("status") == "measured"
    n = {c: F.coalesce(c, F.lit(0)) for c in parts}
    share = lambda a, b: F.when(done, a / F.greatest(b, F.lit(1)))
    return out.select(
        "image", "ring", "status", *[F.when(done, n[c]).alias(c) for c in ("projected", "inside", "mask_area")],
        share(n["inside"], n["projected"]).alias("precision"), share(n["shared"], n["mask_area"]).alias("recall"), share(n["shared"], n["footprint"] + n["mask_area"] - n["shared"]).alias("iou"),
    )


#: Least 10 % quantile over views, and least mean of each ring.
VIEW_LEAST = {"precision": 0.90, "recall": 0.60, "iou": 0.60}
RING_LEAST = {"precision": 0.90, "recall": 0.60, "iou": 0.60}


def ring_projection(views: DataFrame) -> DataFrame:
    """(ring, views, and mean, p10, p50 and least of precision, recall and iou) over measured views."""
    aggs = [F.count("*").alias("views")]
    for c in VIEW_LEAST:
        q = quantiles(c, 0.1, 0.5)
        aggs += [F.avg(c).alias(f"{c}_mean"), q[0].alias(f"{c}_p10"), q[1].alias(f"{c}_p50"), F.min(c).alias(f"{c}_least")]
    return views.where("status = 'measured'").groupBy("ring").agg(*aggs)


def projection_gate(views: DataFrame, rings: DataFrame) -> DataFrame:
    """One row (registered, measured, passed, checks, reasons): the views of ``mask_projection`` against the limits, and the expected ``rings`` (ring)."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    measured = views.where("status = 'measured'")
    whole = views.agg(F.count("*").alias("registered"), F.count_if(F.col("status") == "measured").alias("measured"))
    p10 = measured.agg(*[zero(quantiles(c, 0.1)[0]).alias(f"{c}_p10") for c in VIEW_LEAST])
    by_ring = rings.select("ring").distinct().join(ring_projection(views).withColumnRenamed("ring", "r"), F.col("ring") == F.col("r"), "left")
    of_rings = by_ring.agg(F.count("*").alias("rings"), F.coalesce(F.min(F.coalesce(F.col("views") > 0, F.lit(False))), F.lit(False)).alias("all_rings"), *[F.coalesce(F.min(F.col(f"{c}_mean") >= least), F.lit(True)).alias(f"{c}_ok") for c, least in RING_LEAST.items()])
    one = whole.withColumn("one", F.lit(1))
    for part in (p10, of_rings):
        one = one.join(part.withColumn("one", F.lit(1)), "one")
    checks = {"mask_root_available": F.lit(True), "all_registered_views_measured": F.col("measured") == F.col("registered")}
    checks |= {f"view_{c}_p10": F.col(f"{c}_p10") >= least for c, least in VIEW_LEAST.items()}
    checks |= {"all_selected_rings_measured": (F.col("rings") > 0) & F.col("all_rings")}
    checks |= {f"ring_{c}_mean": (F.col("rings") > 0) & F.col(f"{c}_ok") for c in RING_LEAST}
    return gate(one, checks, ["registered", "measured"])
