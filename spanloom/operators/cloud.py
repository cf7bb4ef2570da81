"""Point clouds: projection into cameras, regions of height, contamination, voxel support, axes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import is_finite
from .components import components
from .stats import exact_quantiles

#: Closed, overlapping intervals of normalised height.
REGIONS = {
    "bowl_interior": (0.28, 0.56),
    "rim": (0.48, 0.66),
    "globe_shoulder": (0.52, 0.75),
    "continuous_neck": (0.70, 0.86),
    "lid_tiers": (0.82, 0.94),
    "finial": (0.93, 1.00),
    "pedestal_transitions": (0.12, 0.32),
    "base": (0.00, 0.18),
}


def regions_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for k, (a, b) in REGIONS.items()], "region string, low double, high double")


def project(x: Column, y: Column, z: Column, m: Column, k: Column) -> Column:
    """Struct (u, v, z) of a point in a camera: ``m`` the 3x4 pose by rows, ``k`` (fx, fy, cx, cy).  u and v are null behind the camera; a place outside the frame is kept."""
    cam = [m[4 * i] * x + m[4 * i + 1] * y + m[4 * i + 2] * z + m[4 * i + 3] for i in range(3)]
    ahead = cam[2] > 1e-9
    return F.struct(F.when(ahead, k[0] * cam[0] / cam[2] + k[2]).alias("u"), F.when(ahead, k[1] * cam[1] / cam[2] + k[3]).alias("v"), cam[2].alias("z"))


def normalized_height(df: DataFrame, height: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``df`` with h: (height - q_low) / (q_high - q_low), cut to [0, 1]."""
    lo, hi = (F.lit(q).cast("double") for q in exact_quantiles(df, {height: [low, high]})[height])
    return df.withColumn("h", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(height) - lo) / F.greatest(hi - lo, F.lit(1e-9)))))


def region_evidence(points: DataFrame, *, bins: int = 8) -> DataFrame:
    """Rows of points (h, supported, views) by region: counts, fractions, median views and occupied height bins.

    A point belongs to every region whose closed interval has it, and one on the
    edge of two bins is in both.
    """
    r = points.join(F.broadcast(regions_table(points.sparkSession)), F.col("h").between(F.col("low"), F.col("high")))
    width = (F.col("high") - F.col("low")) / bins
    edge = lambda i: F.col("low") + width * i
    filled = [F.max((F.col("supported") & (F.col("h") >= edge(i)) & (F.col("h") <= (edge(i + 1) if i + 1 < bins else F.col("high")))).cast("int")) for i in range(bins)]
    n = F.count("*")
    return r.groupBy("region", "low", "high").agg(n.alias("points"), F.count_if("supported").alias("supported"), (F.count_if("supported") / n).alias("supported_fraction"), (F.count_if(F.expr("views >= 3")) / n).alias("projected_fraction"), F.percentile("views", F.lit(0.5)).alias("median_views"), (sum(filled[1:], filled[0]) / float(bins)).alias("bin_occupancy")).drop("low", "high")


def bottom_escape(points: DataFrame, height: str, outside: str, q: float = 0.15, least_views: int = 2) -> DataFrame:
    """One row: the height threshold, the share of points with an escape in any view, and of low ones with escapes in several.

    Without points the threshold is 0 and both shares are 1; heights that are
    not finite and negative counts are errors.
    """
    cut = exact_quantiles(points, {height: [q]})[height][0]
    wrong = F.count_if(~is_finite(height) | ~F.coalesce(F.col(outside) >= 0, F.lit(False)))
    low = F.when(wrong > 0, F.raise_error(F.lit("heights must be finite and counts not negative"))).otherwise(F.lit(0.0 if cut is None else cut))
    t = points.agg(low.alias("low_threshold"))
    rows = points.withColumn("__one", F.lit(1)).join(F.broadcast(t.withColumn("__one", F.lit(1))), "__one")
    low = F.col(height) <= F.col("low_threshold")
    return rows.agg(F.coalesce(F.max("low_threshold"), F.lit(0.0)).alias("low_threshold"), F.coalesce(F.avg((F.col(outside) > 0).cast("double")), F.lit(1.0)).alias("escape_fraction"), F.coalesce(F.avg((low & (F.col(outside) >= least_views)).cast("double")), F.lit(1.0)).alias("webbing_fraction"))


def contamination(points: DataFrame, cameras: DataFrame, inside: Column, bottom: Column) -> DataFrame:
    """Per point (pid, x, y, z): views ahead of a camera, views inside the mask, and escapes at the bottom.

    ``cameras`` (cam, m, k, width, height) is a bounded dimension and is
    broadcast; each point row is expanded within its task and combined again
    without leaving it.  A point ahead of a camera counts as seen even outside
    its frame.
    """
    c = cameras.agg(F.collect_list(F.struct("cam", "m", "k", "width", "height")).alias("cams")).withColumn("__one", F.lit(1))
    p = points.withColumn("__one", F.lit(1)).join(F.broadcast(c), "__one").drop("__one")
    seen = F.transform("cams", lambda c: F.struct(project(F.col("x"), F.col("y"), F.col("z"), c["m"], c["k"]).alias("p"), c["width"].alias("width"), c["height"].alias("height")))
    p = p.withColumn("seen", F.filter(seen, lambda s: s["p"]["u"].isNotNull())).drop("cams")
    count = lambda test: F.size(F.filter("seen", test)).cast("bigint")
    return p.withColumns({"views": F.size("seen").cast("bigint"), "inside": count(inside), "escapes": count(lambda s: bottom(s) & ~inside(s))}).drop("seen")


def voxel_components(points: DataFrame, axes: list[str], bins: int = 12) -> DataFrame:
    """One row: occupied cells of a grid over the 1st to 99th percentiles, and the share of the largest 26-neighbour component."""
    q = points.agg(*[F.percentile(a, F.lit(p)).alias(f"__{a}{i}") for a in axes for i, p in enumerate((0.01, 0.99))]).withColumn("__one", F.lit(1))
    rows = points.withColumn("__one", F.lit(1)).join(F.broadcast(q), "__one")
    cell = [F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(a) - F.col(f"__{a}0")) / F.greatest(F.col(f"__{a}1") - F.col(f"__{a}0"), F.lit(1e-9)) * bins))).cast("bigint").alias(f"c{i}") for i, a in enumerate(axes)]
    cells = rows.select(*cell).distinct()
    code = lambda a, b, c: (a * bins + b) * bins + c
    ids = cells.select(code(F.col("c0"), F.col("c1"), F.col("c2")).alias("id"), "c0", "c1", "c2")
    steps = F.sequence(F.lit(-1), F.lit(1))
    near = ids.withColumn("d0", F.explode(steps)).withColumn("d1", F.explode(steps)).withColumn("d2", F.explode(steps)).select("id", *[(F.col(f"c{i}") + F.col(f"d{i}")).alias(f"n{i}") for i in range(3)]).where(" and ".join(f"n{i} between 0 and {bins - 1}" for i in range(3)))
    edges = near.select(F.col("id").alias("u"), code(F.col("n0"), F.col("n1"), F.col("n2")).alias("v")).where("u < v").join(ids.select(F.col("id").alias("v")), "v", "left_semi")
    found = components(edges)
    sizes = ids.join(found, F.col("id") == F.col("node"), "left").groupBy(F.coalesce("root", "id").alias("root")).count()
    return sizes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("cells"), F.count("*").alias("components"), F.coalesce(F.max("count") / F.sum("count"), F.lit(0.0)).alias("largest_fraction"))


def depth_consistency(pairs: DataFrame, limit: float = 0.01) -> DataFrame:
    """Per (ref, source): share of samples with a source depth, share within ``limit`` of relative difference 2|z - d| / (z + d), its median and p95."""
    rel = F.when((F.col("d") > 0) & (F.col("z") > 0), 2 * F.abs(F.col("z") - F.col("d")) / (F.col("z") + F.col("d")))
    p = pairs.withColumn("rel", rel)
    return p.groupBy("ref", "source").agg(F.avg(F.col("rel").isNotNull().cast("double")).alias("coverage"), F.coalesce(F.avg((F.col("rel") <= limit).cast("double")), F.lit(0.0)).alias("consistency"), F.percentile("rel", F.lit(0.5)).alias("median"), F.percentile("rel", F.lit(0.95)).alias("p95"))


def principal_axes(points: DataFrame, axes: list[str], by: list[str] | None = None) -> DataFrame:
    """Principal axes of each group: (values, vectors by rows), greatest first, each with a positive largest entry.

    The sums are plain aggregates; only the 3x3 matrix of each group goes to NumPy.
    """
    by = by or []
    sums = [F.count("*").alias("n"), *[F.avg(a).alias(f"m{i}") for i, a in enumerate(axes)]]
    sums += [F.avg(F.col(a) * F.col(b)).alias(f"s{i}{j}") for i, a in enumerate(axes) for j, b in enumerate(axes) if j >= i]

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        d = len(axes)
        for pdf in parts:
            values, vectors = [], []
            for _, r in pdf.iterrows():
                c = np.array([[r[f"s{min(i, j)}{max(i, j)}"] - r[f"m{i}"] * r[f"m{j}"] for j in range(d)] for i in range(d)], float)
                w, v = np.linalg.eigh(c)
                v = v[:, ::-1].T
                v *= np.sign(v[np.arange(d), np.abs(v).argmax(1)])[:, None]
                values.append(w[::-1].tolist())
                vectors.append(v.ravel().tolist())
            yield pdf[by].assign(values=values, vectors=vectors)

    g = points.groupBy(*by).agg(*sums)
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in g.schema if f.name in by)
    return g.mapInPandas(solve, kinds + "values array<double>, vectors array<double>")


def uv_polygon_areas(corners: DataFrame) -> DataFrame:
    """Shoelace area of each polygon from corners (polygon, k, u, v)."""
    from pyspark.sql import Window

    w = Window.partitionBy("polygon").orderBy("k")
    ring = Window.partitionBy("polygon").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nu, nv = F.coalesce(F.lead("u").over(w), F.first("u").over(ring)), F.coalesce(F.lead("v").over(w), F.first("v").over(ring))
    return corners.withColumn("t", F.col("u") * nv - nu * F.col("v")).groupBy("polygon").agg((F.abs(F.sum("t")) / 2).alias("area"))


def mask_fraction(points: DataFrame, mask: DataFrame) -> DataFrame:
    """Per image the share of points (image, x, y) whose nearest pixel, halves to even, is in the sparse mask (image, px, py); outside counts as unsupported."""
    p = points.withColumns({"px": F.rint("x").cast("bigint"), "py": F.rint("y").cast("bigint")})
    hit = p.join(mask.select("image", "px", "py", F.lit(1.0).alias("hit")), ["image", "px", "py"], "left")
    return hit.groupBy("image").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("fraction"), F.count("*").alias("points"))


def keypoints_in_mask(points: DataFrame, mask: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """Keypoints (image, idx, x, y) that are finite and whose cell (cut down) is in the mask and not in the boundary."""
    p = points.where(is_finite("x") & is_finite("y")).withColumns({"px": F.floor("x").cast("bigint"), "py": F.floor("y").cast("bigint")})
    p = p.join(mask.select("image", "px", "py").distinct(), ["image", "px", "py"], "left_semi")
    if boundary is not None:
        p = p.join(boundary.select("image", "px", "py"), ["image", "px", "py"], "left_anti")
    return p.drop("px", "py")


def band_evidence(points: DataFrame) -> DataFrame:
    """Number and supported share of points (h, supported) in each region; a region without points has zeros."""
    ok = F.coalesce(F.col("supported"), F.lit(False)).cast("double")
    regions = regions_table(points.sparkSession)
    found = points.join(F.broadcast(regions), F.col("h").between(F.col("low"), F.col("high"))).groupBy("region").agg(F.count("*").alias("point_count"), F.avg(ok).alias("supported_fraction"))
    return regions.join(found, "region", "left").fillna({"point_count": 0, "supported_fraction": 0.0})
