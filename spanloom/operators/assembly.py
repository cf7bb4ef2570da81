"""Graphs put together from verified pairs, tiles to do again, and continuity of depth between rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..scratch import materialize, small_side
from .cloud import depth_consistency, project
from .components import components
from .evidence import with_ends
from .gates import transition_gate
from .graph import INLIER, OUTLIER, capped_matching, spanning_bridges
from .rotation import SAME


def corrected_graph(pairs: DataFrame, meta: DataFrame, ring_order: list[str] | None = None, *, same_ring_inliers: int = 80, cross_ring_inliers: int = 50, window: int = 4, most_cross: int = 2) -> DataFrame:
    """Pairs (pair_id, first, second, inliers) with their rings, selected and the reason why.

    ``meta`` has name, ring and frame; pairs of an unknown image go.  Pairs of
    one ring are selected if they are strong, near and no near duplicates;
    pairs across rings if strong, of neighbouring rings in ``ring_order`` (if
    there is one), strongest first, at most ``most_cross`` of an image.  Then
    neighbouring rings that no pair joins get their strongest one anyway.
    """
    met = with_ends(pairs.select("pair_id", "first", "second", "inliers"), meta.select("name", "ring", "frame"))
    same = F.col("first_ring") == F.col("second_ring")
    far = F.when(same, F.abs(F.col("first_frame") - F.col("second_frame")))
    good = ~E.is_near_duplicate_name("first", "second") & (far <= window) & (F.col("inliers") >= same_ring_inliers)
    met = materialize(met.select("pair_id", "first", "second", "first_ring", "second_ring", "inliers", same.alias("same_ring"), far.alias("frame_distance"), F.coalesce(good, F.lit(False)).alias("near")), "candidates")
    order = list(ring_order or [])
    place = F.create_map(*[F.lit(x) for i, r in enumerate(order) for x in (r, i)]) if order else None
    beside = F.coalesce(F.abs(place[F.col("first_ring")] - place[F.col("second_ring")]) == 1, F.lit(False)) if order else F.lit(True)
    strong = met.where(~F.col("same_ring") & (F.col("inliers") >= cross_ring_inliers)).withColumn("beside", beside)
    picked = materialize(capped_matching(strong.select("pair_id", F.col("first").alias("a"), F.col("second").alias("b"), "inliers", F.col("beside").alias("adjacent")), most=most_cross), "picked")
    out = met.join(picked.withColumnRenamed("reason", "pick"), "pair_id", "left")
    if order:
        boundary = strong.where("beside").withColumn("at", F.least(place[F.col("first_ring")], place[F.col("second_ring")]))
        found = boundary.join(picked, "pair_id").groupBy("at").agg(F.max(F.col("reason") == "selected").alias("any"), F.max(F.struct("inliers", "first", "second", "pair_id")).alias("best"))
        rescue = found.where("not any").select(F.col("best.pair_id").alias("pair_id"), F.lit(True).alias("rescue"))
        out = out.join(small_side(rescue), "pair_id", "left")
    else:
        out = out.withColumn("rescue", F.lit(None).cast("boolean"))
    reason = (
        F.when(F.col("same_ring") & F.col("near"), "same_ring_local_verified").when(F.col("same_ring"), "same_ring_duplicate_or_weak_or_nonlocal").when(F.col("rescue"), "boundary_bridge_rescue")
        .when(F.col("pick") == "selected", "cross_ring_verified_support_pending_cap").when(F.col("pick") == "per_image_cap", "cross_ring_per_image_cap").when(F.col("pick").isNotNull(), F.col("pick")).otherwise("cross_ring_weak_verified_support")
    )
    chosen = F.when(F.col("same_ring"), F.col("near")).otherwise(F.coalesce(F.col("rescue") | (F.col("pick") == "selected"), F.col("pick") == "selected", F.lit(False)))
    return out.select("pair_id", "first", "second", "first_ring", "second_ring", "same_ring", "frame_distance", "inliers", chosen.alias("selected"), reason.alias("reason"))


def mapper_graph(records: DataFrame, consensus: DataFrame) -> DataFrame:
    """``records`` (pair_id, first, second, inliers, tri_angle, homography) with kind: ``base``, ``bridge`` or ``excluded``.

    ``consensus`` (first, second, status) says which pairs are kept; of its
    outliers only those come in that join parts which nothing else does,
    strongest first.  A pair that is there twice, one that the consensus lacks
    or has with another status, and a graph that stays in parts are errors.
    """
    key = ["first", "second"]
    repeated = [n for n, t in (("records", records), ("consensus", consensus)) if not t.groupBy(*key).count().where("count > 1").isEmpty()]
    if repeated:
        raise ValueError(f"{repeated[0]} have an image pair more than once")
    met = materialize(records.join(consensus.select(*key, "status"), key, "left"), "records")
    odd = met.where(~F.coalesce(F.col("status").isin(SAME, INLIER, OUTLIER), F.lit(False))).limit(1).collect()
    if odd:
        raise ValueError(f"pair {odd[0]['first']!r}, {odd[0]['second']!r} has consensus status {odd[0].status!r}")
    edges = met.select("pair_id", F.col("first").alias("a"), F.col("second").alias("b"), (F.col("status") != OUTLIER).alias("base"), "inliers", "tri_angle", "homography")
    chosen = materialize(edges.join(spanning_bridges(edges), "pair_id").select("pair_id", "a", "b", F.when(F.col("base"), "base").when(F.col("selected"), "bridge").otherwise("excluded").alias("kind")), "chosen")
    # Bridges join whatever all pairs together join, so it's enough to look at these.
    parts = components(edges, "a", "b").agg(F.count_distinct("root")).first()[0]
    if parts > 1:
        raise ValueError(f"{parts} parts remain")
    return records.join(chosen.select("pair_id", "kind"), "pair_id")


def affected_tiles(images: DataFrame, sources: DataFrame, changed: DataFrame, *, size: int = 24) -> DataFrame:
    """A row for each tile of ``size`` consecutive images (name, pos from 0): what of it changed, itself or what it depends on.

    A tile depends on its images and on their ``sources`` (ref, source);
    ``changed`` (name) are the images to be done again.  Lists are in the order
    of the images; tile, start, images, changed_images, changed_dependencies
    and affected.
    """
    own = images.select("name", "pos", F.floor(F.col("pos") / size).alias("tile"))
    base = own.groupBy("tile").agg(F.min("pos").alias("start"), F.count("*").alias("images"))
    mine = own.select("tile", "name", F.lit(True).alias("own"))
    others = sources.join(own.select(F.col("name").alias("ref"), "tile"), "ref").select("tile", F.col("source").alias("name"), F.lit(False).alias("own"))
    needed = mine.unionByName(others).join(changed.select("name").distinct(), "name", "left_semi")
    needed = needed.groupBy("tile", "name").agg(F.max("own").alias("own")).join(own.select("name", "pos"), "name")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["name"])
    at = F.struct("pos", "name")
    lists = needed.groupBy("tile").agg(in_order(F.when(F.col("own"), at)).alias("changed_images"), in_order(at).alias("changed_dependencies"))
    none = F.array().cast("array<string>")
    return base.join(lists, "tile", "left").select("tile", "start", "images", F.coalesce("changed_images", none).alias("changed_images"), F.coalesce("changed_dependencies", none).alias("changed_dependencies"), F.col("changed_dependencies").isNotNull().alias("affected"))


# Continuity of depth -----------------------------------------------------------


def _spread(n: Column, most: int) -> Column:
    """The positions of at most ``most`` of n rows, evenly from the first to the last, cut down to whole numbers."""
    k = F.least(n, F.lit(most)).cast("int")
    step = F.when(k > 1, (n - 1) / (k - 1)).otherwise(0.0)
    at = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.when((j > 0) & (j == k - 1), n - 1).otherwise(F.floor(j * step)).cast("bigint"))
    return F.when(n > 0, F.array_distinct(at)).otherwise(F.array().cast("array<bigint>"))


def spread_edges(edges: DataFrame, most: int = 4) -> DataFrame:
    """(ring, source_ring, ref, source, pairs) of edges (ref, source, ring, source_ring) across rings: at most ``most`` of each directed transition, evenly over their sorted names."""
    cross = edges.where("ring <> source_ring")
    w = Window.partitionBy("ring", "source_ring")
    ranked = cross.withColumns({"at": (F.row_number().over(w.orderBy("ref", "source")) - 1).cast("bigint"), "pairs": F.count("*").over(w)})
    return ranked.where(F.array_contains(_spread(F.col("pairs"), most), F.col("at"))).select("ring", "source_ring", "ref", "source", "pairs")


def spread_pixels(depth: DataFrame, most: int = 600) -> DataFrame:
    """At most ``most`` pixels of each image of depth (image, x, y, depth), evenly in raster order.

    A pixel's place is the number of pixels in the rows above it and its place
    in its row, so that no task puts an image in order.
    """
    rows = depth.groupBy("image", "y").agg(F.count("*").alias("n"))
    w = Window.partitionBy("image").orderBy("y")
    above = rows.select("image", "y", (F.sum("n").over(w) - F.col("n")).alias("above"), F.sum("n").over(Window.partitionBy("image")).alias("all"))
    at = F.col("above") + F.row_number().over(Window.partitionBy("image", "y").orderBy("x")) - 1
    wanted = above.select("image", "all").distinct().select("image", F.explode(_spread(F.col("all"), most)).alias("at"))
    return depth.join(above, ["image", "y"]).withColumn("at", at).join(small_side(wanted), ["image", "at"]).select("image", "x", "y", "depth")


def depth_pairs(edges: DataFrame, depth: DataFrame, cameras: DataFrame, *, most: int = 600, limit: float = 0.01) -> DataFrame:
    """``edges`` (ref, source, ...) with sampled, overlap, coverage, consistency, median, p95 and status.

    ``depth`` (image, x, y, depth, inside) are the pixels of the depth maps,
    those with ``inside`` in the mask; ``cameras`` (image, m, k) with a rotation in m.
    Pixels of the reference are taken evenly, put in space by their depth, and
    met with the source's depth at the nearest pixel, half to even.
    """
    good = materialize(depth.where(E.is_finite("depth") & (F.col("depth") > 0) & F.col("inside")).select("image", "x", "y", "depth"), "depth")
    lens = cameras.select("image", "m", "k")
    seen = spread_pixels(good.join(edges.select(F.col("ref").alias("image")).distinct(), "image", "left_semi"), most)
    key = edges.select("ref", "source").distinct()
    met = key.join(seen.withColumnRenamed("image", "ref"), "ref").join(small_side(lens.select(F.col("image").alias("ref"), F.col("m").alias("ma"), F.col("k").alias("ka"))), "ref").join(small_side(lens.select(F.col("image").alias("source"), F.col("m").alias("mb"), F.col("k").alias("kb"))), "source")
    k, m, d = F.col("ka"), F.col("ma"), F.col("depth")
    ray = [(F.col("x") - k[2]) / k[0] * d, (F.col("y") - k[3]) / k[1] * d, d]
    away = [ray[i] - m[4 * i + 3] for i in range(3)]
    met = met.select("ref", "source", "mb", "kb", F.inline(F.array(F.struct(*[sum((m[4 * i + j] * away[i] for i in range(1, 3)), m[j] * away[0]).alias(f"w{j}") for j in range(3)]))))
    met = met.select("ref", "source", F.inline(F.array(project(F.col("w0"), F.col("w1"), F.col("w2"), F.col("mb"), F.col("kb")))))
    met = met.select("ref", "source", "z", F.rint("u").cast("bigint").alias("x"), F.rint("v").cast("bigint").alias("y"))
    hit = met.join(good.select(F.col("image").alias("source"), "x", "y", F.col("depth").alias("d")), ["source", "x", "y"], "left")
    hit = materialize(hit.select("ref", "source", "z", "d"), "hits")
    figures = depth_consistency(hit, limit)
    counts = hit.groupBy("ref", "source").agg(F.count("*").alias("sampled"), F.count("d").alias("overlap"))
    maps = depth.select("image").distinct()
    usable = good.select("image").distinct()
    there = lambda side, t, c: t.select(F.col("image").alias(side), F.lit(True).alias(c))
    out = edges.join(counts, ["ref", "source"], "left").join(figures, ["ref", "source"], "left").join(there("ref", maps, "has_ref"), "ref", "left").join(there("source", maps, "has_source"), "source", "left").join(there("ref", usable, "usable"), "ref", "left")
    status = F.when(F.col("has_ref").isNull() | F.col("has_source").isNull(), "depth_map_missing").when(F.col("usable").isNull(), "reference_depth_has_no_valid_pixels").when(F.coalesce("overlap", F.lit(0)) == 0, "no_cross_view_overlap").otherwise("measured")
    done = status == "measured"
    return out.select(*edges.columns, F.coalesce("sampled", F.lit(0)).alias("sampled"), F.coalesce("overlap", F.lit(0)).alias("overlap"), *[F.when(done, F.col(c)).alias(c) for c in ("coverage", "consistency", "median", "p95")], status.alias("status"))


def ring_transitions(edges: DataFrame, depth: DataFrame, cameras: DataFrame, *, most_pairs: int = 4, most_pixels: int = 600) -> DataFrame:
    """A row for each directed transition between rings: pairs, selected_pairs, measured_pairs, mean_coverage, mean_consistency, and the judgement of ``gates.transition_gate``."""
    measured = depth_pairs(spread_edges(edges, most_pairs), depth, cameras, most=most_pixels)
    good = F.col("status") == "measured"
    mean = lambda c: F.coalesce(F.avg(F.when(good, F.col(c))), F.lit(0.0))
    rows = measured.groupBy("ring", "source_ring", "pairs").agg(F.count("*").alias("selected_pairs"), F.count_if(good).alias("measured_pairs"), mean("coverage").alias("mean_coverage"), mean("consistency").alias("mean_consistency"))
    figures = rows.select("ring", "source_ring", "pairs", F.struct("selected_pairs", "measured_pairs", "mean_coverage", "mean_consistency").alias("f"), "selected_pairs", "measured_pairs", "mean_coverage", "mean_consistency")
    judged = transition_gate(figures)
    return judged.select("ring", "source_ring", "pairs", "f.*", "status", "diagnostic_status", "acceptance_basis")
