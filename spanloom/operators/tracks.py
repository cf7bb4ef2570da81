"""Tracks from verified match rows: conflict-aware components, disjoint allocation by pair, triangulation, and support of tracks by the rows.

Match rows are (pair_id, i1, k1, i2, k2): keypoint k1 of image i1 and k2 of i2.
What depends on an order is done in it, but only among rows that can contradict
each other: connected parts are found with joins, parts in which no image is
there twice need no order, and each of the others is one Arrow group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..scratch import materialize, small_side
from .components import components, near_components

#: Fixed value: a track of more observations is rejected.
MOST_OBSERVATIONS = 372
ORDERS = ("pair_id", "strongest", "priority")
#: Images that meet in at most this many candidates are one group; larger ones are split further.
SMALL_GROUP = 20_000


def _ends(rows: DataFrame, *keep: Column | str) -> DataFrame:
    return rows.select(*keep, E.observation_id("i1", "k1").alias("u"), E.observation_id("i2", "k2").alias("v"))


def _union(rows: Iterable[tuple[int, int]]) -> tuple[dict[int, int], int, int]:
    """Parent of each observation after joining (u, v) in order, the joins made, and those refused as two observations of one image would meet."""
    parent: dict[int, int] = {}
    images: dict[int, set[int]] = {}

    def find(x: int) -> int:
        if x not in parent:
            parent[x], images[x] = x, {x >> 32}
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    made = refused = 0
    for u, v in rows:
        a, b = find(u), find(v)
        if a == b:
            continue
        if not images[a].isdisjoint(images[b]):
            refused += 1
            continue
        if len(images[a]) < len(images[b]):
            a, b = b, a
        parent[b] = a
        images[a] |= images.pop(b)
        made += 1
    return {x: find(x) for x in list(parent)}, made, refused


def track_components(rows: DataFrame, *, order: str = "pair_id", priority: DataFrame | None = None, most: int = MOST_OBSERVATIONS) -> tuple[DataFrame, DataFrame]:
    """Tracks (track, image, keypoint), and one row on how they came about.

    Rows are joined in the order of their pair (by id; by number of rows, most
    first; or those of ``priority`` (pair_id) first and then so) and of k1 and
    k2.  A row that would bring two observations of an image into one track is
    refused.  Tracks are named after their least observation; those of one or
    of more than ``most`` observations are left out.

    The row: match_rows, merges, refused, components, tracks, short, large.
    """
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")
    ends = materialize(_ends(rows, "pair_id"), "ends")
    # A row whose ends are one and the same joins nothing, but its observation is there.
    lone = ends.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    found = near_components(ends, "u", "v")
    nodes = materialize(found.unionByName(lone.join(found, "node", "left_anti").distinct()), "nodes")
    image = F.shiftright("node", 32)
    parts = nodes.groupBy("root").agg(F.count("*").alias("n"), F.count_distinct(image).alias("images"))
    contested = materialize(parts.where("images < n").select("root"), "contested")
    clean = nodes.join(contested, "root", "left_anti").select(F.col("root").alias("part"), "node")

    schema = pa.schema([(c, pa.int64()) for c in ("part", "node", "made", "refused")])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int]]:
        rows = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("root", "u", "v"))))
        for _, group in groupby(rows, itemgetter(0)):
            names, made, refused = _union(row[1:] for row in group)
            least: dict[int, int] = {}
            for node, top in names.items():
                least[top] = min(node, least.get(top, node))
            for node, top in names.items():
                yield least[top], node, made, refused
                made = refused = 0

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = chosen(batches)
        while some := list(islice(out, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some)], schema=schema)

    fought = ends.join(nodes.join(contested, "root", "left_semi").withColumnRenamed("node", "u"), "u")
    # Keypoints are the low half of an observation.
    key = [F.col("pair_id"), *[F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)) for c in "uv"]]
    if order != "pair_id":
        fought = fought.join(ends.groupBy("pair_id").agg(F.count("*").alias("strength")), "pair_id")
        key = [F.desc("strength"), *key]
        if order == "priority" and priority is not None:
            fought = fought.join(small_side(priority.select("pair_id", F.lit(1).alias("first")).distinct()), "pair_id", "left")
            key = [F.coalesce("first", F.lit(0)).desc(), *key]
    fought = fought.repartition("root").sortWithinPartitions("root", *key).select("root", "u", "v")
    dealt = materialize(fought.mapInArrow(choose, "part bigint, node bigint, made bigint, refused bigint"), "chosen")
    every = materialize(clean.unionByName(dealt.select("part", "node")), "tracks")
    size = every.groupBy("part").agg(F.count("*").alias("n"))
    good = size.where(F.col("n").between(2, most)).select("part")
    tracks = every.join(good, "part", "left_semi").select(F.col("part").alias("track"), F.shiftright("node", 32).alias("image"), F.col("node").bitwiseAND(F.lit(0xFFFFFFFF)).alias("keypoint"))
    one = lambda df: df.withColumn("one", F.lit(1))
    joined = parts.join(contested, "root", "left_anti").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("easy"))
    fights = dealt.agg(F.coalesce(F.sum("made"), F.lit(0)).alias("hard"), F.coalesce(F.sum("refused"), F.lit(0)).alias("refused"))
    sizes = size.agg(F.count("*").alias("components"), F.count_if(F.col("n").between(2, most)).alias("tracks"), F.count_if(F.col("n") < 2).alias("short"), F.count_if(F.col("n") > most).alias("large"))
    row = one(ends.agg(F.count("*").alias("match_rows"))).join(one(joined), "one").join(one(fights), "one").join(one(sizes), "one")
    return tracks, row.select("match_rows", (F.col("easy") + F.col("hard")).alias("merges"), "refused", "components", "tracks", "short", "large")


def pair_tracks(candidates: DataFrame, *, least: int = 20, most: int = 40) -> DataFrame:
    """(pair_id, k1, k2) of two-view tracks, no two pairs sharing an observation, out of candidates (pair_id, i1, k1, i2, k2, error).

    Pairs with the fewest candidates come first, then by id; a pair takes its
    candidates of least error (then k1 and k2) whose observations are free, at
    most ``most``; with fewer than ``least`` it takes none.  Free means of other
    pairs: candidates of one pair that share an observation are all taken.
    """
    c = candidates.select("pair_id", "error", "k1", "k2", "i1", "i2")
    enough = c.groupBy("pair_id").agg(F.count("*").alias("n"), F.min("i1").alias("first")).where(F.col("n") >= least)
    c = materialize(c.join(enough, "pair_id"), "candidates")
    # Pairs that meet in no image share no observation: few links tell most of them apart.
    met = c.select("i1", "i2").unionByName(c.select("i1", F.col("first").alias("i2"))).where("i1 <> i2").distinct()
    images = components(met, "i1", "i2").withColumnRenamed("root", "around")
    lone = c.where("i1 = i2").select(F.col("i1").alias("node")).distinct().join(images, "node", "left_anti").select("node", F.col("node").alias("around"))
    c = materialize(c.join(images.unionByName(lone).withColumnRenamed("node", "i1"), "i1"), "around")
    large = materialize(c.groupBy("around").agg(F.count("*").alias("size")).where(F.col("size") > SMALL_GROUP).select("around"), "large")
    small = c.join(large, "around", "left_anti").withColumn("part", F.col("around"))
    # Only in the large groups pairs and observations are one graph: pairs get the negative numbers.
    many = c.join(large, "around", "left_semi")
    links = many.select((-F.col("pair_id") - 1).alias("p"), F.explode(F.array(E.observation_id("i1", "k1"), E.observation_id("i2", "k2"))).alias("o"))
    found = components(links, "p", "o")
    rest = many.join(found.select((-F.col("node") - 1).alias("pair_id"), F.col("root").alias("part")).where("pair_id >= 0"), "pair_id")
    keep = ["part", "n", "pair_id", "error", "k1", "k2", E.observation_id("i1", "k1").alias("u"), E.observation_id("i2", "k2").alias("v")]
    # Roots of observations may be numbers of images too, so the two kinds stay apart.
    dealt = small.select(F.lit(0).alias("kind"), *keep).unionByName(rest.select(F.lit(1).alias("kind"), *keep))
    worst = F.coalesce(F.col("error").cast("double"), F.lit(float("nan")))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: set[int] = set()
        at = pair = None
        mine: list[tuple[int, int, int, int, int]] = []
        out: list[tuple[int, int, int, int, int]] = []

        def settle() -> None:
            if len(mine) >= least:
                for m in mine:
                    used.update(m[3:])
                out.extend(mine)
            mine.clear()

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([m[i] for m in out], pa.int64()) for i in range(3)], names=["pair_id", "k1", "k2"])
            out.clear()
            return batch

        for batch in batches:
            for kind, part, p, k1, k2, u, v in zip(*(batch[c].to_pylist() for c in ("kind", "part", "pair_id", "k1", "k2", "u", "v")), strict=True):
                if p != pair or (kind, part) != at:
                    settle()
                    if (kind, part) != at:
                        used.clear()
                    at, pair = (kind, part), p
                if len(mine) < most and u not in used and v not in used:
                    mine.append((p, k1, k2, u, v))
            yield made()
        settle()
        yield made()

    dealt = dealt.repartition("kind", "part").sortWithinPartitions("kind", "part", "n", "pair_id", worst, "k1", "k2")
    return dealt.select("kind", "part", "pair_id", "k1", "k2", "u", "v").mapInArrow(take, "pair_id bigint, k1 bigint, k2 bigint")


def triangulate(matches: DataFrame, *, most_error: float | None = None) -> DataFrame:
    """``matches`` with x, y, z and error: the point that two views see, and the greater of its distances from the two observations in pixels.

    Columns of matches: m1 and m2 (3x4 poses by rows), l1 and l2 (fx, fy, cx,
    cy), u1, v1, u2 and v2.  The error is infinite if the point is at infinity
    or behind a view; with ``most_error`` only better ones are kept.
    """
    names = [f.name for f in matches.schema]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            of = lambda c, k: batch[c].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, k)
            pose = [of("m1", 12).reshape(n, 3, 4), of("m2", 12).reshape(n, 3, 4)]
            lens = [of("l1", 4), of("l2", 4)]
            seen = [np.stack([batch[f"{a}{i}"].to_numpy(zero_copy_only=False).astype(float) for a in "uv"], 1) for i in (1, 2)]
            system = []
            for p, k, s in zip(pose, lens, seen):
                ray = (s - k[:, 2:]) / k[:, :2]
                system += [ray[:, :1] * p[:, 2] - p[:, 0], ray[:, 1:] * p[:, 2] - p[:, 1]]
            system = np.stack(system, 1)
            whole = np.isfinite(system).all((1, 2))
            h = np.linalg.svd(np.where(whole[:, None, None], system, 0.0))[2][:, -1]
            whole &= np.abs(h[:, 3]) > 1e-12
            xyz = np.where(whole[:, None], h[:, :3] / np.where(whole, h[:, 3], 1.0)[:, None], np.nan)
            error = np.zeros(n)
            for p, k, s in zip(pose, lens, seen):
                cam = np.einsum("nij,nj->ni", p[:, :, :3], xyz) + p[:, :, 3]
                ahead = cam[:, 2] > 0
                shown = k[:, :2] * cam[:, :2] / np.where(ahead, cam[:, 2], 1.0)[:, None] + k[:, 2:]
                error = np.maximum(error, np.where(ahead, np.linalg.norm(shown - s, axis=1), np.inf))
            error = np.where(np.isfinite(error), error, np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.where(np.isfinite(error), xyz[:, i], np.nan)) for i in range(3)), pa.array(error)], names=[*names, "x", "y", "z", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in matches.schema)
    out = matches.mapInArrow(solve, f"{kinds}, x double, y double, z double, error double")
    return out if most_error is None else out.where(F.col("error") <= most_error)


def best_observations(observations: DataFrame, *, least: int = 3) -> DataFrame:
    """Of each track and image of observations (track, image, keypoint, error) the one of least error, then keypoint; tracks of fewer than ``least`` images go.

    An error that isn't finite is the greatest.
    """
    error = F.when(E.is_finite("error"), F.col("error")).otherwise(F.lit(float("inf")))
    best = observations.groupBy("track", "image").agg(F.min(F.struct(error.alias("error"), "keypoint")).alias("b")).select("track", "image", "b.keypoint", "b.error")
    enough = best.groupBy("track").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("track")
    return best.join(enough, "track", "left_semi")


def track_support(observations: DataFrame, rows: DataFrame) -> DataFrame:
    """(track, images, support, connected) of observations (track, image, keypoint): how many match rows lie within a track, and whether they connect all its images.

    Rows meet a track by their ends, so the work grows with the rows and not
    with the pairs within a track.  A row that is there twice counts once.
    """
    own = observations.select("track", "image", E.observation_id("image", "keypoint").alias("o")).distinct()
    ends = _ends(rows).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    # An observation may be in many tracks: their lists meet, not a row for each of them.
    of = own.groupBy("o").agg(F.collect_set("track").alias("in"), F.first("image").alias("image"))
    first = ends.join(of.select(F.col("o").alias("u"), F.col("in").alias("in_u"), F.col("image").alias("a")), "u")
    both = first.join(of.select(F.col("o").alias("v"), F.col("in").alias("in_v"), F.col("image").alias("b")), "v").where("a <> b")
    within = materialize(both.select(F.explode(F.array_intersect("in_u", "in_v")).alias("track"), "a", "b"), "within")
    node = lambda c: F.concat_ws("|", F.col("track").cast("string"), F.col(c).cast("string"))
    found = near_components(within.repartition("track", F.pmod(F.xxhash64("a"), F.lit(8))).select(node("a").alias("u"), node("b").alias("v")))
    images = own.select("track", "image").distinct().withColumn("node", node("image"))
    parts = images.join(found, "node", "left").groupBy("track").agg(F.count("*").alias("images"), F.count_distinct(F.coalesce("root", "node")).alias("parts"))
    support = within.groupBy("track").agg(F.count("*").alias("support"))
    return parts.join(support, "track", "left").select("track", "images", F.coalesce("support", F.lit(0)).alias("support"), (F.col("parts") == 1).alias("connected"))
