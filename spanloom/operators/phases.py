"""Ordered captures on rings: phases, circular neighbours, nearest phases, offsets and repeated cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E


def phase_frames(df: DataFrame, ring: str, order: list[Column], name: str, group: str | None = None) -> DataFrame:
    """(ring, name, pos, n, phase): position in the ring's order over its size.

    Members of one duplicate ``group`` share the phase of the first.  The name is the last sort key, so the order is total.
    """
    w = Window.partitionBy(ring)
    ordered = w.orderBy(*order, F.col(name))
    out = df.withColumns({"pos": (F.row_number().over(ordered) - 1).cast("bigint"), "n": F.count("*").over(w)})
    phase = F.col("pos") / F.col("n")
    if group:
        key = F.coalesce(F.nullif(F.col(group), F.lit("")), F.concat(F.lit("frame_"), F.col("pos").cast("string")))
        phase = F.min(phase).over(Window.partitionBy(ring, key))
    return out.select(F.col(ring).alias("ring"), F.col(name).alias("name"), "pos", "n", phase.alias("phase"))


def neighbour_pairs(frames: DataFrame, width: int) -> DataFrame:
    """Pairs of each frame with the next 1..width frames of its ring, around the end."""
    steps = frames.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(width)))).where("step <= n - 1")
    ahead = steps.select("ring", F.col("name").alias("first"), ((F.col("pos") + F.col("step")) % F.col("n")).alias("pos"))
    return ahead.join(frames.select("ring", "pos", F.col("name").alias("second")), ["ring", "pos"]).select("first", "second")


def nearest_phase(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each row of ``left`` (key, name, target) the row of ``right`` (key, name, phase, pos, n) of the same key at least circular distance, by name of equal ones.

    Targets and phases are sorted together once: the nearest phase is the one
    before or the one after, around the end, so no pair of rows is compared
    but these two.
    """
    cells = right.groupBy("key", "phase").agg(F.min(F.struct("name", "pos", "n")).alias("r"))
    cells = cells.select("key", F.col("phase").alias("at"), F.struct(F.col("phase"), F.col("r.name").alias("name"), F.col("r.pos").alias("pos"), F.col("r.n").alias("n")).alias("cell"), F.lit(None).cast(left.schema["name"].dataType).alias("left"))
    rows = left.select("key", F.col("target").alias("at"), F.lit(None).cast(cells.schema["cell"].dataType).alias("cell"), F.col("name").alias("left")).unionByName(cells)
    # At equal places the cell comes first and counts as before.
    order = Window.partitionBy("key").orderBy("at", F.col("cell").isNull())
    whole = Window.partitionBy("key")
    first, last = F.min("cell").over(whole), F.max("cell").over(whole)
    before = F.coalesce(F.last("cell", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), last)
    after = F.coalesce(F.first("cell", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)), first)
    near = rows.select("key", "at", "left", before.alias("b"), after.alias("a")).where("left is not null and b is not null")
    db, da = E.circular_distance("at", "b.phase"), E.circular_distance("at", "a.phase")
    pick = F.when(db < da, F.col("b")).when(da < db, F.col("a")).when(F.col("b.name") <= F.col("a.name"), F.col("b")).otherwise(F.col("a"))
    return near.select("key", F.col("left").alias("name"), pick.alias("near")).select("key", "name", F.col("near.name").alias("nearest"), F.col("near.pos").alias("pos"), F.col("near.n").alias("n"))


def cross_ring_pairs(frames: DataFrame, rings: DataFrame, neighbours: int = 1, offsets: DataFrame | None = None) -> DataFrame:
    """Pairs of each frame with the nearest phase of the next ring and ``neighbours`` frames on either side of it.

    ``rings`` (ring, ord) orders the rings; ``offsets`` (ring, offset) shifts the phases of a ring towards the next.
    """
    following = rings.select("ring", (F.col("ord") - 1).alias("ord"), F.col("ring").alias("next"))
    steps = rings.join(following.select("ord", "next"), "ord").select("ring", "next")
    left = frames.join(steps, "ring")
    shift = F.lit(0.0)
    if offsets is not None:
        left = left.join(offsets, "ring", "left")
        shift = F.coalesce("offset", F.lit(0.0))
    left = left.select(F.col("next").alias("key"), "name", E.normalize_phase(F.col("phase") + shift).alias("target"))
    right = frames.select(F.col("ring").alias("key"), "name", "phase", "pos", "n")
    near = nearest_phase(left, right)
    around = near.withColumn("d", F.explode(F.sequence(F.lit(-neighbours), F.lit(neighbours)))).select("key", F.col("name").alias("first"), F.pmod(F.col("pos") + F.col("d"), F.col("n")).alias("pos")).distinct()
    return around.join(frames.select(F.col("ring").alias("key"), "pos", F.col("name").alias("second")), ["key", "pos"]).select("first", "second")


def pair_schedule(frames: DataFrame, rings: DataFrame, *, same: int = 1, wider: int = 2, cross: int = 1, offsets: DataFrame | None = None) -> DataFrame:
    """The unordered pairs (a < b) of both rules, each once."""
    pairs = neighbour_pairs(frames, same + wider).unionByName(cross_ring_pairs(frames, rings, cross, offsets))
    return pairs.select(F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b")).where("a <> b").distinct()


def even_positions(n: Column, k: int) -> Column:
    """Distinct positions of an even sample of k of n, rounded half to even."""
    every = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i.cast("double") * (n - 1) / (k - 1)).cast("bigint"))
    return F.when(n <= k, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array_distinct(every)) if k > 1 else F.array(F.lit(0).cast("bigint"))


def even_positions_floor(n: Column, k: int) -> Column:
    """The same sample with places cut down to whole numbers."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i.cast("double") * (n - 1) / (k - 1)).cast("bigint"))) if k > 1 else F.array(F.lit(0).cast("bigint"))


def offset_votes(frames: DataFrame, steps: DataFrame, score: Column, *, offsets: int = 20, anchors: int = 8) -> DataFrame:
    """(left, right, offset, score): the median score of evenly spaced anchors with their nearest frame at each offset.

    ``frames`` (ring, name, pos, n, phase, and what ``score`` uses as struct
    ``v``); ``steps`` (left, right); ``score`` of columns lv and rv.
    """
    anchor = frames.where(F.array_contains(even_positions(F.col("n"), anchors), F.col("pos"))).select(F.col("ring").alias("left"), "name", "phase", F.col("v").alias("lv")).join(steps, "left")
    tries = anchor.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(offsets - 1))))
    tries = tries.withColumn("probe", F.struct("left", "right", "name", "o"))
    near = nearest_phase(tries.select(F.col("right").alias("key"), F.col("probe").alias("name"), E.normalize_phase(F.col("phase") + F.col("o") / float(offsets)).alias("target")), frames.select(F.col("ring").alias("key"), "name", "phase", "pos", "n"))
    values = frames.select(F.col("name"), F.col("v"))
    found = near.select("name.left", "name.right", F.col("name.name").alias("anchor"), "name.o", F.col("nearest"))
    found = found.join(values.select(F.col("name").alias("anchor"), F.col("v").alias("lv")), "anchor").join(values.select(F.col("name").alias("nearest"), F.col("v").alias("rv")), "nearest")
    return found.groupBy("left", "right", (F.col("o") / float(offsets)).alias("offset")).agg(F.percentile(score, F.lit(0.5)).alias("score"))


def best_offset(votes: DataFrame, margin: float = 0.0) -> DataFrame:
    """The best offset of each (left, right): greatest score, then least offset; with margin, confidence and ambiguity."""
    ranked = votes.withColumn("rank", F.row_number().over(Window.partitionBy("left", "right").orderBy(F.desc("score"), "offset"))).where("rank <= 2")
    both = ranked.groupBy("left", "right").agg(F.max(F.when(F.col("rank") == 1, F.col("offset"))).alias("offset"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    gap = F.col("best") - F.coalesce("second", F.lit(0.0))
    sure = F.when((F.col("best") == 0) & (F.coalesce("second", F.lit(0.0)) == 0), 1.0).otherwise(F.greatest(F.lit(0.0), gap) / F.greatest(F.abs("best"), F.lit(1e-9)))
    return both.select("left", "right", "offset", "best", gap.alias("margin"), sure.alias("confidence"), F.coalesce(gap <= margin if margin else gap < margin, F.lit(False)).alias("ambiguous"))


def cycle_splits(frames: DataFrame, *, ring: str = "ring", pos: str = "pos", signature: str = "sig") -> DataFrame:
    """(ring, n, split, score) of each candidate split of a ring of 100 frames or more.

    A split's score is the mean signature distance of two windows: the first
    frames with those from the split on, and the last frames with those as far
    before the split's end.  As a split is at 35 or later and a window has 12
    frames at most, the second window always fits.
    """
    n = F.count("*").over(Window.partitionBy(ring))
    f = frames.select(F.col(ring).alias("ring"), F.col(pos).alias("pos"), F.col(signature).alias("sig"), n.alias("n")).where("n >= 100")
    least = F.greatest(F.lit(30), F.rint(F.col("n") * 0.30))
    rows = f.withColumns({"low": F.greatest(least, F.rint(F.col("n") * 0.35)).cast("bigint"), "high": F.least(F.col("n") - least, F.rint(F.col("n") * 0.75)).cast("bigint"), "w": F.greatest(F.lit(5), F.least(F.lit(12), F.floor(F.col("n") / 16))).cast("bigint")})
    head = rows.where("pos < w").withColumns({"i": F.col("pos"), "part": F.lit("head")})
    tail = rows.where("pos >= n - w").withColumns({"i": F.col("pos") - (F.col("n") - F.col("w")), "part": F.lit("tail")})
    tries = head.unionByName(tail).where("low <= high").withColumn("split", F.explode(F.sequence("low", "high"))).where("split + w < n")
    other = F.when(F.col("part") == "head", F.col("split") + F.col("i")).otherwise(F.col("split") - F.col("w") + F.col("i"))
    tries = tries.select("ring", "n", "split", "part", F.col("sig").alias("a"), other.alias("pos")).where("pos >= 0 and pos < n")
    d = tries.join(f.select("ring", "pos", F.col("sig").alias("b")), ["ring", "pos"]).withColumn("d", E.mean_abs_difference("a", "b"))
    sums = d.groupBy("ring", "n", "split").agg(F.avg(F.when(F.col("part") == "head", F.col("d"))).alias("h"), F.avg(F.when(F.col("part") == "tail", F.col("d"))).alias("t"))
    return sums.select("ring", "n", "split", ((F.col("h") + F.col("t")) / 2).alias("score"))


def repeated_cycle(splits: DataFrame) -> DataFrame:
    """The best split of each ring and whether it is a repeated cycle: clearly below the median score and apart from the next best."""
    ranked = splits.withColumn("rank", F.row_number().over(Window.partitionBy("ring").orderBy("score", "split")))
    g = ranked.groupBy("ring", "n").agg(F.max(F.when(F.col("rank") == 1, F.col("split"))).alias("split"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.percentile("score", F.lit(0.5)).alias("baseline"))
    second = F.coalesce("second", "baseline")
    relative = F.col("best") / F.greatest("baseline", F.lit(1e-9))
    apart = F.greatest(F.lit(0.0), (second - F.col("best")) / F.greatest(second, F.lit(1e-9)))
    sure = E.clip((1 - relative) * 0.7 + apart * 0.3, 0.0, 1.0)
    return g.select("ring", "n", "split", "best", "baseline", relative.alias("relative"), apart.alias("separation"), sure.alias("confidence"), ((relative <= 0.72) & (apart >= 0.05)).alias("repeated"))
