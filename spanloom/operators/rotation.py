"""Repair of camera rotations: consensus over rings, alignment to a reference, and re-attachment of islands.

Rotations are row-major arrays of nine doubles; a record's rotation takes the
first image's camera to the second's.  Whatever is of one ring's images is one
Arrow group; joins over images and edges are plain columns; islands are joined
by a maximum spanning tree in Boruvka rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..scratch import materialize, small_side
from .components import components
from .graph import INLIER, OUTLIER, dealt_votes, distances, mean_rotation, own_blocks, ring_orientations, transition_consensus

SAME, UNUSED = "retained_rotation_synchronization", "retained_negative_or_unconditioned_evidence"


def _same_ring_edges(records: DataFrame) -> DataFrame:
    good = records.where("same_ring and rotation is not null")
    return good.select("ring", F.col("first").alias("a"), F.col("second").alias("b"), "rotation", F.col("inliers"), F.coalesce("conditioned", F.lit(False)).alias("conditioned"))


def _relative(first: Column, second: Column) -> Column:
    """From the first camera to the second, of two orientations."""
    return E.matmul(second, E.transpose(first))


def _with_both(edges: DataFrame, rotations: DataFrame, names: tuple[str, str]) -> DataFrame:
    """``edges`` (first, second, ...) with the rotations (name, rotation) of both ends under ``names``; edges that lack one go."""
    for side, name in zip(("first", "second"), names, strict=True):
        edges = edges.join(rotations.select(F.col("name").alias(side), F.col("rotation").alias(name)), side)
    return edges


def rotation_consensus(records: DataFrame, ring_order: list[str], *, threshold: float = 10.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orientations (name, ring, rotation), edges (pair_id, first, second, edge_type, conditioned, residual, status) and transitions.

    ``records``: pair_id, first, second, ring, second_ring, same_ring, rotation,
    inliers, conditioned.  Each ring is synchronized by itself; the conditioned
    pairs between neighbours in ``ring_order`` vote for the turn between two
    rings, and the turns are chained along the order.  No record is dropped
    from the edges for its residual.  A ring outside the order, or neighbours
    without votes, are errors.
    """
    place = F.create_map(*[F.lit(x) for i, r in enumerate(ring_order) for x in (r, i)])
    strays = records.select(F.explode(F.array("ring", "second_ring")).alias("r")).where(~F.coalesce(F.col("r").isin(*ring_order), F.lit(False))).limit(1).collect()
    if strays:
        raise ValueError(f"ring order omits {strays[0].r!r}")
    records = records.withColumn("conditioned", F.coalesce("conditioned", F.lit(False)))
    usable = records.where("rotation is not null")
    local = materialize(ring_orientations(_same_ring_edges(records)).select("name", "ring", "rotation"), "local")
    inner = usable.where("ring = second_ring").select("pair_id", "first", "second", "conditioned", "rotation")
    inner = _with_both(inner, local.withColumnRenamed("ring", "lring"), ("r1", "r2")).select("pair_id", "first", "second", F.lit("same_ring").alias("edge_type"), "conditioned", E.geodesic_deg(F.col("r2"), E.matmul("rotation", "r1")).alias("residual"), F.lit(SAME).alias("status"))

    across = usable.where("ring <> second_ring and conditioned")
    votes = _with_both(across, local, ("r1", "r2"))
    ahead = place[F.col("ring")] < place[F.col("second_ring")]
    turn = E.matmul(E.matmul(E.transpose("r2"), "rotation"), "r1")
    votes = votes.select(F.when(ahead, place[F.col("ring")]).otherwise(place[F.col("second_ring")]).alias("at"), F.abs(place[F.col("ring")] - place[F.col("second_ring")]).alias("step"), F.when(ahead, turn).otherwise(E.transpose(turn)).alias("rotation"), F.greatest(F.coalesce(F.col("inliers").cast("double"), F.lit(1.0)), F.lit(1.0)).alias("weight"), F.col("first").alias("a"), F.col("second").alias("b"))
    votes = votes.where("step = 1").select(F.col("at").cast("string").alias("transition"), "rotation", "weight", "a", "b")
    transitions = materialize(transition_consensus(votes, threshold=threshold), "transitions")

    # One row for each two neighbours in the order, which is a parameter.
    turns = {int(r.transition): np.array(r.rotation).reshape(3, 3) for r in transitions.collect()}
    gauge, gauges = np.eye(3), []
    for i, ring in enumerate(ring_order):
        if i:
            if i - 1 not in turns:
                raise ValueError(f"no conditioned evidence between {ring_order[i - 1]!r} and {ring!r}")
            gauge = turns[i - 1] @ gauge
        gauges.append((ring, gauge.ravel().tolist()))
    gauges = F.broadcast(records.sparkSession.createDataFrame(gauges, "ring string, gauge array<double>"))
    orientations = materialize(local.join(gauges, "ring").select("name", "ring", E.matmul("rotation", "gauge").alias("rotation")), "orientations")

    outer = _with_both(across.where("not coalesce(same_ring, false)").select("pair_id", "first", "second", "conditioned", "rotation"), orientations, ("r1", "r2"))
    outer = outer.select("pair_id", "first", "second", F.lit("cross_ring").alias("edge_type"), "conditioned", E.geodesic_deg(_relative(F.col("r1"), F.col("r2")), F.col("rotation")).alias("residual"))
    outer = outer.withColumn("status", F.when(F.col("residual") <= threshold, INLIER).otherwise(OUTLIER))
    rest = usable.where("ring <> second_ring and not conditioned").select("pair_id", "first", "second", F.lit("cross_ring").alias("edge_type"), "conditioned", F.lit(None).cast("double").alias("residual"), F.lit(UNUSED).alias("status"))
    named = F.create_map(*[F.lit(x) for i in range(len(ring_order) - 1) for x in (str(i), f"{ring_order[i]}:{ring_order[i + 1]}")]) if len(ring_order) > 1 else F.create_map().cast("map<string,string>")
    return orientations, inner.unionByName(outer).unionByName(rest), transitions.withColumn("transition", named[F.col("transition")])


def ring_aligned(records: DataFrame, reference: DataFrame, *, threshold: float = 15.0, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Orientations (name, rotation) in the gauge of the ``reference`` (name, rotation), and a row for each ring on its gauge.

    Each image that is in the ring's own field and in the reference votes for
    a gauge; the largest cluster within ``threshold`` degrees of a vote (then
    the closest one, then the greater name) is averaged.  Images that no ring
    covers keep their reference.  The distances of a ring's votes are as many as
    the square of its images; several tasks share them, each making a block of
    at most ``block`` votes at a time.
    """
    local = materialize(ring_orientations(_same_ring_edges(records)), "local")
    votes = local.join(reference.select("name", F.col("rotation").alias("own_rotation")), "name").select("ring", "name", E.matmul("own_rotation", E.transpose("rotation")).alias("gauge"))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        g, names = np.stack(pdf["gauge"].to_numpy()).astype(float), pdf["name"].tolist()
        columns, best = ["ring", "support", "nearness", "name", "gauge", "candidates", "residuals"], None
        for own, far in own_blocks(pdf, g, block):
            near = far <= threshold
            for i, (n, d) in enumerate(zip(near.sum(1).tolist(), np.where(near, far, 0).sum(1).tolist())):
                key = (n, -d, names[own[i]])
                if best is None or key > best[0]:
                    best = key, near[i].copy()
        if best is None:
            return pd.DataFrame(columns=columns)
        gauge = mean_rotation(g[best[1]].reshape(-1, 3, 3), np.ones(int(best[1].sum())))
        off = distances(gauge.ravel()[None], g)[0]
        return pd.DataFrame([(pdf["ring"].iloc[0], *best[0], gauge.ravel().tolist(), len(g), np.quantile(off, [0, 0.5, 0.9, 0.95, 0.99, 1]).tolist())], columns=columns)

    led = dealt_votes(materialize(votes, "votes"), "ring", "name").applyInPandas(settle, "ring string, support bigint, nearness double, name string, gauge array<double>, candidates bigint, residuals array<double>")
    best = led.groupBy("ring").agg(F.max(F.struct("support", "nearness", "name", "gauge", "candidates", "residuals")).alias("v"))
    gauges = materialize(best.select("ring", "v.gauge", "v.candidates", "v.support", "v.residuals"), "gauges")
    turned = local.join(gauges.select("ring", "gauge"), "ring").select("name", E.matmul("gauge", "rotation").alias("rotation"))
    rest = reference.select("name", "rotation").join(turned.select("name"), "name", "left_anti")
    counts = local.groupBy("ring").agg(F.count("*").alias("images"))
    share = F.col("support") / F.col("candidates")
    status = F.when(F.col("candidates").isNull(), "missing_reference_overlap").when(share >= 0.5, "supported").otherwise("low_support")
    report = counts.join(gauges, "ring", "left").select("ring", "images", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("support", F.lit(0)).alias("support"), F.coalesce(share, F.lit(0.0)).alias("support_fraction"), status.alias("status"), "residuals")
    return turned.unionByName(rest), report


def _best_first() -> list[Column]:
    """Order of links, best first; the pair's number makes it total."""
    return [-F.col("same").cast("int"), -F.col("inliers"), F.col("residual"), F.col("pair_id")]


def _product(front: Column | str, middle: Column | str, back: Column | str) -> Column:
    return E.matmul(E.matmul(front, middle), back)


def spanning_corrections(steps: DataFrame, anchors: DataFrame, *, most_rounds: int = 64) -> DataFrame:
    """(node, correction) of what a best-first growth from all ``anchors`` (node) at once reaches along ``steps`` (at, to, rank, left, right).

    A step takes the correction C of ``at`` to left C right of ``to``; each link
    is there both ways.  As ranks (least is best) are all different, the growth
    takes the tree of least ranks once the anchors are one node, whatever its
    order; so each part takes its best link to another at the same time, and
    the parts halve.  Parts that point at each other in chains are led to the
    chain's end by doubling, so a tree of any depth takes few joins.
    """
    unit = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    # The correction of a node is left C right, with C that of its part; the anchors' part has no name.
    nodes = steps.select(F.col("to").alias("node")).unionByName(anchors.select("node")).distinct().join(anchors.select("node", F.lit("").alias("part")), "node", "left")
    parts = materialize(nodes.select("node", F.coalesce("part", F.concat(F.lit("n"), F.col("node"))).alias("part"), unit.alias("left"), unit.alias("right")), "parts")
    for _ in range(most_rounds):
        of = lambda side: parts.select(F.col("node").alias(side), F.col("part").alias(f"{side}_part"), F.col("left").alias(f"{side}_left"), F.col("right").alias(f"{side}_right"))  # noqa: B023, E731
        ends = steps.join(of("at").select("at", "at_part"), "at").join(of("to").select("to", "to_part"), "to").where("at_part <> to_part and to_part <> ''")
        best = materialize(ends.groupBy("to_part").agg(F.min(F.struct("rank", "at", "to", "at_part", "left", "right")).alias("l")).select("l.*", "to_part"), "links")
        if best.isEmpty():
            return parts.where("part = ''").select("node", E.matmul("left", "right").alias("correction"))
        # Of two parts that take the same link the lesser stays where it is.
        other = best.select(F.col("to_part").alias("at_part"), F.col("at_part").alias("to_part"))
        best = best.join(other.where("to_part < at_part"), ["at_part", "to_part"], "left_anti")
        hops = best.join(of("at").drop("at_part"), "at").join(of("to").drop("to_part"), "to")
        hops = hops.withColumns({"left": _product(E.transpose("to_left"), "left", "at_left"), "right": _product("at_right", "right", E.transpose("to_right"))})
        hops = materialize(hops.select("to_part", F.col("at_part").alias("up"), "left", "right"), "hops")
        for _ in range(most_rounds):
            onward = hops.select(F.col("to_part").alias("up"), F.col("up").alias("onward"), F.col("left").alias("l"), F.col("right").alias("r"))
            if hops.join(onward, "up", "left_semi").isEmpty():
                break
            far = F.col("onward").isNotNull()
            moved = hops.join(onward, "up", "left").select("to_part", F.coalesce("onward", "up").alias("up"), F.when(far, E.matmul("left", "l")).otherwise(F.col("left")).alias("left"), F.when(far, E.matmul("r", "right")).otherwise(F.col("right")).alias("right"))
            hops = materialize(moved, "hops")
        else:
            raise RuntimeError("links did not settle")
        far = F.col("up").isNotNull()
        led = parts.join(hops.select(F.col("to_part").alias("part"), "up", F.col("left").alias("l"), F.col("right").alias("r")), "part", "left")
        parts = materialize(led.select("node", F.coalesce("up", "part").alias("part"), F.when(far, E.matmul("left", "l")).otherwise(F.col("left")).alias("left"), F.when(far, E.matmul("r", "right")).otherwise(F.col("right")).alias("right")), "parts")
    raise RuntimeError("links did not settle")


def island_repair(records: DataFrame, reference: DataFrame, *, threshold: float = 30.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orientations (name, rotation, island), edges with their residuals before and after, and islands (island, ring, images, assigned, correction).

    Pairs of one ring whose reference agrees with the calibrated rotation
    within ``threshold`` degrees make islands.  The largest island of each ring
    (of equal ones the greatest in name, after its least image) stays; the others are turned along the
    best links, same ring first, then more inliers, less residual and the
    lesser pair.  Islands out of reach, and images without a pair in their ring,
    stay as they are.
    """
    good = records.where("conditioned and rotation is not null").withColumn("same", F.coalesce(F.col("same_ring"), F.lit(False)) & (F.col("ring") == F.col("second_ring")))
    edges = _with_both(good, reference, ("s1", "s2")).withColumn("source", _relative(F.col("s1"), F.col("s2"))).withColumn("residual", E.geodesic_deg("source", "rotation"))
    edges = materialize(edges.select("pair_id", "first", "second", "ring", "same", F.greatest(F.coalesce(F.col("inliers").cast("bigint"), F.lit(1)), F.lit(1)).alias("inliers"), "rotation", "source", "residual"), "edges")
    inner = edges.where("same")
    found = components(inner.where(F.col("residual") <= threshold), "first", "second")
    ring_of = inner.select(F.explode(F.array("first", "second")).alias("name"), "ring").groupBy("name").agg(F.max("ring").alias("ring"))
    own = reference.select("name").distinct().join(ring_of, "name", "left").join(found.withColumnRenamed("node", "name"), "name", "left")
    own = materialize(own.select("name", "ring", F.coalesce("root", "name").alias("island")), "islands")
    sizes = materialize(own.groupBy("island").agg(F.max("ring").alias("ring"), F.count("*").alias("images")), "sizes")
    anchors = sizes.where("ring is not null").groupBy("ring").agg(F.max(F.struct("images", "island")).alias("b")).select(F.col("b.island").alias("node"))

    of = lambda side: own.select(F.col("name").alias(side), F.col("island").alias(f"{side}_island"))
    met = edges.join(of("first"), "first").join(of("second"), "second").where("first_island <> second_island")
    rank = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_best_first())])
    key = [F.least("first_island", "second_island").alias("a"), F.greatest("first_island", "second_island").alias("b")]
    links = met.groupBy(*key).agg(F.min(F.struct(rank.alias("rank"), "first_island", "rotation", "source")).alias("l")).select("a", "b", "l.*")
    links = materialize(links, "links")
    # What takes an island's correction to its neighbour's: R C S' from the first island to the second, R' C S back.
    second = F.when(F.col("a") == F.col("first_island"), F.col("b")).otherwise(F.col("a"))
    forth = links.select(F.col("first_island").alias("at"), second.alias("to"), "rank", F.col("rotation").alias("left"), E.transpose("source").alias("right"))
    back = links.select(second.alias("at"), F.col("first_island").alias("to"), "rank", E.transpose("rotation").alias("left"), F.col("source").alias("right"))
    unit = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    done = spanning_corrections(materialize(forth.unionByName(back), "steps"), anchors).select(F.col("node").alias("island"), "correction")
    done = materialize(done, "corrections")
    islands = sizes.join(done, "island", "left").select("island", "ring", "images", F.col("correction").isNotNull().alias("assigned"), F.coalesce("correction", unit).alias("correction"))
    turned = reference.select("name", "rotation").join(own, "name").join(islands.select("island", "correction"), "island").select("name", E.matmul("correction", "rotation").alias("rotation"), "island")
    turned = materialize(turned, "turned")
    after = _with_both(edges.select("pair_id", "first", "second", "ring", "same", "residual", F.col("rotation").alias("calibrated")), turned, ("c1", "c2"))
    measured = after.select("pair_id", "first", "second", "ring", "same", F.col("residual").alias("source_residual"), E.geodesic_deg(_relative(F.col("c1"), F.col("c2")), F.col("calibrated")).alias("corrected_residual"))
    return turned, measured, islands
