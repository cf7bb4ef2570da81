"""The evidence operators over the registered tables.

Roles: events are captures (ring = user, order = time), lineitem rows are
matches of parts and suppliers, orders are tracks, embeddings are signatures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import audits, cloud, dedupe, evidence, gates, graph, phases, selection, stats


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# Captures --------------------------------------------------------------------


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phases.phase_frames(_t(spark, sf_dir, "events"), "user_id", [F.col("ts")], "event_id")


def _rings(frames: DataFrame) -> DataFrame:
    return frames.select("ring").distinct().withColumn("ord", F.col("ring"))


def phase_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_frames(spark, sf_dir), "phase", places=9)


def pair_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    return phases.pair_schedule(frames, _rings(frames))


def offset_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events")
    frames = _frames(spark, sf_dir).join(events.select(F.col("event_id").alias("name"), F.col("value").alias("v")), "name")
    steps = _rings(frames).select(F.col("ring").alias("left"), (F.col("ring") + 1).alias("right"))
    votes = phases.offset_votes(frames, steps, F.round(100 - F.abs(F.col("lv") - F.col("rv")), 4))
    return _rounded(phases.best_offset(votes, 0.5), "offset", "best", "margin", "confidence")


def cycle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    rows = e.select((F.col("label") % 2).alias("ring"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("sig"))
    rows = rows.withColumn("pos", (F.row_number().over(Window.partitionBy("ring").orderBy("vec_id")) - 1).cast("bigint"))
    return _rounded(phases.cycle_splits(rows), "score")


def role_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.sql("select * from values ('first', timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-10 11:59:59'), ('second', timestamp_ntz'2024-01-10 12:00:00', timestamp_ntz'2024-01-20 23:59:59'), ('third', timestamp_ntz'2024-01-22 00:00:00', timestamp_ntz'2024-01-28 00:00:00') as t(role, start, end)")
    return stats.role_totals(_t(spark, sf_dir, "events"), ranges, "ts")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.exact_duplicates(_t(spark, sf_dir, "documents"), "doc_id", F.sha2(F.col("text"), 256))


def near_duplicate_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.near_anchor_duplicates(_t(spark, sf_dir, "embeddings"), "label", "vec_id", E.sign_word("embedding"), 24)


def signature_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").withColumn("z", E.z_scores("embedding"))
    after = F.lead("z").over(Window.partitionBy("label").orderBy("vec_id"))
    return _rounded(e.withColumn("next", after).where("next is not null").select("vec_id", E.mean_abs_difference("z", "next").alias("distance")), "distance")


# Pairs -----------------------------------------------------------------------


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, supp, inliers, qty): lines of each part and supplier."""
    return _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).agg(F.count("*").alias("rows"), F.sum("l_quantity").cast("bigint").alias("inliers"))


def pair_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_partkey") % 25).cast("int").alias("ring"), F.col("p_size").alias("frame"))
    supp = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_nationkey").alias("ring"), (F.col("s_suppkey") % 50).cast("int").alias("frame"))
    pairs = _matches(spark, sf_dir).select(F.concat(F.lit("p"), F.col("part").cast("string")).alias("first"), F.concat(F.lit("s"), F.col("supp").cast("string")).alias("second"), "inliers")
    return evidence.pair_evidence(pairs, part.unionByName(supp))


def trajectory_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    jumps = _t(spark, sf_dir, "events").withColumn("jump", F.abs(F.col("value") - F.lag("value").over(w))).where("jump is not null")
    return _rounded(evidence.robust_outliers(jumps, ["user_id"], "jump", 1.5).select("event_id", "user_id", "jump", "med", "mad", "threshold", "is_outlier"), "jump", "med", "mad", "threshold")


def pair_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir)
    identity = F.array(*[F.lit(float(i in (0, 4, 8))) for i in range(9)])
    bad = F.array(*[F.lit(1.0)] * 9)
    rows = m.select(
        "part", "supp", F.when(F.col("rows") > 1, 2).otherwise(F.col("rows").cast("int")).alias("config"), F.when(F.col("supp") % 7 == 0, bad).otherwise(identity).alias("rotation"),
        F.when(F.col("part") % 11 == 0, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("translation"), "inliers",
        F.when(F.col("supp") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("inliers") / 500.0).alias("tri_angle"), (F.col("inliers") % 10 / 10.0).alias("cheirality"), F.when(F.col("part") % 3 == 0, None).otherwise(F.col("part") % 10 / 10.0).alias("homography"),
        F.when(F.col("supp") % 9 == 0, None).otherwise(F.lit(1e-4)).alias("rank_ratio"),
    )
    out = evidence.classify_pairs(rows, least_inliers=30)
    return out.select("part", "supp", F.array_join("reasons", ",").alias("reasons"), "well_conditioned")


def triangle_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotations about one axis between suppliers of neighbouring keys; the residual of each triangle."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    near = _steps(s)
    angle = F.radians((F.col("vb") - F.col("va")) % 60 + F.when((F.col("a") + F.col("b")) % 13 == 0, 25.0).otherwise(0.0))
    c, d, o = F.cos(angle), F.sin(angle), F.lit(0.0)
    edges = near.select((F.col("a") * 1000000 + F.col("b")).alias("pair_id"), "a", "b", F.col("a").alias("frame_a"), F.col("b").alias("frame_b"), F.array(c, -d, o, d, c, o, o, o, F.lit(1.0)).alias("rotation"))
    return _rounded(evidence.triangle_cycles(edges).select("pair_id", F.coalesce("cycle_error", F.lit(-1.0)).alias("cycle_error"), F.coalesce("cycles", F.lit(0)).alias("cycles")), "cycle_error", places=3)


def _steps(s: DataFrame) -> DataFrame:
    ahead = s.select(F.col("k").alias("a"), F.col("v").alias("va"), F.explode(F.sequence(F.col("k") + 1, F.col("k") + 3)).alias("b"))
    return ahead.join(s.select(F.col("k").alias("b"), F.col("v").alias("vb")), "b")


def source_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "supplier")
    m = _matches(spark, sf_dir).join(part.select(F.col("p_partkey").alias("part"), (F.col("p_partkey") % 25).alias("ring")), "part").join(supp.select(F.col("s_suppkey").alias("supp"), "s_nationkey"), "supp")
    edges = m.select(F.col("part").alias("ref"), F.col("supp").alias("source"), (F.col("ring") == F.col("s_nationkey")).alias("same_ring"), F.abs(F.col("ring") - F.col("s_nationkey")).cast("double").alias("distance"), F.col("supp").alias("ord"))
    return selection.prioritized_sources(edges, most=6, least_cross=1)


def capped_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    pairs = _steps(s).select("a", "b")
    order = s.select(F.col("k").alias("name"), F.row_number().over(Window.orderBy(F.desc("v"), "k")).alias("ord"))
    return selection.capped_adjacency(pairs, order, 4)


def support_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir)
    edges = m.select(F.col("part").alias("ref"), F.col("supp").alias("source"), (F.col("part") % 2 == F.col("supp") % 2).alias("same_ring"), "inliers")
    return selection.ring_support_sources(edges, local=2, cross=1, most=4)


# Audits ----------------------------------------------------------------------


def exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return audits.exactly_once(orders, _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct(), "k")


def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    left, right = (o.where(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("k")) for p in ("1-URGENT", "5-LOW"))
    return audits.set_differences(left, right, "k")


def pair_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return audits.prune_to(_t(spark, sf_dir, "lineitem"), keep, "l_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.sum("l_linenumber").alias("lines"))


def replaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = orders.where("o_orderkey % 10 = 3").select("o_orderkey", F.lit("R").alias("o_orderstatus"))
    return audits.replace_rows(orders, new, "o_orderkey")


def recompute_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), "source")
    cached = docs.where("source <> 'src3'").select("doc_id", "sha")
    return audits.recompute_set(docs, cached, ["doc_id", "sha"]).select("doc_id", "sha", "source")


def tile_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _t(spark, sf_dir, "lineitem")
    tiles = line.select((F.col("l_partkey") % 24).alias("tile"), F.col("l_partkey").alias("ref"), F.col("l_suppkey").alias("source")).distinct()
    images = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"))
    rings = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_nationkey").alias("ring"))
    return audits.tile_audit(tiles, images, rings)


# Statistics ------------------------------------------------------------------


def track_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.track_distribution(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey"), "mean_length", "frac_2", "frac_ge_3", "frac_ge_4")


def ring_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("active")).distinct()
    c = _t(spark, sf_dir, "customer").join(active, "c_custkey", "left")
    return _rounded(stats.coverage(c, "c_nationkey", F.col("c_acctbal") > 0, F.coalesce("active", F.lit(False))), "fraction")


def summary_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.summary_quantiles(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"), "mean", "p10", "p50", "least", places=4)


def support_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.support_fractions(_t(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_discount") < 0.07, least_fraction=0.6, least_length=3), "support")


def centroid_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.centroid_spread(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_discount", "l_tax")
    return _rounded(out, "cx", "cy", "cz", "radius_median", "radius_std", "radius_cv", places=4)


def robust_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.robust_bounds(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return _rounded(out, *[c for c in out.columns if c != "n"], places=4)


def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.even_sample(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], 50).select("pos", "o_orderkey")


def lexicographic_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return selection.lexicographic_best(part, [F.col("p_size"), -F.col("p_retailprice"), F.col("p_partkey")], ["p_brand"])


# Clouds ----------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _t(spark, sf_dir, "lineitem")
    return line.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pid"), (F.col("l_quantity") / 10 - 2.5).alias("x"), (F.col("l_discount") * 20 - 1).alias("y"), (F.col("l_tax") * 20 + 2).alias("z"), F.col("l_extendedprice").alias("height"), (F.col("l_discount") < 0.08).alias("supported"), F.col("l_linenumber").cast("bigint").alias("views"))


def anatomy_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cloud.region_evidence(cloud.normalized_height(_points(spark, sf_dir), "height"))
    return _rounded(out, "supported_fraction", "projected_fraction", "median_views", "bin_occupancy")


def _cameras(spark: SparkSession) -> DataFrame:
    eye = "array(1D, 0D, 0D, {0}D, 0D, 1D, 0D, 0D, 0D, 0D, 1D, {1}D)"
    return spark.sql("select * from values " + ", ".join(f"({i}, {eye.format(x, z)}, array(100D, 100D, 64D, 48D), 128, 96)" for i, (x, z) in enumerate(((0, 0), (1, 0), (-1, 1), (0, -3), (2, 2)))) + " as t(cam, m, k, width, height)")


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = lambda s: (s["p"]["u"] >= 0) & (s["p"]["u"] < s["width"]) & (s["p"]["v"] >= 0) & (s["p"]["v"] < s["height"])
    bottom = lambda s: s["p"]["v"] >= s["height"] * 0.84
    p = cloud.contamination(_points(spark, sf_dir).select("pid", "x", "y", "z"), _cameras(spark), inside, bottom)
    return p.groupBy("views", "inside", "escapes").agg(F.count("*").alias("points"))


def bottom_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cloud.bottom_escape(_points(spark, sf_dir).withColumn("outside", F.col("views") % 4), "height", "outside"), "low_threshold", "escape_fraction", "webbing_fraction")


def voxel_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "customer").select((F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"), (F.col("c_custkey") * 7 % 89).cast("double").alias("z"))
    return _rounded(cloud.voxel_components(p, ["x", "y", "z"]), "largest_fraction")


def principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cloud.principal_axes(_points(spark, sf_dir), ["x", "y", "z"])
    return out.select(F.transform("values", lambda v: F.round(v, 6)).alias("values"), F.transform("vectors", lambda v: F.round(v, 6)).alias("vectors"))


# Graphs ----------------------------------------------------------------------


def connected_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the days of their orders as a bipartite graph."""
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("u"), (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("bigint") * 2 + 1).alias("v"))
    from ..operators.components import components

    return components(o).groupBy("root").agg(F.count("*").alias("size"))


def _evidence_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of suppliers with evidence, and their match rows of keypoints; some rows contradict."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), F.col("s_nationkey").alias("ring"))
    near = _steps(s.select("k", "v"))
    pair = E.pair_id(F.col("a") + 1, F.col("b") + 1)
    pairs = near.select(pair.alias("pair_id"), (F.col("a") + 1).alias("i1"), (F.col("b") + 1).alias("i2"), (F.col("a") % 5 == F.col("b") % 5).alias("same_ring"), F.when(F.col("a") % 4 == 0, graph.OUTLIER).otherwise(graph.INLIER).alias("status"), (F.col("a") % 3 == 0).alias("cycle_consistent"), (F.col("b") - F.col("a")).alias("frame_distance"), F.floor(F.abs(F.col("vb"))).cast("bigint").alias("inliers"), F.lit(1.0).alias("tri_angle"), F.lit(0.5).alias("homography"))
    rows = pairs.select("pair_id", "i1", "i2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("row")).withColumns({"k1": F.col("row"), "k2": F.when((F.col("i1") * 7 + F.col("row")) % 17 == 0, F.col("row") + 1).otherwise(F.col("row"))})
    return pairs, rows


def conflict_free_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.conflict_free_pairs(*_evidence_pairs(spark, sf_dir))


def conflict_free_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, rows = _evidence_pairs(spark, sf_dir)
    return graph.conflict_free_rows(pairs.withColumn("cap", F.lit(4).cast("bigint")), rows, least_rows=0)


def spanning_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, _ = _evidence_pairs(spark, sf_dir)
    return graph.spanning_bridges(pairs.select("pair_id", F.col("i1").alias("a"), F.col("i2").alias("b"), (F.col("same_ring")).alias("base"), "inliers", "tri_angle", "homography"))


def capped_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, _ = _evidence_pairs(spark, sf_dir)
    return graph.capped_matching(pairs.where("not same_ring").select("pair_id", F.col("i1").alias("a"), F.col("i2").alias("b"), "inliers", (F.col("i1") % 7 > 0).alias("adjacent")))


# Names, gates ----------------------------------------------------------------


def url_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", E.basename("url").alias("base"), E.duplicate_stem(F.concat(E.basename("url"), F.lit("_01.jpg"))).alias("stem"))


def pair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir).where("part <> supp").select(E.pair_id(F.col("part") + 1, F.col("supp") + 1).alias("pair_id"))
    return m.distinct().select("pair_id", E.decode_pair_id("pair_id")["first"].alias("first"), E.decode_pair_id("pair_id")["second"].alias("second"))


def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.max("k").alias("k_max"), F.count("k").alias("n"))


def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = ring_coverage(spark, sf_dir).agg(F.min("registered").alias("min_registered"), F.count("*").alias("cross_ring_connections"))
    row = row.select("*", F.lit(0.05).alias("board_fraction"), F.lit(None).cast("double").alias("cloth_fraction"), F.lit("passed").alias("trajectory_status"), F.lit("pending").alias("visual_status"))
    return gates.sparse_gate(row).select("passed", F.array_join("reasons", ",").alias("reasons"))


def component_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag").count()
    row = c.agg(F.collect_list(F.col("count").cast("double")).alias("n")).select(F.transform("n", lambda x: x / F.aggregate("n", F.lit(0.0), lambda a, y: a + y)).alias("fractions"))
    return gates.component_gate(row).select("passed", F.array_join("reasons", ",").alias("reasons"))


QUERIES = {f.__name__: f for f in (
    phase_frames, pair_schedule, offset_vote, cycle_split, role_totals, exact_duplicates, near_duplicate_anchor, signature_distance, pair_evidence, trajectory_outliers,
    pair_classes, triangle_cycles, source_selection, capped_adjacency, support_sources, exactly_once, set_differences, pair_prune, replaced_rows, recompute_set, tile_audit,
    track_distribution, ring_coverage, summary_quantiles, support_fraction, centroid_spread, robust_bounds, even_sample, lexicographic_best, anatomy_regions, contamination,
    bottom_escape, voxel_components, principal_axes, connected_parts, conflict_free_pairs, conflict_free_rows, spanning_bridges, capped_matching, url_basename, pair_ids,
    props_json, gate_report, component_gate,
)}
