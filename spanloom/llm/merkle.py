"""Merkle manifest of a dataset, built and verified in supersteps over RDDs of vertices.

The rows of a group are the leaves of a tree of fan-out 8, the groups' roots
those of a second tree.  Going up, each vertex sends its hash to its parent; a
parent has all its children once the superstep ends, hashes them and is the
next sender.  Going down, each parent sends every child the hashes of its
siblings and what it got from above itself, so at the end every leaf has its
path and is checked against the root.

A vertex is known by its group and place, a vertex of the first level keeps
its (at most eight) leaves, so the paths go no further than to it by a shuffle.
The vertices of each level are a table in the shared folder: a superstep that
loses an executor is done again from there.  Nothing is collected but counts.
"""

from __future__ import annotations

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import global_positions
from ..scratch import materialize, small_side
from .hashtree import FANOUT, digest, entry, fold, own_hash, spread, steps

#: Vertices that one task of a superstep handles, about.
TASK_VERTICES = 1000

_LEAVES = "g bigint, place bigint, n bigint, kids array<struct<slot:int,leaf:string,claim:string,id:{id}>>"
_VERTICES = "g bigint, place bigint, n bigint, kids array<string>"


def leaf_hash(*fields: Column) -> Column:
    """SHA-256, in lower-case hex, of the fields: each ``-`` if null, else its number of UTF-8 bytes, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _tasks(spark: SparkSession, vertices: int) -> int:
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vertices // TASK_VERTICES)))


def _table(spark: SparkSession, rdd: RDD, schema: str, label: str) -> DataFrame:
    return materialize(spark.createDataFrame(rdd, schema, verifySchema=False), label)


def _levels(n: int) -> int:
    """Number of levels of vertices above n leaves; 1 at least, as a lone leaf has a vertex too."""
    k = 1
    while (n := -(-n // FANOUT)) > 1:
        k += 1
    return k


def _upward(leaves: DataFrame, id_type: str, size: dict[str, int]) -> list[DataFrame]:
    """The tables of vertices, level by level; ``leaves`` has g, place, n, leaf, claim and id."""
    spark, f = leaves.sparkSession, FANOUT
    at = leaves.select("g", "place", "n", "leaf", "claim", "id").rdd.map(lambda r: ((r[0], r[1] // f), (r[1] % f, r[3], r[4], r[5], r[2])))
    got = at.groupByKey(_tasks(spark, size["vertices"]), spread)
    # Of one vertex there are eight leaves at most.
    first = got.map(lambda kv: (*kv[0], min(kv[1])[4], [x[:4] for x in sorted(kv[1], key=lambda x: x[0])]))
    made = [_table(spark, first, _LEAVES.format(id=id_type), "leaves")]
    for level in range(2, size["levels"] + 1):
        lower = level == 2

        def send(r, lower=lower):
            """To the parent: slot, own hash, and how many nodes this level of the group has; the last one has no parent."""
            if (now := -(-r[2] // f)) > 1:
                yield (r[0], r[1] // f), (r[1] % f, own_hash(r[2], [k[1] for k in r[3]] if lower else r[3]), now)

        got = made[-1].rdd.flatMap(send).groupByKey(_tasks(spark, size["vertices"] // f ** (level - 1) + 1), spread)
        made.append(_table(spark, got.map(lambda kv: (*kv[0], min(kv[1])[2], [x[1] for x in sorted(kv[1])])), _VERTICES, "vertices"))
    return made


def _tops(levels: list[DataFrame]) -> RDD:
    """(g, level, hash) of the vertex at the top of each group's tree."""
    f, out = FANOUT, []
    for k, table in enumerate(levels, 1):
        out.append(table.where(f"n <= {f}").rdd.map(lambda r, k=k: (r[0], k, own_hash(r[2], [x[1] for x in r[3]] if k == 1 else r[3]))))
    return levels[0].sparkSession.sparkContext.union(out)


def _downward(levels: list[DataFrame], tops: RDD, size: dict[str, int]) -> RDD:
    """The vertices of the first level with what they got from above; ``tops`` has (g, level, what the group's top gets).

    What a vertex gets is (path of its own place, subroot, root).
    """
    spark, f = levels[0].sparkSession, FANOUT
    sent = None
    for level in range(len(levels), 0, -1):
        begin = tops.filter(lambda t, level=level: t[1] == level).map(lambda t: ((t[0], 0), t[2]))
        sent = begin if sent is None else sent.union(begin)
        state = levels[level - 1].rdd.map(lambda r: ((r[0], r[1]), (r[2], r[3])))
        met = sent.join(state, _tasks(spark, size["vertices"] // f ** (level - 1) + 1))
        if level == 1:
            return met

        def forward(kv):
            (g, place), ((path, subroot, root), (n, kids)) = kv
            for slot, _ in enumerate(kids):
                yield (g, place * f + slot), (entry(slot, kids[:slot] + kids[slot + 1 :]) + path if n > 1 else path, subroot, root)

        sent = met.flatMap(forward)
    raise AssertionError


def _sizes(leaves: DataFrame) -> dict[str, int]:
    found = leaves.groupBy("g").agg(F.max("n").alias("n")).agg(F.max("n"), F.sum(F.ceil(F.col("n") / FANOUT))).first()
    return {"levels": _levels(found[0] or 1), "vertices": found[1] or 0}


def merkle_manifest(docs: DataFrame, fields: list[Column], *, id_col: str = "doc_id", group_col: str = "lang", claim: list[Column] | None = None, paths: bool = True) -> DataFrame:
    """A row for each row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root, verified, and path if ``paths``.

    ``fields`` make the leaf.  The leaves of a group are in the order of id,
    null first, then of hash; groups are in the order of their value, null
    first, text by its UTF-8 bytes.  A run of 8 consecutive nodes becomes the
    hash of their hashes, until one node remains; a lone node stays as it is.
    Rows that repeat are leaves of their own with paths of their own, and which
    of them has which path is no matter.  ``claim`` are the fields as someone
    claims them to be now: folded_root is what they give with the siblings of
    the manifest, and verified whether that is the root.  Nulls are values;
    texts of any length are hashed whole; an empty table gives an empty one.
    Other columns, of whatever name, are not looked at.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("of"), leaf_hash(*fields).alias("leaf"), (leaf_hash(*claim) if claim else F.lit(None).cast("string")).alias("claim"))
    id_type = own.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", path binary" * paths
    # The number of a row only parts rows that repeat, so that a table of one row over and over is dealt out too.
    own = materialize(own.withColumn("row", F.monotonically_increasing_id()), "hashes")
    order = [F.col("of").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    ranked, total = global_positions(own, order)
    if not total:
        return spark.createDataFrame([], schema)
    ranked = materialize(ranked, "ranked")
    groups = materialize(ranked.groupBy("of").agg(F.min("pos").alias("g"), F.count("*").alias("n")).withColumnRenamed("of", "gof"), "groups")
    leaves = ranked.join(small_side(groups), F.col("of").eqNullSafe(F.col("gof"))).select("g", (F.col("pos") - F.col("g")).alias("place"), "n", "leaf", F.coalesce("claim", "leaf").alias("claim"), "id")
    size = _sizes(groups)
    levels = _upward(leaves, id_type, size)

    # The groups are the leaves of the upper tree.
    tops = _table(spark, _tops(levels), "g bigint, level int, hash string", "subroots")
    placed, number = global_positions(tops, [F.col("g")])
    upper = placed.select(F.lit(0).cast("bigint").alias("g"), F.col("pos").alias("place"), F.lit(number).cast("bigint").alias("n"), F.col("hash").alias("leaf"), F.lit(None).cast("string").alias("claim"), F.struct("g", "level").alias("id"))
    bound = {"levels": _levels(number), "vertices": -(-number // FANOUT)}
    above = _upward(upper, "struct<g:bigint,level:int>", bound)
    root = _tops(above).first()[2]

    def to_groups(kv):
        (_, _), ((path, _, top), (n, kids)) = kv
        hashes = [k[1] for k in kids]
        for slot, (_, hash_, _, (g, level)) in enumerate(kids):
            yield g, level, (entry(slot, hashes[:slot] + hashes[slot + 1 :]) + path if n > 1 else path, hash_, top)

    begin = spark.sparkContext.parallelize([(0, len(above), (b"", root, root))], 1)
    begin = _downward(above, begin, bound).flatMap(to_groups)
    begin = _table(spark, begin, "g bigint, level int, got struct<path:binary,subroot:string,root:string>", "begin").rdd.map(lambda r: (r[0], r[1], (bytes(r[2][0]), r[2][1], r[2][2])))

    def settle(kv):
        """What each leaf of a vertex gets, and whether its claim leads to the root."""
        _, ((path, subroot, top), (n, kids)) = kv
        hashes, upward = [k[1] for k in kids], list(steps(path))
        rest = "".join(left + right for left, right in upward)
        for slot, (_, leaf, claimed, id_) in enumerate(kids):
            left, right = "".join(hashes[:slot]), "".join(hashes[slot + 1 :])
            mine = [(left, right), *upward] if n > 1 else upward
            folded = fold(claimed, mine)
            proof = digest((left + right if n > 1 else "") + rest)
            yield (id_, leaf, subroot, top, proof, folded, folded == top, *((entry(slot, hashes[:slot] + hashes[slot + 1 :]) + path if n > 1 else path,) if paths else ()))

    return spark.createDataFrame(_downward(levels, begin, size).flatMap(settle), schema, verifySchema=False)


def folded_root(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the path that a manifest has stored for it; null without either."""
    return F.udf(lambda h, p: None if h is None or p is None else fold(h, steps(bytes(p))), "string")(leaf, path)
