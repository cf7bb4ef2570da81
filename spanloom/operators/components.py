"""Connected components by alternating large and small stars, each round a table in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, small_side

#: Edges that a task joins at a time.
CHUNK = 1 << 20


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the least node of its component.

    Stars only ever join a node to the least one it has seen, so the edges stay
    linear in their number and a node with very many neighbours is combined
    before the shuffle.  Nulls and loops are left out.
    """
    now = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")
    now = materialize(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, "edges")
        was, state = state, _state(now)
        if was == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of the nodes 0 to n - 1, of edges a to b."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of some edges (u, v) at a time, with the least node that these lead to."""

    def star(edges: list[pa.RecordBatch]) -> pa.RecordBatch:
        n = sum(len(e) for e in edges)
        ends = pa.concat_arrays([e[c] for c in ("u", "v") for e in edges]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        node = place[ends.indices.to_numpy()]
        names = ends.dictionary.take(order)
        return pa.RecordBatch.from_arrays([names, names.take(pa.array(_least(node[:n], node[n:], len(names))))], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(len(e) for e in held) >= CHUNK:
            yield star(held)
            held = []
    if any(len(e) for e in held):
        yield star(held)


def near_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """What ``components`` gives, for edges of which those of a component mostly lie together.

    Each task joins its own edges first, so what is shuffled is a row for each
    node and task; only the roots of nodes that several chunks have are
    left for the rounds.
    """
    own = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")
    kind = own.schema["u"].dataType.simpleString()
    stars = materialize(own.mapInArrow(_stars, f"u {kind}, v {kind}"), "stars")
    least = materialize(stars.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")), "least")
    shared = small_side(least.where("m < most").select("u", "m"))
    found = small_side(components(stars.join(shared, "u").where("v <> m").select("m", "v").distinct(), "m", "v"))
    return least.select(F.col("u").alias("node"), "m").join(found.withColumnRenamed("node", "m"), "m", "left").select("node", F.coalesce("root", "m").alias("root"))
