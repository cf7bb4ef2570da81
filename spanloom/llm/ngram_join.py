"""N-gram Jaccard join of documents with Bayesian pruning of candidates.

Documents are sets of word shingles (``width`` lower-case item words; a text of
fewer words, but not none, is one shingle).  Two documents are linked if the
Jaccard similarity of their sets is at least ``threshold``.

1. Each text gives its set, a set key, and HASHES MinHash values.  Documents of
   one set are combined into a class; the rest works on classes.
2. Classes that agree in all values of one of BANDS bands meet in a bucket.  At
   similarity 0.8 a pair misses all 32 bands of 4 with probability 5e-8.
3. In a bucket the MinHash values are compared STEP at a time, and a pair is
   dropped as soon as the posterior probability that its similarity reaches the
   threshold (uniform prior) is below TOLERANCE.  Of the pairs left only
   their components leave the bucket, as stars, so its output is linear in its size.  A
   bucket of more than BLOCK members is dealt out as pairs of blocks.
4. The connected components of the stars are clusters.  Texts of clustered
   classes are read again; in each cluster, again in pairs of blocks, the pairs
   that survive the pruning are verified exactly, and leave as the number of
   links of each class and the stars of the links.
5. The components of the links are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectext as vt
from ..operators.components import components
from ..scratch import fresh, materialize, small_side

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-9
BLOCK = 256

_rng = np.random.Generator(np.random.PCG64(71))
_ODD = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)


def needed(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of compared values the least number that must agree for the pair to stay."""
    out = [0]
    for n in range(1, HASHES + 1):
        # P(J >= t | m of n agree), uniform prior: the chance of at most m successes in n + 1 trials of chance t.
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows: the sorted distinct shingle hashes, row after row, and the offset of each row."""
    data, offsets = vt.buffers(column)
    for first, last, chunk, own in vt.chunks(data, offsets):
        chunk, member = vt.item_bytes(chunk)
        start, end, row = vt.runs(member, own)
        hashes, of = vt.windows(vt.span_hashes(chunk, start, end), row, width)
        order = np.lexsort((hashes, of))
        hashes, of = hashes[order], of[order]
        if len(hashes):
            new = np.r_[True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])]
            hashes, of = hashes[new], of[new]
        yield hashes, np.searchsorted(of, np.arange(last - first + 1))


def _signatures(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """uint16 MinHash values, one row of HASHES for each of the sets that begin at ``begin``."""
    out = np.empty((len(begin), HASHES), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            out[:, k] = (vt.mix64(np.minimum.reduceat((hashes * _ODD[k]) >> np.uint64(8), begin))).astype(np.uint16)
    return out


def _sketch(width: int):
    kind = pa.struct([("set", pa.binary()), ("n", pa.int64()), ("sig", pa.binary())])

    @F.arrow_udf("struct<set:binary,n:bigint,sig:binary>")
    def sketch(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            keys, counts, sigs = [], [], []
            for hashes, at in shingle_sets(column, width):
                size = np.diff(at)
                full = np.flatnonzero(size)
                made = np.full((len(size), HASHES), 0, np.uint16)
                two = np.zeros((len(size), 2), np.uint64)
                if len(full):
                    made[full] = _signatures(hashes, at[full])
                    with np.errstate(over="ignore"):
                        two[full, 0] = vt.mix64(np.add.reduceat(hashes, at[full]))
                        two[full, 1] = vt.mix64(np.add.reduceat(vt.mix64(hashes), at[full]) + size[full].astype(np.uint64))
                keys += [two[i].tobytes() if size[i] else None for i in range(len(size))]
                counts.append(size)
                sigs += [made[i].tobytes() if size[i] else None for i in range(len(size))]
            yield pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(sigs, pa.binary())], fields=list(kind))
        vt.give_back()

    return sketch


def _bands():
    @F.arrow_udf("array<bigint>")
    def bands(sigs: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in sigs:
            value = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BANDS)
            with np.errstate(over="ignore"):
                keys = vt.mix64(value ^ _BAND).view(np.int64)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))

    return bands


def _set_bytes(width: int):
    @F.arrow_udf("binary")
    def set_bytes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array([hashes[at[i] : at[i + 1]].tobytes() for hashes, at in shingle_sets(column, width) for i in range(len(at) - 1)], pa.binary())
        vt.give_back()

    return set_bytes


def survivors(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Boolean matrix of the pairs of signatures that no look at their values rules out."""
    x, y = np.divmod(np.arange(len(a) * len(b)), len(b))
    agree = np.zeros(len(x), np.int16)
    for k in range(0, HASHES, STEP):
        agree += (a[x, k : k + STEP] == b[y, k : k + STEP]).sum(1).astype(np.int16)
        stay = agree >= least[k + STEP]
        x, y, agree = x[stay], y[stay], agree[stay]
    out = np.zeros((len(a), len(b)), bool)
    out[x, y] = True
    return out


def _stars(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node of its component, in the graph of a boolean matrix of the nodes ``left`` and ``right``."""
    rows, cols = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    links = links[np.ix_(rows, cols)]
    names, of = np.unique(np.r_[left[rows], right[cols]], return_inverse=True)
    x, y = of[: len(rows)], of[len(rows) :]
    label, was = np.arange(len(names)), None
    while was is None or (label != was).any():
        was = label.copy()
        np.minimum.at(label, x, np.where(links, label[y][None, :], len(names)).min(1))
        np.minimum.at(label, y, np.where(links, label[x][:, None], len(names)).min(0))
        label = label[label]
    node = np.flatnonzero(label != np.arange(len(names)))
    return names[node], names[label[node]]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal ``keys`` in a sorted partition, across batches."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            value = table[k].combine_chunks()
            value = np.array(value.to_pylist(), object) if pa.types.is_binary(value.type) else value.to_numpy(zero_copy_only=False)
            change[1:] |= value[1:] != value[:-1]
        cut = [0, *np.flatnonzero(change), table.num_rows]
        for p, q in zip(cut[:-2], cut[1:-1], strict=True):
            yield table.slice(p, q - p)
        rest = table.slice(cut[-2])
    if rest is not None and rest.num_rows:
        yield rest


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of block a, rows of block b, and whether the two are one block."""
    a, b, own = (table[k].to_numpy() for k in ("a", "b", "own"))
    return np.flatnonzero(own == a), np.flatnonzero(own == b), bool(a[0] == b[0])


def _dealt(df: DataFrame, group: str, size: str, member: str) -> DataFrame:
    """Each member of a group once for each pair of blocks that its block is in."""
    blocks = F.expr(f"cast(({size} + {BLOCK - 1}) div {BLOCK} as int)")
    own = F.pmod(F.xxhash64(member, group), blocks).cast("int")
    df = df.withColumns({"own": own, "blocks": blocks}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return df.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("other", "blocks")


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Classes and links of all documents.

    The first table has a row for each row of ``docs``: id, key (MD5 of the
    text), class_id (the least id of its class), n_links (other documents that
    it is linked with, copies counted) and n_shingles.  The second has the
    document that stands for each class: id, key and class_id.

    Documents without words (null and empty texts too) have no links and are a
    class each.  Ties and repeated rows are copies: similarity 1.  A null id
    counts as the least.
    """
    least = needed(threshold)
    src = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("key"), F.col(text_col).alias("text"))
    made = materialize(src.withColumn("s", _sketch(width)("text")).select("id", "key", "s.*"), "sketches")

    classes = made.where("set is not null").groupBy("set").agg(F.count("*").alias("copies"), F.min(F.struct("id", "key", "sig")).alias("r")).select("set", "copies", "r.*")
    classes = materialize(classes, "classes")
    band = classes.select("set", F.explode(_bands()("sig")).alias("bucket"))
    shared = band.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = band.join(shared, "bucket").join(classes.select("set", "sig"), "set")
    members = _dealt(members, "bucket", "size", "set").repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["bucket", "a", "b"]):
            if group.num_rows < 2:
                continue
            left, right, same = _sides(group)
            sets = np.array(group["set"].to_pylist(), object)
            sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint16).reshape(-1, HASHES)
            links = survivors(sig[left], sig[right], least)
            if same:
                links &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
            if links.any():
                x, y = _stars(links, sets[left], sets[right])
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary()), pa.array(list(y), pa.binary())], names=["u", "v"])

    cluster = components(members.select("bucket", "a", "b", "own", "set", "sig").mapInArrow(prune, "u binary, v binary"))
    cluster = materialize(cluster.select(F.col("node").alias("set"), F.col("root").alias("cluster")), "clusters")
    sizes = cluster.groupBy("cluster").agg(F.count("*").alias("size"))
    wanted = cluster.join(sizes, "cluster").join(classes, "set").select("set", "cluster", "size", "copies", "sig", F.col("id").alias("wid"), F.col("key").alias("wkey"))
    texts = src.join(small_side(materialize(wanted, "wanted")), F.col("id").eqNullSafe(F.col("wid")) & (F.col("key") == F.col("wkey")))
    texts = texts.dropDuplicates(["set"]).select("set", "cluster", "size", "copies", "sig", _set_bytes(width)("text").alias("grams"))
    texts = _dealt(materialize(texts, "grams"), "cluster", "size", "set").repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["cluster", "a", "b"]):
            left, right, same = _sides(group)
            sets, copies = np.array(group["set"].to_pylist(), object), group["copies"].to_numpy()
            sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint16).reshape(-1, HASHES)
            maybe = survivors(sig[left], sig[right], least)
            if same:
                maybe &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
            grams = [np.frombuffer(x, np.uint64) for x in group["grams"].to_pylist()]
            links = similar(grams, left, right, maybe, threshold)
            n = np.zeros(group.num_rows, np.int64)
            np.add.at(n, left, links @ copies[right])
            np.add.at(n, right, links.T @ copies[left])
            nodes, mates = _stars(links, sets[left], sets[right]) if links.any() else (sets[:0], sets[:0])
            columns = [pa.array([*sets, *nodes], pa.binary()), pa.array(np.r_[n, np.zeros(len(nodes), np.int64)]), pa.array([*[None] * len(n), *mates], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["set", "links", "mate"])

    found = materialize(texts.select("cluster", "a", "b", "own", "set", "copies", "sig", "grams").mapInArrow(verify, "set binary, links bigint, mate binary"), "links")
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    root = components(found, "set", "mate")
    known = classes.select("set", "id", "key", "copies").join(root.select(F.col("node").alias("set"), "root"), "set", "left").join(links, "set", "left")
    known = materialize(known.select("set", F.coalesce("root", "set").alias("root"), "id", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    heads = known.groupBy("root").agg(F.min(F.struct("id", "key")).alias("h")).select("root", F.col("h.id").alias("class_id"), F.col("h.key").alias("head_key"))
    known = known.join(heads, "root").select("set", "class_id", "n_links")
    rows = made.select("id", "key", "set", F.col("n").alias("n_shingles")).join(known, "set", "left")
    rows = rows.select("id", "key", F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_shingles")
    return rows, heads.select(F.col("class_id").alias("id"), F.col("head_key").alias("key"), "class_id")


def similar(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, maybe: np.ndarray, threshold: float) -> np.ndarray:
    """Of the pairs in ``maybe`` those whose sets have the similarity, exactly."""
    out = np.zeros(maybe.shape, bool)
    x, y = np.nonzero(maybe)
    if not len(x):
        return out
    if len(x) <= 64:
        for i, j in zip(x, y, strict=True):
            p, q = grams[left[i]], grams[right[j]]
            shared = len(np.intersect1d(p, q, assume_unique=True))
            out[i, j] = shared >= threshold * (len(p) + len(q) - shared)
        return out
    rows = np.unique(np.r_[left[maybe.any(1)], right[maybe.any(0)]])
    size = np.array([len(g) for g in grams])
    value, col = np.unique(np.concatenate([grams[r] for r in rows]), return_inverse=True)
    of = np.repeat(np.arange(len(rows)), size[rows])
    often = np.bincount(col, minlength=len(value)) > 1
    rank = np.cumsum(often) - 1
    of, col = of[often[col]], rank[col[often[col]]]
    order = np.argsort(col, kind="stable")
    of, col = of[order], col[order]
    place = np.full(len(grams), -1)
    place[rows] = np.arange(len(rows))
    shared = np.zeros((len(rows), len(rows)), np.float32)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, 2048):
        p, q = np.searchsorted(col, [c, c + 2048])
        part = np.zeros((len(rows), 2048), np.float32)
        part[of[p:q], col[p:q] - c] = 1
        shared += part @ part.T
    both = shared[place[left[x]], place[right[y]]]
    out[x, y] = both >= threshold * (size[left[x]] + size[right[y]] - both)
    return out


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each class; the one of the least id stays, and all documents without words.

    All columns pass through, whatever their names.
    """
    rows, heads = similar_documents(docs, id_col=id_col, text_col=text_col, width=width, threshold=threshold)
    empty = rows.where("n_shingles = 0").select("id", "key").distinct()
    kid, kkey, one, key, copy, part = fresh(docs, "kid", "kkey", "one", "key", "copy", "part")
    keep = heads.select("id", "key", F.lit(True).alias("one")).unionByName(empty.select("id", "key", F.lit(False).alias("one")))
    keep = materialize(keep.select(F.col("id").alias(kid), F.col("key").alias(kkey), F.col("one").alias(one)), "keep")
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    out = keyed.join(small_side(keep), F.col(id_col).eqNullSafe(F.col(kid)) & (F.col(key) == F.col(kkey)))
    # Of rows that repeat one stays: the first within its partition, then of these.
    out = out.withColumn(part, F.spark_partition_id())
    out = out.where(F.col(one)).withColumn(copy, F.row_number().over(Window.partitionBy(id_col, key, part).orderBy(F.lit(0)))).where(F.col(copy) == 1).withColumn(copy, F.row_number().over(Window.partitionBy(id_col, key).orderBy(F.lit(0)))).where(F.col(copy) == 1).unionByName(out.where(~F.col(one)).withColumn(copy, F.lit(1)))
    return out.select(*docs.columns)
