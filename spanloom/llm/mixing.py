"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies,
target / source size, between 0 and ``most_copies``.  Its whole part is taken
for certain; the fraction is rounded.  A document of fraction p and size a is
paired with all shorter ones of its group as if they were one document: they
exchange words, so that the sum of size * fraction stays, until the document is
0 or 1 (or all the others are); chance decides which way, so that it keeps its
expectation.  The others change in the same proportion, which keeps theirs as
long as their fractions are equal, as those of a source are at first.  The
words that a source takes thus stay at its target through all rounds.  One
fraction is left at the end, sometimes of a long document; it is then settled
by chance, and the words that this is off are made up by whole copies of
shorter documents of the group, the rest by a fraction of the shortest that
can take it.  So a source is off by at most half of a short document, unless
one outweighs all the rest of its group, and only these last exchanges don't
keep expectations.

The pairs are made in a tree: documents of a source are dealt by hash over
leaves of about LEAF rows, each leaf leaves at most one fraction, FAN_IN
leaves' fractions meet in the next level, and so on.  A large source is many
leaves, so no task holds more than a leaf or FAN_IN fractions.  Leaves, order
and chance come from hashes of the documents, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import fresh, materialize, small_side
from .words import blank_word_count

LEAF = 2048
FAN_IN = 64
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most_copies: int = 2) -> DataFrame:
    """(source, source_size, docs) with the target of each source.

    Sources in the order of code points, null last, weigh ``weights`` in turn
    and share ``share`` of all words.  A target stops at ``most_copies`` times
    its source's size; what is over is shared anew by weight.  In the order of
    size per weight the sources that stop come first, so running sums find the
    level at which the rest share.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    at = F.pmod(number, F.lit(len(weights)))
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), at + 1)).withColumn("cap", F.col("source_size").cast("double") * most_copies)
    every = Window.partitionBy(F.lit(1))
    rise = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    left_w = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    # The first source, in that order, that doesn't stop at its cap sets the level of all after it.
    s = s.withColumn("level", left / left_w).withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("source").isNull().alias("last"), F.col("source").alias("source"), F.col("level").alias("level")))).over(every)["level"]
    return s.withColumn("level", level).withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))).select("source", "source_size", "docs", "target")


def round_pairs(size: np.ndarray, p: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """``p`` with all but at most one entry made 0 or 1, in order; sum(size * p) stays as it was.

    Each entry is paired with the pool of all later ones.  Those of the pool are
    shift + scale * p, so that an exchange with it takes one step.
    """
    p = np.where(p <= 1e-12, 0.0, np.where(p >= 1 - 1e-12, 1.0, p))
    at = np.flatnonzero((p > 0) & (p < 1))
    words = float(size[at].sum())  # of the pool, and those of them that it takes
    taken = float((size[at] * p[at]).sum())
    shift, scale = 0.0, 1.0
    for i in at.tolist():
        a = float(size[i])
        q = min(1.0, max(0.0, shift + scale * p[i]))
        words, taken = words - a, taken - a * q
        given, room = max(0.0, taken), max(0.0, words - taken)
        if 1e-12 < q < 1 - 1e-12 and words > 0:
            up, down = min((1 - q) * a, given), min(q * a, room)
            if chance[i] * (up + down) < down:
                q, taken = q + up / a, taken - up
                keep = 1 - up / given if given > 0 else 1.0
                shift, scale = shift * keep, scale * keep
            else:
                q, taken = q - down / a, taken + down
                keep = 1 - down / room if room > 0 else 1.0
                shift, scale = 1 - (1 - shift) * keep, scale * keep
        p[i] = 0.0 if q <= 1e-9 else 1.0 if q >= 1 - 1e-9 else q
    left = at[(p[at] > 0) & (p[at] < 1)]
    if len(left):
        _hand_on(size, p, at, int(left[0]), float(chance[left[0]]) * 7919 % 1)
    return p


def _hand_on(size: np.ndarray, p: np.ndarray, at: np.ndarray, i: int, chance: float) -> None:
    """Settle entry ``i`` too, in place, and leave what it is off by on a shorter one of ``at``; it stays as it is if none can take it.

    The way is by chance, or the other one if only that can be made up.
    """
    a, q = float(size[i]), float(p[i])
    for up in (chance < q, chance >= q):
        off, free = (1 - q) * a if up else q * a, 1.0 if up else 0.0
        can = at[(p[at] == free) & (size[at] < a)]
        turned = []
        for k in can[np.argsort(-size[can], kind="stable")].tolist():
            if size[k] <= off:
                turned.append(k)
                off -= float(size[k])
        rest = np.setdiff1d(can, turned)
        rest = rest[size[rest] > off]
        if not len(rest) and off > 1e-9:
            continue
        p[turned], p[i] = 1 - free, float(up)
        if len(rest):
            k = int(rest[np.argmin(size[rest])])
            share = off / float(size[k])
            p[k] = np.round(abs(free - share), 12)
        return


def _level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round the fractions of each (sid, leaf) of a sorted partition; rows keep their order."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        sid, leaf = table["sid"].to_numpy(), table["leaf"].to_numpy()
        cut = np.r_[0, np.flatnonzero((sid[1:] != sid[:-1]) | (leaf[1:] != leaf[:-1])) + 1, table.num_rows]
        yield from _rounded(table.slice(0, cut[-2]), cut[:-1])
        rest = table.slice(cut[-2])
    if rest is not None and rest.num_rows:
        yield from _rounded(rest, np.array([0, rest.num_rows]))


def _rounded(table: pa.Table, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    size, p, chance = (table[k].to_numpy() for k in ("size", "p", "chance"))
    new = np.concatenate([round_pairs(size[i:j], p[i:j], chance[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)])
    at = table.schema.get_field_index("p")
    yield from table.set_column(at, "p", pa.array(new)).combine_chunks().to_batches()


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most_copies: int = 2, seed: int = 17) -> DataFrame:
    """One row for each row of ``docs``: id, key (hash of the text), source, size, source_size, target and copies.

    A null source is a source.  Documents without words have no mass and get no
    copies.  Repeated rows are rounded one by one, in an order that does not
    matter as they are alike.  A null id has a hash as any other.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(source_col).cast("string").alias("source"), blank_word_count(F.col(text_col)).alias("size"))
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = source_targets(sources, weights=weights, share=share, most_copies=most_copies)
    targets = materialize(targets.withColumn("sid", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())), "targets")

    now = rows.join(small_side(targets), rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    mean = F.when(F.col("source_size") > 0, F.least(F.lit(float(most_copies)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    base = F.when(F.col("size") > 0, F.floor(mean)).otherwise(0).cast("long")
    mark = F.xxhash64(F.lit(seed), "id", "key")
    leaves = F.ceil(F.col("docs") / LEAF).cast("long")
    now = now.select("rid", "id", "key", "source", "size", "source_size", "target", "sid", base.alias("base"), F.when(F.col("size") > 0, mean - F.floor(mean)).otherwise(0.0).alias("p"), mark.alias("mark"), F.pmod(mark, leaves).alias("leaf"), leaves.alias("leaves"))
    now = materialize(now, "rounding")

    def level(df: DataFrame, k: int) -> DataFrame:
        chance: Column = F.pmod(F.xxhash64(F.lit(seed + 1 + k), "mark"), F.lit(1 << 40)).cast("double") / float(1 << 40)
        part = df.select("rid", "sid", "leaf", "leaves", "mark", "size", "p", chance.alias("chance"))
        part = part.repartition("sid", "leaf").sortWithinPartitions("sid", "leaf", F.desc("size"), "mark", "rid")
        return part.mapInArrow(_level, part.schema)

    open_, k, done = now, 0, []
    while True:
        made = materialize(level(open_, k), f"level{k}")
        inner = F.col("p").isin(0.0, 1.0)
        done.append(made.where(inner).select("rid", "p"))
        left = made.where(~inner)
        if left.where("leaves > 1").limit(1).count() == 0:
            # One fraction a source at most; the nearest whole number is closest to the target.
            done.append(left.select("rid", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0).alias("p")))
            break
        k += 1
        open_ = left.withColumn("leaves", F.ceil(F.col("leaves") / FAN_IN).cast("long")).withColumn("leaf", F.floor(F.col("leaf") / FAN_IN).cast("long"))
    settled = done[0]
    for d in done[1:]:
        settled = settled.unionByName(d)
    return now.join(settled.withColumnRenamed("p", "extra"), "rid").select("id", "key", "source", "size", "source_size", "target", (F.col("base") + F.col("extra").cast("long")).alias("copies"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the number of the copy (from 0) as ``copy``."""
    pid, pkey, copies, rows, key, own = fresh(docs, "pid", "pkey", "copies", "rows", "key", "own")
    plan = mix(docs, id_col=id_col, text_col=text_col, **how)
    # Rows that share id and text are alike, so their copies are summed and dealt out again in turn.
    plan = materialize(plan.groupBy(F.col("id").alias(pid), F.col("key").alias(pkey)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)), "plan")
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col)))
    out = keyed.join(plan.where(F.col(copies) > 0), F.col(id_col).eqNullSafe(F.col(pid)) & (F.col(key) == F.col(pkey)))
    turn = F.row_number().over(Window.partitionBy(id_col, key).orderBy(F.lit(0))) - 1
    many = out.where(F.col(rows) > 1).withColumn(own, (F.floor(F.col(copies) / F.col(rows)) + F.when(turn < F.col(copies) % F.col(rows), 1).otherwise(0)).cast("int"))
    out = out.where(F.col(rows) == 1).withColumn(own, F.col(copies).cast("int")).unionByName(many).where(F.col(own) > 0)
    kept = [c for c in docs.columns if c != "copy"]
    return out.select(*kept, F.explode(F.sequence(F.lit(0), F.col(own) - 1)).alias("copy"))
