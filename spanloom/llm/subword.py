"""Quality classifier of subword embeddings: vectors of hashed word and character n-grams, averaged, and a softmax.

Features of a text are its words, pairs of words, and the runs of 3 and 4
characters that don't reach over a word's edge, all hashed to ``CELLS``
vectors; a pair of equal words is one feature whatever the word, and the end
of the text is one too.  A document is the mean of its features' vectors, two
outputs and a softmax give the probability of each label.

The model is fitted by stochastic gradient descent in NumPy on at most
``most_rows`` labelled rows of each label, those of the least hash, so the fit
is the same at every size and in every run.  The rows are dealt into shards of
about ``SHARD_ROWS``; in each of ``ROUNDS`` rounds each shard goes on by itself from the
common model in a task of its own, row by row as they are read, and the changes
are averaged over the shards that touched a vector.  As mean and outputs are
linear, a document's score is the mean of one number for each feature, which is
what scoring looks up, over whole texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectext as vt
from ..scratch import materialize, small_side

#: Hashed vectors (a power of two) and their width.
BITS, WIDTH = 16, 8
CELLS = 1 << BITS
#: Labelled rows of each label that the fit uses at most.
MOST_ROWS = 2500
ROUNDS, RATE = 6, 0.25
#: Rows that one task goes through in a round, about.
SHARD_ROWS = 1250
#: Squares that each vector begins with; so much that those of rare features move little.
START = 1e-2
#: Runs of so many characters.
CHARS = (3, 4)
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
#: Cells of fixed features.
_END_OF_TEXT, _SAME_WORD = 1, 2


class Model(NamedTuple):
    """One number for each feature, and the intercept, which stands for the share of the labels."""

    cells: np.ndarray
    bias: float


def _short(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cell, row) of each occurrence of a feature, one kind after the other."""
    rows = len(offsets) - 1
    yield np.full(rows, _END_OF_TEXT), np.arange(rows)
    start, end, row = vt.runs(vt.SOLID[data], offsets)
    words = vt.span_hashes(data, start, end)
    yield _short(words), row
    pairs, of = vt.windows(words, row, 2, short=False)
    same = (words[1:] == words[:-1])[row[1:] == row[:-1]] if len(words) > 1 else np.zeros(0, bool)
    yield np.where(same, _SAME_WORD, _short(pairs)), of
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(begins[offsets]))
    blank = (chars == 32) | (chars - np.uint32(9) < 5)
    more = np.r_[False, blank[1:] & blank[:-1] & (row[1:] == row[:-1])] if len(chars) else blank
    chars, row, blank = np.where(blank, np.uint32(32), chars)[~more], row[~more], blank[~more]
    for n in CHARS:
        size = len(chars) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n * 0x165667B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ chars[k : k + size]) * _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
        inside = row[:size] == row[n - 1 :]
        for k in range(1, n - 1):
            inside &= ~blank[k : k + size]
        yield (h[inside] >> np.uint32(32 - BITS)).astype(np.int64), row[:size][inside]


def counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, share of the row's occurrences), by row and cell."""
    keys = np.concatenate([row.astype(np.int64) * CELLS + cell for cell, row in features(data, offsets)])
    key, n = np.unique(keys, return_counts=True)
    row = key // CELLS
    return row, key % CELLS, n / np.bincount(row, n)[row]


def scores(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """The probability of label 1 of each row."""
    rows = len(offsets) - 1
    total, number = np.zeros(rows), np.zeros(rows)
    for cell, row in features(data, offsets):
        total += np.bincount(row, model.cells[cell], minlength=rows)
        number += np.bincount(row, minlength=rows)
    return 1 / (1 + np.exp(-np.clip(total / number + model.bias, -500, 500)))


def _begin() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, outputs (two rows, the last column the intercept), and sums of squared gradients of the vectors."""
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.uniform(-1 / WIDTH, 1 / WIDTH, (CELLS, WIDTH)).astype(np.float32), np.zeros((2, WIDTH + 1), np.float32), np.full(CELLS, START, np.float32)


def descend(vectors: np.ndarray, outputs: np.ndarray, squares: np.ndarray, cells: np.ndarray, shares: np.ndarray, label: int, weight: float, rate: float) -> None:
    """One step for one document, in place: plain for the outputs, scaled by their past gradients for the vectors."""
    mean = np.append(shares @ vectors[cells], 1).astype(np.float32)
    z = outputs @ mean
    p = np.exp(z - z.max())
    error = p / p.sum()
    error[label] -= 1
    error *= weight
    back = np.outer(shares, error @ outputs[:, :-1]).astype(np.float32)
    outputs -= rate * np.outer(error, mean)
    squares[cells] += (back * back).mean(1)
    vectors[cells] -= rate * back / np.sqrt(squares[cells])[:, None]


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(id, text, y) of the rows that the fit reads, and the number of labelled rows of each label."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("y").cast("int").alias("y"))
    number = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    order = [F.xxhash64(F.lit(43), "id"), F.col("id")]
    some = known.where("y = 0").orderBy(*order).limit(most_rows).unionByName(known.where("y = 1").orderBy(*order).limit(most_rows))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(small_side(materialize(some, "labelled")), "id")
    return rows.groupBy("id", "y").agg(F.min("text").alias("text")), number


def held_out(id_: Column) -> Column:
    """True for ids of the third that nothing is learned from; a null id is held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS, rounds: int = ROUNDS) -> Model:
    """The model of the labelled rows outside the held-out third.

    Of rows that repeat an id the least label and the least text count; null ids
    and labels are left out, a null text is empty, texts of any length are read
    whole.  Without rows of both labels every score is the share of label 1,
    or a half if there are none at all.
    """
    rows, number = _sample(docs, labels, id_col, text_col, label_col, most_rows)
    share = (number.get(1, 0) + 0.5) / (sum(number.values()) + 1)
    if not (number.get(0) and number.get(1)):
        return Model(np.zeros(CELLS, np.float32), float(np.log(share / (1 - share))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vt.buffers(batch["text"])
            y, order = batch["y"].to_numpy(), batch["order"].to_numpy()
            for first, last, chunk, own in vt.chunks(data, offsets):
                row, cell, share = counted(chunk, own)
                at = pa.array(np.searchsorted(row, np.arange(last - first + 1)).astype(np.int32))
                cells, shares = pa.ListArray.from_arrays(at, pa.array(cell.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(share.astype(np.float32)))
                yield pa.RecordBatch.from_arrays([pa.array(y[first:last]), pa.array(order[first:last]), cells, shares], names=["y", "order", "cells", "shares"])
        vt.give_back()

    # At most most_rows rows of each label, and of each row at most CELLS features.
    made = materialize(rows.withColumn("order", F.xxhash64(F.lit(47), "id")).mapInArrow(cut, "y int, order bigint, cells array<int>, shares array<float>"), "features")
    used = {r.y: r["count"] for r in made.groupBy("y").count().collect()}
    if len(used) < 2:
        return Model(np.zeros(CELLS, np.float32), float(np.log(share / (1 - share))))
    weight = {y: sum(used.values()) / (2 * n) for y, n in used.items()}
    shards = -(-sum(used.values()) // SHARD_ROWS)
    dealt = made.withColumn("shard", F.pmod("order", F.lit(shards)).cast("int"))
    vectors, outputs, squares = _begin()
    spark = docs.sparkSession
    for k in range(rounds):
        rate = RATE * (1 - k / rounds)
        common = spark.sparkContext.broadcast((vectors, outputs, squares))  # a few MB, by the size of the model

        def go_on(batches: Iterator[pa.RecordBatch], common=common, rate=rate) -> Iterator[pa.RecordBatch]:
            """The changes that each shard's rows make; the rows come by shard."""
            now, own = None, ()

            def changes() -> pa.RecordBatch:
                touched = np.flatnonzero(own[2] != common.value[2]).astype(np.int32)
                parts = [touched, own[0][touched] - common.value[0][touched], own[1] - common.value[1], own[2][touched] - common.value[2][touched]]
                return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()]) for x in parts], names=["cells", "vectors", "outputs", "squares"])

            for batch in batches:
                for i in range(batch.num_rows):
                    shard = batch["shard"][i].as_py()
                    if shard != now:
                        if now is not None:
                            yield changes()
                        now, own = shard, tuple(x.copy() for x in common.value)
                    label = batch["y"][i].as_py()
                    descend(*own, batch["cells"][i].values.to_numpy(), batch["shares"][i].values.to_numpy(), label, weight[label], rate)
            if now is not None:
                yield changes()

        # The order of rows differs from round to round, and is the same in every run.
        turn = dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64(F.lit(k), "order"), "order")
        found = turn.mapInArrow(go_on, "cells binary, vectors binary, outputs binary, squares binary").collect()  # a row for each shard
        common.unpersist()
        times, change, sums, out = np.zeros(CELLS, np.float32), np.zeros_like(vectors), np.zeros(CELLS, np.float32), np.zeros_like(outputs)
        for r in sorted(found, key=lambda r: bytes(r.cells)):
            cells = np.frombuffer(r.cells, np.int32)
            times[cells] += 1
            change[cells] += np.frombuffer(r.vectors, np.float32).reshape(-1, WIDTH)
            sums[cells] += np.frombuffer(r.squares, np.float32)
            out += np.frombuffer(r.outputs, np.float32).reshape(2, -1) / len(found)
        vectors, outputs, squares = vectors + change / np.maximum(times, 1)[:, None], outputs + out, squares + sums
    lead = outputs[1] - outputs[0]
    return Model((vectors @ lead[:-1]).astype(np.float32), float(lead[-1] + np.log(share / (1 - share))))


def score_quality(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score``, the probability of label 1.

    Texts of any length are read whole, a null text is an empty one, and an
    empty one has the score of the end of a text alone.  Equal texts have equal
    scores; an empty table gives an empty one.  A column named ``score`` is
    replaced; others pass through.
    """

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            data, offsets = vt.buffers(column)
            yield pa.array(np.concatenate([np.zeros(0), *(scores(chunk, own, model) for _, _, chunk, own in vt.chunks(data, offsets))]))
        vt.give_back()

    return docs.withColumn("score", score(F.col(text_col)))
