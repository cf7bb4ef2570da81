"""Language ID with bit-sliced Bloom filters of n-grams.

Each slot of the filter is a mask with a bit for each language.  An n-gram sets
its languages' bit in each of its PROBES slots; the AND of its slots is the
mask of all languages that may contain it.  A text's n-grams are looked up,
the hits of each language counted, and the counts corrected for the rate of
false positives of that language's slice; the largest decides.

The filter learns from at most about ``fit_docs`` documents of each language
(those of the least hash, chosen by rate), outside the held-out fold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectext as vt
from ..scratch import materialize, small_side

GRAMS = (3, 4)
PROBES = 3
FIT_DOCS = 1500
#: N-grams kept for each language at most, the most frequent ones; those of one step of frequency stay or go together.
MOST_GRAMS = 20_000
#: An n-gram is a language's own if it is at least so frequent there, relative to the language where it is most frequent.
LEAST_SHARE = 0.25

_CLEAN = vt.LOWER.copy()
_CLEAN[:128][~(((_CLEAN[:128] >= 97) & (_CLEAN[:128] <= 122)))] = 32


def gram_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the byte n-grams of each row, letters in lower case and all else of ASCII a space."""
    if len(data) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    clean = _CLEAN[data]
    size = len(data) - n + 1
    value = np.full(size, n, np.uint64)
    for k in range(n):
        value = value << np.uint64(8) | clean[k : k + size]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:size] == row[n - 1 :]
    # Runs of spaces say nothing.
    inside &= ~((clean[:size] == 32) & (clean[1 : size + 1] == 32)) if n > 1 else inside
    return vt.mix64(value[inside]), row[:size][inside]


def held_out(id_: Column, folds: int = 5) -> Column:
    """True for ids of the fold that nothing is learned from; a null id is held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == 0, F.lit(True))


class Filter:
    """Masks of languages by slot, with the false-positive rate of each language."""

    def __init__(self, langs: list[str], prior: list[int], grams: list[np.ndarray]):
        self.langs, self.first = langs, int(np.argmax(prior)) if prior else 0
        most = max((len(g) for g in grams), default=1)
        self.bits = max(12, math.ceil(math.log2(12 * max(1, most))))
        self.planes = [np.zeros(1 << self.bits, np.uint64) for _ in range(-(-len(langs) // 64))]
        for i, g in enumerate(grams):
            for slot in self._slots(g):
                self.planes[i // 64][slot] |= np.uint64(1) << np.uint64(i % 64)
        fill = [float(np.mean((self.planes[i // 64] >> np.uint64(i % 64)) & np.uint64(1))) for i in range(len(langs))]
        self.false = np.array([f**PROBES for f in fill])

    def _slots(self, hashes: np.ndarray) -> list[np.ndarray]:
        return [(hashes >> np.uint64(21 * k)) & np.uint64((1 << self.bits) - 1) for k in range(PROBES)]

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows x languages: the share of a row's n-grams that the language has, corrected."""
        rows = len(offsets) - 1
        hits, number = np.zeros((rows, len(self.langs))), np.zeros(rows)
        for n in GRAMS:
            hashes, row = gram_hashes(data, offsets, n)
            number += np.bincount(row, minlength=rows)
            slots = self._slots(hashes)
            edge = np.searchsorted(row, np.arange(rows + 1))
            for p, plane in enumerate(self.planes):
                mask = plane[slots[0]]
                for s in slots[1:]:
                    mask &= plane[s]
                for i in range(p * 64, min(len(self.langs), p * 64 + 64)):
                    total = np.r_[0, np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)]
                    hits[:, i] += total[edge[1:]] - total[edge[:-1]]
        share = hits / np.maximum(number, 1)[:, None]
        return np.clip((share - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, most_grams: int = MOST_GRAMS) -> Filter:
    """The filter of all languages outside the held-out fold.

    Null languages and texts are left out, and an empty table teaches nothing.
    Repeated rows count as often as they are there; texts of any length are
    read whole.  Two parameters bound the model: about ``fit_docs`` documents
    of each language are read, and the ``most_grams`` n-grams at most that are
    most frequent in it are kept.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null").where(~held_out(F.col("id")))
    number = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    langs = sorted(number)
    if not langs:
        return Filter([], [], [])
    spark = docs.sparkSession
    rates = spark.createDataFrame([(k, i, min(1.0, fit_docs / number[k])) for i, k in enumerate(langs)], "lang string, code int, rate double")
    some = rows.join(small_side(rates), "lang").where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) < F.col("rate") * (1 << 30)).select("text", "code")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vt.buffers(batch["text"])
            code = batch["code"].to_numpy().astype(np.int64)
            for first, last, chunk, own in vt.chunks(data, offsets):
                for n in GRAMS:
                    hashes, row = gram_hashes(chunk, own, n)
                    for i in np.unique(code[first:last]):
                        value, times = np.unique(hashes[code[first + row] == i], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), i, np.int32)), pa.array(np.full(len(value), n, np.int32)), pa.array(value.view(np.int64)), pa.array(times.astype(np.int64))], names=["lang", "size", "gram", "n"])

    made = some.mapInArrow(count, "lang int, size int, gram bigint, n bigint").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    made = materialize(made, "grams")
    totals = made.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    made = made.join(small_side(materialize(totals, "totals")), ["lang", "size"]).withColumn("f", F.col("n") / F.col("total"))
    top = made.groupBy("size", "gram").agg(F.max("f").alias("top"))
    made = made.join(top, ["size", "gram"]).where((F.col("n") >= 2) & (F.col("f") >= F.col("top") * LEAST_SHARE)).withColumn("step", F.floor(F.log2("f") * 64).cast("int"))
    made = materialize(made.select("lang", "gram", "step"), "own")
    # The step of frequency down to which the n-grams of a language are few enough; a row for each language and step.
    steps, cut = Counter(), []
    for r in made.groupBy("lang", "step").count().orderBy(F.desc("step")).collect():
        steps[r.lang] += r["count"]
        if steps[r.lang] <= most_grams:
            cut.append((r.lang, r.step))
    kept = made.join(small_side(spark.createDataFrame(cut, "lang int, step int")), ["lang", "step"])
    table = kept.select("lang", "gram").toArrow()  # at most most_grams rows a language
    lang, gram = table["lang"].to_numpy(), table["gram"].to_numpy().view(np.uint64)
    return Filter(langs, [number[k] for k in langs], [gram[lang == i] for i in range(len(langs))])


def predict(docs: DataFrame, model: Filter, *, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``language``: lang_pred and score (the part that the best language has of the sum of corrected shares, 0 to 1).

    ``und`` if the text is null or has no letter, or if nothing was learned.
    A text without any known n-gram gets the language of most learned
    documents, with score 0; of equal shares the first language in the order of
    names counts.  A column named ``language`` is replaced; others pass through.
    """

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def tell(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            data, offsets = vt.buffers(column)
            names, scores = [], []
            for _, _, chunk, own in vt.chunks(data, offsets):
                share = model.shares(chunk, own)
                best = np.where(share.any(1), share.argmax(1), model.first)
                ranked = np.sort(share, 1)
                total = share.sum(1)
                scores.append(np.where(total > 0, ranked[:, -1] / np.maximum(total, 1e-12), 0.0))
                names += [model.langs[i] for i in best]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["lang_pred", "score"])

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    unknown = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if not model.langs:
        return docs.withColumn("language", unknown)
    return docs.withColumn("language", tell(F.col(text_col))).withColumn("language", F.when(letters, F.col("language")).otherwise(unknown))
