"""Quality rules: counts of each whole text and a calibrated classifier of hashed n-grams.

The classifier is a logistic regression over hashed white-space words, word
pairs and byte 4-grams (relative frequencies, so that length doesn't matter).
It is trained on at most ``most_rows`` labelled rows of each class, those of
the least hash, so the fit is the same at every size and in every run; a
quarter of them is held back to calibrate the scores to probabilities (Platt),
weighted back to the true share of the classes.  The weights (128 KB) travel
with the scoring function, which reads whole texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as vt

#: Hashed features; the last slot of the weights is the intercept.
CELLS = 1 << 15
#: Labelled rows of each class that the fit uses at most.
MOST_ROWS = 1200
#: A document is rejected if the calibrated probability of good quality is below this.
LEAST_QUALITY = 0.25
#: Base rules: fewest words, and most words in repeated 5-word windows in percent.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SCALE = 60.0


def _per_row(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flag, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """True for each value that occurs more than once in its row."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    same = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    out = np.zeros(len(h), bool)
    out[order] = np.r_[same, False] | np.r_[False, same] if len(h) else out
    return out


def counts(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The base counts of each row, and the hash and row of each word."""
    rows = len(offsets) - 1
    solid = vt.SOLID[data]
    start, end, row = vt.runs(solid, offsets)
    words = vt.span_hashes(data, start, end)
    n_words = np.bincount(row, minlength=rows)
    chars = _per_row(solid & ((data & 0xC0) != 0x80), offsets)

    n = len(words)
    hit = np.zeros(n + 1, np.int64)
    if n >= WINDOW:
        whole = np.flatnonzero(row[: n - WINDOW + 1] == row[WINDOW - 1 :])
        spans, of = vt.windows(words, row, WINDOW, short=False)
        at = whole[_repeats(spans, of)]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + WINDOW, -1)
    in_repeat = np.cumsum(hit)[:n] > 0

    begin, stop, line_row = vt.runs(data != 10, offsets)
    filled = np.r_[0, np.cumsum(solid, dtype=np.int64)]
    real = filled[stop] > filled[begin]
    begin, stop, line_row = begin[real], stop[real], line_row[real]
    lines = vt.span_hashes(data, begin, stop)
    order = np.lexsort((lines, line_row))
    again = (lines[order][1:] == lines[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    out = {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": _per_row(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_row[order][1:][again], minlength=rows),
        "n_repeat_words": np.bincount(row[in_repeat], minlength=rows),
    }
    return out, words, row


def features(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cell, row) of each occurrence, one kind of n-gram after the other; rows are in order."""
    yield (words >> np.uint64(20)).astype(np.int64) & (CELLS - 1), row
    pairs, of = vt.windows(words, row, 2, short=False)
    yield (pairs >> np.uint64(20)).astype(np.int64) & (CELLS - 1), of
    if len(data) >= 4:
        gram = data[:-3].astype(np.uint32) | data[1:-2].astype(np.uint32) << 8 | data[2:-1].astype(np.uint32) << 16 | data[3:].astype(np.uint32) << 24
        cell = ((gram * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64) & (CELLS - 1)
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = of[:-3] == of[3:]
        yield cell[inside], of[:-3][inside]


def raw_scores(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    score = np.full(rows, float(weights[CELLS]))
    for cell, of in features(data, offsets, words, row):
        number = np.bincount(of, minlength=rows)
        score += _SCALE * np.bincount(of, weights[cell], minlength=rows) / np.maximum(number, 1)
    return score


def fit(texts: pa.Array, good: np.ndarray, share: float, rounds: int = 120, penalty: float = 1e-3) -> tuple[np.ndarray, float, float]:
    """Weights, and the slope and intercept of the calibration; ``share`` is the true share of good rows."""
    data, offsets = vt.buffers(texts)
    cells, rows, values = [], [], []
    for first, _, chunk, own in vt.chunks(data, offsets):
        _, words, row = counts(chunk, own)
        for cell, of in features(chunk, own, words, row):
            number = np.bincount(of, minlength=len(own) - 1)
            key, n = np.unique(of * CELLS + cell, return_counts=True)
            cells.append(key % CELLS)
            rows.append(key // CELLS + first)
            values.append(_SCALE * n / number[key // CELLS])
    cell, row, value = (np.concatenate(x) if x else np.zeros(0) for x in (cells, rows, values))
    cell, row = cell.astype(np.int64), row.astype(np.int64)
    held = np.arange(len(good)) % 4 == 3
    y = good.astype(float)
    balance = np.where(good, 0.5 / max(good[~held].mean(), 1e-9), 0.5 / max(1 - good[~held].mean(), 1e-9)) * ~held
    w, total = np.zeros(CELLS + 1), np.full(CELLS + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, value * w[cell], minlength=len(y)) + w[CELLS]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        grad = np.r_[np.bincount(cell, value * error[row], minlength=CELLS), error.sum()] / max(1, (~held).sum()) + penalty * w
        total += grad * grad
        w -= 0.3 * grad / np.sqrt(total)
    z = np.bincount(row, value * w[cell], minlength=len(y)) + w[CELLS]
    weight = np.where(good, share / max(good[held].mean(), 1e-9), (1 - share) / max(1 - good[held].mean(), 1e-9))[held] if held.any() else np.zeros(0)
    a, b = 1.0, 0.0
    pos, neg = held.sum() * share, held.sum() * (1 - share)
    target = np.where(good[held], (pos + 1) / (pos + 2), 1 / (neg + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z[held] + b, -30, 30)))
        g = np.array([(weight * (p - target) * z[held]).sum(), (weight * (p - target)).sum()])
        q = weight * p * (1 - p)
        h = np.array([[(q * z[held] ** 2).sum() + 1e-3, (q * z[held]).sum()], [(q * z[held]).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return w, max(a, 1e-3), b


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> tuple[np.ndarray, float, float] | None:
    """The model, or None if the labelled texts aren't of both classes.

    Of rows that repeat an id the least label and the least text count; null ids, labels and texts are left out.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    number = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if len(number) < 2:
        return None
    order = [F.xxhash64(F.lit(29), "id"), F.col("id")]
    some = known.where("y = 0").orderBy(*order).limit(most_rows).unionByName(known.where("y = 1").orderBy(*order).limit(most_rows))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(some), "id")  # at most 2 * most_rows ids
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text"))
    share = number[1] / (number[0] + number[1])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        table = pa.Table.from_batches(found).sort_by([("order", "ascending"), ("id", "ascending"), ("text", "ascending")])
        good = table["y"].to_numpy() == 1
        if good.any() and not good.all():
            w, a, b = fit(table["text"].combine_chunks(), good, share)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([a]), pa.array([b])], names=["w", "a", "b"])

    made = rows.withColumn("order", F.xxhash64(F.lit(31), "id")).repartition(1).mapInArrow(learn, "w binary, a double, b double").collect()
    return (np.frombuffer(bytes(made[0].w)), made[0].a, made[0].b) if made else None


SCORES = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,p_good:double>"


def _scorer(model: tuple[np.ndarray, float, float] | None):
    weights, a, b = (model[0].astype(np.float32), *model[1:]) if model else (None, 1.0, 0.0)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    @F.arrow_udf(SCORES)
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            data, offsets = vt.buffers(column)
            parts: dict[str, list[np.ndarray]] = {k: [] for k in [*names, "p"]}
            for _, _, chunk, own in vt.chunks(data, offsets):
                found, words, row = counts(chunk, own)
                for k in names:
                    parts[k].append(found[k])
                z = raw_scores(chunk, own, words, row, weights) if weights is not None else np.full(len(own) - 1, 30.0)
                parts["p"].append(1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))))
            whole = {k: np.concatenate(v) if v else np.zeros(0) for k, v in parts.items()}
            yield pa.StructArray.from_arrays([*(pa.array(whole[k], pa.int64()) for k in names), pa.array(whole["p"], pa.float64())], names=[*names, "p_good"])
        vt.give_back()

    return score


def judge_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_quality: float = LEAST_QUALITY, most_rows: int = MOST_ROWS) -> DataFrame:
    """``docs`` with a struct ``quality``: the counts, p_good, base_failed and kept.

    A null or empty text has no words, so it fails the base rules.  Texts of any
    length are read whole; repeated rows are judged alike.  Without labels of
    both classes the base rules decide alone.  An empty table gives an empty
    one.  A column named ``quality`` is replaced; others pass through.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, most_rows=most_rows)
    q = F.col("quality")
    failed = (q["n_words"] < LEAST_WORDS) | (q["n_repeat_words"] * 100 > q["n_words"] * MOST_REPEATED)
    out = docs.withColumn("quality", _scorer(model)(F.col(text_col)))
    return out.withColumn("quality", F.struct("quality.*", failed.alias("base_failed"), (~failed & (q["p_good"] >= least_quality)).alias("kept")))
