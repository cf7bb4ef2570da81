"""Measures of grey pictures: light, clipping, contrast, sharpness, and whether the middle stands out from the border."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pixels of a border, and of the margin about the middle, of a canvas of 256.
BORDER, MARGIN = 16, 48
MEASURES = ("sharpness", "mean", "p01", "p99", "clipping", "contrast", "presence")


def measure(values: np.ndarray, border: int = BORDER, margin: int = MARGIN) -> tuple[float, ...]:
    """The MEASURES of one picture; the edge is mirrored without its own line for the second derivative."""
    v = values.astype(np.float64)
    wide = np.pad(v, 1, mode="reflect")
    bend = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * v
    rim = np.concatenate([v[:border].ravel(), v[-border:].ravel(), v[:, :border].ravel(), v[:, -border:].ravel()])
    middle = v[margin:-margin, margin:-margin]
    p01, p99 = np.quantile(v, [0.01, 0.99])
    return float(bend.var()), float(v.mean()), float(p01), float(p99), float(((v <= 1) | (v >= 254)).mean()), float(v.std()), float(abs(middle.mean() - rim.mean()) / (rim.std() + 1))


def picture_quality(pictures: DataFrame, *, side: int = 256, border: int = BORDER, margin: int = MARGIN) -> DataFrame:
    """``pictures`` with the MEASURES of their ``values`` (side x side bytes), which goes; null values have null measures."""
    kept = [c for c in pictures.columns if c != "values"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pictures.schema if f.name != "values")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(np.frombuffer(v, np.uint8).reshape(side, side), border, margin) if v is not None else (None,) * len(MEASURES) for v in batch["values"].to_pylist()]
            columns = list(zip(*found, strict=True)) or [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *(pa.array(list(c), pa.float64()) for c in columns)], names=[*kept, *MEASURES])

    return pictures.mapInArrow(read, ", ".join(filter(None, [kinds, *(f"{m} double" for m in MEASURES)])))
