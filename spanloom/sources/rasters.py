"""Float maps (``W&H&C&`` and little-endian floats) and tensor archives as DataFrames.

Files come through ``binaryFile``, so any store that Spark reads will do, and
are decoded in Arrow batches where they lie.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_float_map(data: bytes) -> np.ndarray:
    """(height, width, channels); a payload of another size is an error."""
    head, at = [], 0
    for _ in range(3):
        end = data.index(b"&", at)
        head.append(int(data[at:end]))
        at = end + 1
    w, h, c = head
    if len(data) - at != 4 * w * h * c:
        raise ValueError("float map payload has the wrong size")
    # Stored by column, then row, then channel.
    return np.frombuffer(data, "<f4", offset=at).reshape((w, h, c), order="F").transpose(1, 0, 2)


def read_float_maps(spark: SparkSession, path: str, glob: str = "*.bin") -> DataFrame:
    """(path, height, width, channels, values): a row for each map, values by row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [decode_float_map(x) for x in batch["content"].to_pylist()]
            shape = np.array([m.shape for m in maps], np.int32).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch["path"], *(pa.array(shape[:, i]) for i in range(3)), pa.array([m.ravel() for m in maps], pa.list_(pa.float32()))], names=["path", "height", "width", "channels", "values"])

    return files.mapInArrow(decode, "path string, height int, width int, channels int, values array<float>")


def map_pixels(maps: DataFrame) -> DataFrame:
    """(path, y, x, c, value) of each value of the maps."""
    rows = maps.select("path", "width", "channels", F.posexplode("values").alias("k", "value"))
    cell = F.floor(F.col("k") / F.col("channels"))
    return rows.select("path", F.floor(cell / F.col("width")).cast("int").alias("y"), (cell % F.col("width")).cast("int").alias("x"), (F.col("k") % F.col("channels")).alias("c"), "value")


def read_features(spark: SparkSession, path: str, glob: str = "*.npz") -> DataFrame:
    """(path, sha256, kp, x, y, score) of archives with keypoints and scores."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content, sha in zip(*(batch[c].to_pylist() for c in ("path", "content", "sha256")), strict=True):
                z = np.load(io.BytesIO(content), allow_pickle=False)
                k, s = z["keypoints"].astype(float), z["scores"].astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(k)), pa.array([sha] * len(k)), pa.array(np.arange(len(k))), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(s)], names=["path", "sha256", "kp", "x", "y", "score"])

    return files.mapInArrow(decode, "path string, sha256 string, kp bigint, x double, y double, score double")
