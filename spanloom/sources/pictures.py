"""Pictures from ``binaryFile`` rows: size and whole decoding of PNG and of binary PGM and PPM, and grey thumbnails.

A file is decoded within the task that read it, batch by batch; what leaves the
task is a thumbnail of fixed size.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: width and height of a thumbnail's canvas.
CANVAS = 256
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfilter(data: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """The bytes of PNG rows without their filters."""
    rows = np.frombuffer(data, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 0:
            made = line
        elif kind == 1:
            made = np.add.accumulate(line.reshape(-1, step), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            made = line + above
        else:
            made, up = bytearray(line.tobytes()), above.tobytes()
            for i in range(stride):
                left, corner = (made[i - step], up[i - step]) if i >= step else (0, 0)
                if kind == 3:
                    guess = (left + up[i]) >> 1
                elif kind == 4:
                    p, q, r = abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner)
                    guess = left if p <= q and p <= r else up[i] if q <= r else corner
                else:
                    raise ValueError("unknown row filter")
                made[i] = (made[i] + guess) & 255
            made = np.frombuffer(bytes(made), np.uint8)
        out[y] = above = made
    return out


def _png(raw: bytes) -> np.ndarray:
    at, parts, palette, head = 8, [], None, None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    else:
        raise ValueError("no end")
    width, height, depth, colour, _, _, woven = head
    if depth != 8 or woven or colour not in _CHANNELS:
        raise ValueError("only plain rows of 8 bits are read")
    n = _CHANNELS[colour]
    pixels = _unfilter(zlib.decompress(b"".join(parts)), height, width * n, n).reshape(height, width, n)
    return palette[pixels[:, :, 0]] if colour == 3 else pixels[:, :, : 1 if n == 2 else min(n, 3)]


def _pnm(raw: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while raw[at : at + 1].isspace() or raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1 if raw[at : at + 1] == b"#" else at + 1
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        fields.append(int(raw[at:end]))
        at = end
    width, height, most = fields
    n = 3 if raw[:2] == b"P6" else 1
    data = np.frombuffer(raw, np.uint8, width * height * n, at + 1)
    if most != 255:
        raise ValueError("only 8 bits are read")
    return data.reshape(height, width, n)


def decode(raw: bytes) -> np.ndarray:
    """Rows, columns and channels (1 or 3) of a picture; ValueError if it can't be read whole."""
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
        if raw[:2] in (b"P5", b"P6"):
            return _pnm(raw)
    except (struct.error, zlib.error, TypeError, IndexError) as e:
        raise ValueError(str(e)) from e
    raise ValueError("unknown format")


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of 8 bits, with the usual weights of red, green and blue."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0]
    weighted = pixels.astype(np.int64) @ np.array([19595, 38470, 7471])
    return ((weighted + 0x8000) >> 16).astype(np.uint8)


def _shrink(values: np.ndarray, size: int) -> np.ndarray:
    """Columns of 8-bit ``values`` brought down to ``size`` by a triangle as wide as the step, each rounded."""
    n = values.shape[1]
    if n == size:
        return values
    scale = n / size
    reach = max(scale, 1.0)
    out = np.empty((values.shape[0], size), np.uint8)
    for i in range(size):
        center = (i + 0.5) * scale
        low, high = max(0, int(center - reach + 0.5)), min(n, int(center + reach + 0.5))
        weight = np.maximum(0, 1 - np.abs((np.arange(low, high) - center + 0.5) / reach))
        out[:, i] = np.floor(values[:, low:high] @ (weight / weight.sum()) + 0.5)
    return out


def thumbnail(values: np.ndarray, canvas: int = CANVAS) -> np.ndarray:
    """A grey picture, made smaller if it must be, in the middle of a black canvas."""
    h, w = values.shape
    if max(h, w) > canvas:
        share = canvas / max(h, w)
        w2, h2 = (canvas, max(1, round(h * share))) if w >= h else (max(1, round(w * share)), canvas)
        values = _shrink(_shrink(values, w2).T, h2).T
        h, w = values.shape
    out = np.zeros((canvas, canvas), np.uint8)
    top, left = (canvas - h) // 2, (canvas - w) // 2
    out[top : top + h, left : left + w] = values
    return out


def read_pictures(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, ok, width, height, error, values) of the files of a folder; values are the CANVAS x CANVAS bytes of the thumbnail.

    A file that can't be decoded whole has ok false, why in error, and no size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch["content"].to_pylist():
                try:
                    pixels = decode(raw)
                    rows.append((True, pixels.shape[1], pixels.shape[0], "", thumbnail(grey(pixels)).tobytes()))
                except ValueError as e:
                    rows.append((False, None, None, str(e) or "unreadable", None))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch["path"], *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["path", "ok", "width", "height", "error", "values"])

    return files.mapInArrow(read, "path string, ok boolean, width int, height int, error string, values binary").select("path", "ok", "width", "height", "error", F.col("values"))
