"""Pictures: decoding against the bytes they were made of, thumbnails, and measures."""

import struct
import zlib

import numpy as np
import pytest

from spanloom.operators import pictures as measures
from spanloom.sources import pictures


def png(pixels, colour, filters, palette=None):
    """A PNG of rows with the given filters in turn."""
    h, w, n = pixels.shape
    rows, above = b"", np.zeros(w * n, int)
    for y in range(h):
        line, kind = pixels[y].ravel().astype(int), filters[y % len(filters)]
        left, corner = np.r_[np.zeros(n, int), line[:-n]], np.r_[np.zeros(n, int), above[:-n]]
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        rows += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda kind, body: struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))
    packed = zlib.compress(rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", packed[:20]) + chunk(b"IDAT", packed[20:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,n", [(0, 1), (2, 3), (4, 2), (6, 4), (3, 1)])
def test_decoding_of_every_filter(colour, n):
    rng = np.random.default_rng(colour)
    pixels = rng.integers(0, 256, (11, 7, n), np.uint8)
    palette = rng.integers(0, 256, (256, 3), np.uint8) if colour == 3 else None
    raw = png(pixels, colour, (0, 1, 2, 3, 4), palette)
    want = palette[pixels[:, :, 0]] if colour == 3 else pixels[:, :, : {1: 1, 2: 1, 3: 3, 4: 3}[n]]
    assert (pictures.decode(raw) == want).all()
    for broken in (raw[:-5], raw[:60] + b"x" + raw[61:], b"GIF89a", b"", b"P5 3 3 255\n12"):
        with pytest.raises(ValueError):
            pictures.decode(broken)


def test_pnm_and_grey():
    data = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (pictures.decode(b"P6\n# made by hand\n4 2\n255\n" + data.tobytes()) == data).all()
    assert (pictures.decode(b"P5 4 2 255\n" + data[:, :, 0].tobytes())[:, :, 0] == data[:, :, 0]).all()
    assert pictures.grey(np.array([[[255, 255, 255], [255, 0, 0], [0, 255, 0], [0, 0, 255]]], np.uint8)).tolist() == [[255, 76, 150, 29]]


def test_thumbnails():
    small = np.full((10, 20), 9, np.uint8)
    out = pictures.thumbnail(small)
    assert out.shape == (256, 256) and (out[123:133, 118:138] == 9).all() and out.sum() == 9 * 200
    flat = pictures.thumbnail(np.full((1000, 2000), 77, np.uint8))
    assert (flat[64:192] == 77).all() and not flat[:64].any() and not flat[192:].any()
    ramp = pictures.thumbnail(np.tile(np.arange(512) // 2, (512, 1)).astype(np.uint8)).astype(int)
    assert np.abs(ramp - np.arange(256)).max() <= 1


def test_measures():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 256, (256, 256), np.uint8)
    v[100:150, 100:150] = 255
    got = dict(zip(measures.MEASURES, measures.measure(v), strict=True))
    at = lambda y, x: int(v[abs(y) if y < 256 else 510 - y, abs(x) if x < 256 else 510 - x])
    bend = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(256) for x in range(256)]
    rim = [*v[:16].ravel(), *v[-16:].ravel(), *v[:, :16].ravel(), *v[:, -16:].ravel()]
    assert got["sharpness"] == pytest.approx(np.var(bend)) and got["contrast"] == pytest.approx(v.std()) and got["clipping"] == pytest.approx(np.mean((v <= 1) | (v >= 254)))
    assert got["presence"] == pytest.approx(abs(v[48:208, 48:208].mean() - np.mean(rim)) / (np.std(rim) + 1)) and (got["p01"], got["p99"]) == tuple(np.quantile(v, [0.01, 0.99]))


def test_files_to_measures(spark, tmp_path):
    rng = np.random.default_rng(5)
    made = {"a.png": rng.integers(0, 256, (300, 200, 3), np.uint8), "b.png": rng.integers(0, 256, (40, 50, 3), np.uint8)}
    for name, pixels in made.items():
        (tmp_path / name).write_bytes(png(pixels, 2, (1, 2)))
    (tmp_path / "c.png").write_bytes(b"\x89PNG\r\n\x1a\nnothing")
    (tmp_path / "d.txt").write_bytes(b"no picture")
    got = {r.path.rsplit("/", 1)[1]: r for r in measures.picture_quality(pictures.read_pictures(spark, str(tmp_path), "*.png")).collect()}
    assert set(got) == {"a.png", "b.png", "c.png"} and (got["a.png"].width, got["a.png"].height, got["a.png"].ok) == (200, 300, True)
    assert not got["c.png"].ok and got["c.png"].width is None and got["c.png"].mean is None and got["c.png"].error
    for name, pixels in made.items():
        want = measures.measure(pictures.thumbnail(pictures.grey(pixels)))
        assert tuple(got[name][m] for m in measures.MEASURES) == pytest.approx(want)
