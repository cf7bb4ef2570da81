"""Masks as runs against arrays of pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import masks

RUNS, FRAMES = "image string, y bigint, x0 bigint, x1 bigint", "image string, width bigint, height bigint"


def runs_of(pixels, rng=None):
    """Runs of a mask; with ``rng`` cut in pieces that overlap, among empty ones."""
    out = []
    for y, row in enumerate(pixels):
        edge = np.flatnonzero(np.diff(np.r_[0, row.astype(int), 0]))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            cut = a + int(rng.integers(0, b - a + 1)) if rng is not None else b
            out += [(y, a, cut), (y, max(a, cut - 1), b)] if cut < b else [(y, a, b)]
    return out


def pixels_of(rows, shape):
    out = np.zeros(shape, bool)
    for r in rows:
        assert not out[r.y, r.x0 : r.x1].any(), "runs overlap"
        out[r.y, r.x0 : r.x1] = True
    return out


def window(pixels, radius, outside, all_):
    """Whether any or all of the square about each pixel is set; beyond the frame is ``outside``."""
    wide = np.pad(pixels, radius, constant_values=outside)
    h, w = pixels.shape
    near = np.stack([wide[a : a + h, b : b + w] for a in range(2 * radius + 1) for b in range(2 * radius + 1)])
    return near.all(0) if all_ else near.any(0)


def parts_of(pixels):
    """Label of each pixel, from 1 in raster order; neighbours touch at corners too."""
    label = np.zeros(pixels.shape, int)
    for y, x in zip(*np.nonzero(pixels)):
        if not label[y, x]:
            n, todo = label.max() + 1, [(y, x)]
            label[y, x] = n
            while todo:
                a, b = todo.pop()
                for c in range(max(0, a - 1), min(pixels.shape[0], a + 2)):
                    for d in range(max(0, b - 1), min(pixels.shape[1], b + 2)):
                        if pixels[c, d] and not label[c, d]:
                            label[c, d] = n
                            todo.append((c, d))
    return label


@pytest.fixture(scope="module")
def drawn(spark):
    rng = np.random.default_rng(9)
    made = {"empty": np.zeros((6, 9), bool), "full": np.ones((7, 8), bool), "finial": np.zeros((40, 30), bool)}
    made["finial"][8:32, 10:20] = made["finial"][2:5, 14:16] = True
    for k, share in enumerate((0.1, 0.3, 0.6, 0.9)):
        blocks = rng.random((5, 6)) < share
        made[f"m{k}"] = np.kron(blocks, np.ones((4, 5), bool)) ^ (rng.random((20, 30)) < 0.03)
    rows = [(k, *r) for k, m in made.items() for r in runs_of(m, rng)] + [("m0", 3, 5, 5)]
    runs = spark.createDataFrame(rows, RUNS).repartition(3)
    return made, runs, spark.createDataFrame([(k, m.shape[1], m.shape[0]) for k, m in made.items()], FRAMES)


def by_image(df, made, *key):
    rows = df.collect()
    return {k: pixels_of([r for r in rows if r.image == k[0] and all(r[c] == v for c, v in zip(key, k[1:]))], made[k[0]].shape) for k in {(r.image, *[r[c] for c in key]) for r in rows}}


@pytest.mark.parametrize("radius", [1, 2, 6])
def test_morphology(drawn, radius):
    made, runs, frames = drawn
    big, small = by_image(masks.dilate(runs, frames, radius), made), by_image(masks.erode(runs, frames, radius), made)
    for k, m in made.items():
        none = np.zeros(m.shape, bool)
        assert (big.get((k,), none) == window(m, radius, False, False)).all()
        assert (small.get((k,), none) == window(m, radius, True, True)).all()


def test_set_algebra(drawn):
    made, runs, frames = drawn
    moved = runs.select("image", "y", (F.col("x0") + 3).alias("x0"), (F.col("x1") + 3).alias("x1"))
    both, less = (f(runs, masks._framed(moved, frames).select("image", "y", "x0", "x1")) for f in (masks.intersect_runs, masks.subtract_runs))
    both, less, one = by_image(both, made), by_image(less, made), by_image(masks.union_runs(runs), made)
    for k, m in made.items():
        none, other = np.zeros(m.shape, bool), np.pad(m, ((0, 0), (3, 0)))[:, : m.shape[1]]
        assert (one.get((k,), none) == m).all() and (both.get((k,), none) == (m & other)).all() and (less.get((k,), none) == (m & ~other)).all()


def test_parts_and_diagnostics(drawn):
    made, runs, frames = drawn
    kept, removed = masks.largest_part(runs)
    kept, removed = by_image(kept, made), {r.image: r.removed for r in removed.collect()}
    told = {r.image: r for r in masks.mask_diagnostics(runs, frames).collect()}
    assert set(told) == set(made)
    for k, m in made.items():
        label, r = parts_of(m), told[k]
        areas = np.bincount(label.ravel())[1:]
        assert (r.pixels, r.parts) == (m.sum(), len(areas)) and r.fraction == pytest.approx(m.mean())
        low = m[int(m.shape[0] * 0.72) :].sum(1)
        assert r.base_support == low.max() and r.base_warning == (low.max() > 0.45 * m.shape[1])
        if not m.any():
            assert (r.x, r.top, r.w, r.h, r.cx, r.cy, r.largest_fraction, r.second_fraction) == (0, 0, 0, 0, None, None, 0, 0)
            continue
        ys, xs = np.nonzero(m)
        assert (r.x, r.top, r.w, r.h) == (xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1) and (r.cx, r.cy) == pytest.approx((xs.mean(), ys.mean()))
        order = np.sort(areas)[::-1]
        assert r.largest_fraction == pytest.approx(order[0] / m.sum()) and r.second_fraction == pytest.approx(order[1] / order[0] if len(order) > 1 else 0)
        best = label == 1 + areas.argmax()
        assert (kept[k,] == best).all() and removed[k] == m.sum() - best.sum()


@pytest.mark.parametrize("margin,band", [(2, 3), (1, 0), (0, 2)])
def test_products(drawn, margin, band):
    made, runs, frames = drawn
    got = by_image(masks.mask_products(runs, frames, margin=margin, band=band), made, "product")
    for k, m in made.items():
        eroded = window(m, margin, True, True)
        edge, label, feature = m & ~eroded, parts_of(m), eroded.copy()
        for n in range(1, label.max() + 1):
            if (label == n).sum() < 256 and edge[label == n].any():
                feature |= label == n
        wide = window(edge, band, False, False) & m
        none = np.zeros(m.shape, bool)
        for name, want in (("full", m), ("mvs", m), ("feature", feature), ("boundary", wide)):
            assert (got.get((k, name), none) == want).all(), (k, name)
    assert margin == 0 or got["finial", "feature"][2:5, 14:16].all()


def camera(name, ring, width=100, height=100, shift=0.0):
    return (name, ring, [float(v) for v in (1, 0, 0, shift, 0, 1, 0, 0, 0, 0, 1, 0)], [50.0] * 4, width, height)


CAMERAS = "image string, ring string, m array<double>, k array<double>, width bigint, height bigint"


def test_projection_of_a_cloud_inside_its_mask(spark):
    square = [("a.jpg", y, 25, 76) for y in range(25, 76)]
    cloud = spark.createDataFrame([((x - 50) / 50, (y - 50) / 50, 1.0) for x in range(35, 66, 5) for y in range(35, 66, 5)], "x double, y double, z double")
    views = masks.mask_projection(cloud, spark.createDataFrame([camera("a.jpg", "g1")], CAMERAS), spark.createDataFrame(square, RUNS), spark.createDataFrame([("a.jpg", 100, 100)], FRAMES))
    v = views.first()
    assert (v.projected, v.inside, v.mask_area, v.precision) == (49, 49, 51 * 51, 1.0) and v.recall == pytest.approx(41 * 41 / 51**2) and v.iou == pytest.approx(41 * 41 / 51**2)
    g = masks.projection_gate(views, spark.createDataFrame([("g1",)], "ring string")).first()
    assert g.passed and not g.reasons and len(g.checks) == 9
    other = masks.projection_gate(views, spark.createDataFrame([("g1",), ("g2",)], "ring string")).first()
    assert other.reasons == ["all_selected_rings_measured"]


def test_projection_with_odd_points_and_masks(spark):
    nan, inf = float("nan"), float("inf")
    # On the edge of rounding, behind, far, beyond the frame after rounding, at infinity, repeated, null.
    points = [(0.5, 0.5, 1.0), (0.5, 0.5, 1.0), (-1.0, -1.0, 1.0), (0.99, 0.99, 1.0), (0.995, 0.0, 1.0), (0, 0, -1.0), (0, 0, 0.0), (nan, 0, 1.0), (inf, 0, 1.0), (None, 0, 1.0), (0.01, 0.03, 1.0), (9.0, 9.0, 1.0)]
    cloud = spark.createDataFrame([tuple(None if v is None else float(v) for v in p) for p in points], "x double, y double, z double")
    cameras = spark.createDataFrame([camera("a", "r"), camera("none", "r"), camera("size", "q"), camera("dark", "q")], CAMERAS)
    mask = spark.createDataFrame([("a", 75, 70, 80), ("a", 75, 75, 200), ("a", 99, 99, 100), ("size", 0, 0, 9)], RUNS)
    frames = spark.createDataFrame([("a", 100, 100), ("size", 99, 100), ("dark", 100, 100)], FRAMES)
    got = {v.image: v for v in masks.mask_projection(cloud, cameras, mask, frames, radius=1).collect()}
    assert {k: v.status for k, v in got.items()} == {"a": "measured", "none": "missing_mask", "size": "shape_mismatch", "dark": "measured"}
    assert got["none"].precision is None and got["size"].projected is None
    # (75,75) twice, (0,0), (100-ish cut): 0.99 -> 99.5 rounds to 100 and is out; 0.01 -> 50.5 rounds to 50, 0.03 -> 51.5 to 52.
    pixels = {(75, 75): 2, (0, 0): 1, (50, 52): 1}
    m = np.zeros((100, 100), bool)
    m[75, 70:100] = m[99, 99] = True
    foot = np.zeros((100, 100), bool)
    for x, y in pixels:
        foot[y, x] = True
    foot = window(foot, 1, False, False)
    a = got["a"]
    assert (a.projected, a.inside, a.mask_area) == (4, 2, 31) and a.precision == 0.5
    assert a.recall == pytest.approx((foot & m).sum() / 31) and a.iou == pytest.approx((foot & m).sum() / (foot | m).sum())
    assert (got["dark"].precision, got["dark"].recall, got["dark"].iou, got["dark"].mask_area) == (0.0, 0.0, 0.0, 0)
    rings = {r.ring: r for r in masks.ring_projection(spark.createDataFrame(list(got.values()))).collect()}
    assert rings["q"].views == 1 and rings["r"].precision_p50 == 0.5
    empty = masks.projection_gate(spark.createDataFrame([], "image string, ring string, status string, precision double, recall double, iou double"), spark.createDataFrame([], "ring string")).first()
    assert not empty.passed and empty.reasons == ["view_precision_p10", "view_recall_p10", "view_iou_p10", "all_selected_rings_measured", "ring_precision_mean", "ring_recall_mean", "ring_iou_mean"]
