"""Poses of pairs, overrides and bases: errors, missing ends and what NumPy says."""

import numpy as np
import pytest

from spanloom.operators import poses

CAMERAS = "name string, rotation array<double>, center array<double>"


def turn(seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def test_pose_metrics(spark):
    made = {n: (turn(i), np.arange(3.0) * i) for i, n in enumerate("abc", 1)}
    cameras = spark.createDataFrame([(n, r.ravel().tolist(), c.tolist()) for n, (r, c) in made.items()], CAMERAS)
    got = {(r.first, r.second): r for r in poses.pose_metrics(spark.createDataFrame([("a", "b"), ("c", "a"), ("a", "z"), ("z", "y")], "first string, second string"), cameras).collect()}
    for x, y in (("a", "b"), ("c", "a")):
        (r1, c1), (r2, c2), r = made[x], made[y], got[x, y]
        assert np.allclose(np.reshape(r.relative_rotation, (3, 3)), r2 @ r1.T)
        assert r.rotation_deg == pytest.approx(np.degrees(np.arccos(np.clip((np.trace(r2 @ r1.T) - 1) / 2, -1, 1)))) and r.center_jump == pytest.approx(np.linalg.norm(c2 - c1))
        assert r.ray_jump_deg == pytest.approx(np.degrees(np.arccos(np.clip(r1[2] @ r2[2], -1, 1))))
    assert all(got[k][c] is None for k in (("a", "z"), ("z", "y")) for c in ("relative_rotation", "rotation_deg", "center_jump", "ray_jump_deg"))


def test_overrides_fit_their_rays(spark):
    k1, k2, r, t = [100.0, 110.0, 50.0, 40.0], [90.0, 95.0, 45.0, 55.0], turn(5), np.array([0.3, -2.0, 1.0])
    kinds = "rotation array<double>, translation array<double>, k1 array<double>, k2 array<double>"
    make = lambda r, t: poses.pose_overrides(spark.createDataFrame([(r, t, k1, k2)], kinds))
    got = make(r.ravel().tolist(), t.tolist()).first()
    assert np.linalg.norm(got.translation) == pytest.approx(1)
    f, e = np.reshape(got.fundamental, (3, 3)), np.reshape(got.essential, (3, 3))
    for p in np.random.default_rng(1).normal(size=(20, 3)) + [0, 0, 6]:
        q = r @ p + t / np.linalg.norm(t)
        a, b = (np.array([k[0] * v[0] / v[2] + k[2], k[1] * v[1] / v[2] + k[3], 1]) for k, v in ((k1, p), (k2, q)))
        assert abs(b @ f @ a) < 1e-9 and abs(q @ e @ p) < 1e-9
    for odd, match in ((([1.0] * 9, [1.0, 0, 0]), "determinant"), ((np.eye(3).ravel().tolist()[:8], [1.0, 0, 0]), "whole"), ((np.eye(3).ravel().tolist(), [0.0, 0.0, 0.0]), "direction"), ((np.eye(3).ravel().tolist(), None), "direction")):
        with pytest.raises(Exception, match=match):
            make(odd[0], None if odd[1] is None else [float(x) for x in odd[1]]).collect()


def test_projective_error(spark):
    nan = float("nan")
    rows = [([float(x) for x in range(9)], [-2.0 * x for x in range(9)]), ([1.0] * 9, [0.0] * 9), ([nan] + [1.0] * 8, [1.0] * 9), ([1.0] * 8, [1.0] * 9), (None, [1.0] * 9), ([1.0] * 8 + [2.0], [1.0] * 9)]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(poses.projective_error("a", "b")).collect()]
    assert got[0] == pytest.approx(0, abs=1e-12) and got[1:5] == [float("inf")] * 4 and got[5] == pytest.approx(2 - 10 / 9)


def test_basis(spark):
    rng = np.random.default_rng(2)
    cloud = rng.normal(size=(200, 3)) * [1, 2, 5] + [3, 0, 0]
    points = spark.createDataFrame(cloud.tolist(), "x double, y double, z double")
    for eyes in ([[10.0, 0, 0], [-10.0, 1, 0], [0.0, 10, 0], [0.0, -9, 0]], [[0.0, 8, 1]], []):
        cameras = spark.createDataFrame([(f"c{i}", *map(float, e)) for i, e in enumerate(eyes)], "name string, x double, y double, z double")
        b = poses.vertical_basis(points, cameras).first()
        center, v, f, r = (np.array(b[k]) for k in ("center", "vertical", "front", "right"))
        assert np.allclose(center, np.median(cloud, 0)) and np.allclose([v @ v, f @ f, r @ r], 1) and np.allclose([v @ f, v @ r, f @ r], 0, atol=1e-9) and np.allclose(np.cross(v, f), r)
        want = np.linalg.svd(np.array(eyes) - np.mean(eyes, 0))[2][-1] if len(eyes) >= 3 else np.linalg.eigh(np.cov(cloud.T))[1][:, -1]
        assert abs(v @ want) == pytest.approx(1) and np.median((cloud - center) @ v) >= -1e-12
        if eyes:
            assert (np.array(eyes[0]) - center) @ f > 0


def test_registered_manifest(spark):
    records = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "filename string, size int")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "filename string")
    assert sorted(r.filename for r in poses.registered_manifest(records, names("c", "a"), 2).collect()) == ["a", "c"]
    for bad in ((names("a", "a"), 2), (names("a"), 2), (names("a", "z"), 2)):
        with pytest.raises(ValueError):
            poses.registered_manifest(records, *bad)
