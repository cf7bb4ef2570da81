"""Repaired rotations against a search by hand, and the cases that must come out."""

import time

import numpy as np
import pytest

from spanloom.operators import graph, rotation

RECORDS = "pair_id bigint, first string, second string, ring string, second_ring string, same_ring boolean, rotation array<double>, inliers bigint, conditioned boolean"


def about(axis, degrees):
    a, t = np.array(axis, float) / np.linalg.norm(axis), np.radians(degrees)
    k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    return np.eye(3) + np.sin(t) * k + (1 - np.cos(t)) * k @ k


def random_rotation(rng):
    return about(rng.normal(size=3), rng.uniform(0, 180))


def angle(a, b):
    return float(np.degrees(np.arccos(np.clip((np.sum(a * b) - 1) / 2, -1, 1))))


def record(pair, first, second, turn, inliers=400, conditioned=True):
    return (pair, first, second, first[0], second[0], first[0] == second[0], np.asarray(turn).ravel().tolist(), inliers, conditioned)


def frames(spark, records, reference=()):
    return spark.createDataFrame(records, RECORDS), spark.createDataFrame([(n, m.ravel().tolist()) for n, m in reference], "name string, rotation array<double>")


def matrices(df):
    return {r.name: np.array(r.rotation).reshape(3, 3) for r in df.collect()}


def islands_by_hand(records, reference, threshold=30.0):
    """Growth from the largest island of each ring, one best link after the other."""
    ref = dict(reference)
    edges = []
    for pair, a, b, ra, rb, same, turn, inliers, conditioned in records:
        if conditioned and a in ref and b in ref:
            m, source = np.array(turn).reshape(3, 3), ref[b] @ ref[a].T
            edges.append((pair, a, b, same and ra == rb, max(1, inliers), m, source, angle(source, m), ra))
    of = {n: n for n in ref}
    for _ in ref:
        for _, a, b, same, _, _, _, off, _ in edges:
            if same and off <= threshold:
                of[a] = of[b] = min(of[a], of[b])
    ring = {n: e[8] for e in edges if e[3] for n in e[1:3]}
    size = {i: sum(v == i for v in of.values()) for i in of.values()}
    anchors = {max(((size[of[n]], of[n]) for n in ring if ring[n] == r))[1] for r in set(ring.values())}
    links = {}
    for e in edges:
        key = frozenset((of[e[1]], of[e[2]]))
        rank = (-e[3], -e[4], e[7], e[0])
        if len(key) == 2 and (key not in links or rank < links[key][0]):
            links[key] = rank, e
    turn = {a: np.eye(3) for a in anchors}
    while True:
        ready = [v for k, v in links.items() if len(k & set(turn)) == 1]
        if not ready:
            break
        _, (_, a, b, _, _, m, source, _, _) = min(ready, key=lambda v: v[0])
        if of[a] in turn:
            turn[of[b]] = m @ turn[of[a]] @ source.T
        else:
            turn[of[a]] = m.T @ turn[of[b]] @ source
    return {n: turn.get(of[n], np.eye(3)) @ m for n, m in ref.items()}, of, set(turn)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_islands_against_growth_by_hand(spark, seed):
    rng = np.random.default_rng(seed)
    names = [f"{r}{i}" for r in "abc" for i in range(9)] + ["z0"]
    reference = [(n, random_rotation(rng)) for n in names]
    records = []
    for k in range(70):
        a, b = sorted(rng.choice(27, 2, replace=False))
        if a // 9 != b // 9 and rng.random() < 0.6:
            continue
        a, b = names[a], names[b]
        true = dict(reference)[b] @ dict(reference)[a].T
        turn = true if rng.random() < 0.35 else random_rotation(rng) @ true
        records.append(record(k, a, b, turn, int(rng.integers(1, 5)) * 100, bool(rng.random() < 0.9)))
    want, of, assigned = islands_by_hand(records, reference)
    turned, measured, islands = rotation.island_repair(*frames(spark, records, reference))
    got = matrices(turned)
    assert set(got) == set(names) and all(angle(got[n], want[n]) < 1e-4 for n in names)
    assert {r.island for r in islands.collect()} == set(of.values()) and {r.island for r in islands.where("assigned").collect()} == assigned
    assert len(set(of.values())) > len(assigned) > 5
    turns = {r[0]: np.array(r[6]).reshape(3, 3) for r in records}
    for r in measured.collect():
        assert r.corrected_residual == pytest.approx(angle(want[r.second] @ want[r.first].T, turns[r.pair_id]), abs=1e-4)


def test_an_island_turns_to_its_calibrated_place(spark):
    true = {n: about((0, 0, 1), d) for n, d in (("a0", 0), ("a1", 10), ("a2", 20))}
    reference = [("a0", true["a0"]), ("a1", true["a1"]), ("a2", about((0, 0, 1), 110) @ np.eye(3))]
    records = [record(1, "a0", "a1", true["a1"] @ true["a0"].T), record(2, "a1", "a2", true["a2"] @ true["a1"].T)]
    turned, measured, islands = rotation.island_repair(*frames(spark, records, reference))
    got = matrices(turned)
    assert all(angle(got[n], true[n]) < 1e-5 for n in true)
    assert sorted(r.images for r in islands.collect()) == [1, 2] and measured.where("corrected_residual > 30").count() == 0


def test_consensus_keeps_outliers_as_evidence(spark):
    eye, quarter = np.eye(3), about((0, 0, 1), 90)
    records = [record(1, "a0", "a1", eye), record(2, "b0", "b1", eye), record(3, "a0", "b0", eye), record(4, "b1", "a1", eye), record(5, "a0", "b1", quarter, 1), record(6, "a1", "b0", quarter, 900, False)]
    records += [(7, "a0", "a1", "a", "a", True, None, 5, True)]
    orientations, edges, transitions = rotation.rotation_consensus(frames(spark, records)[0], ["a", "b"])
    assert all(angle(m, eye) < 1e-6 for m in matrices(orientations).values()) and orientations.count() == 4
    status = {r.pair_id: (r.status, r.residual) for r in edges.collect()}
    assert set(status) == set(range(1, 7)) and status[5] == ("retained_robust_consensus_outlier", pytest.approx(90))
    assert status[6] == ("retained_negative_or_unconditioned_evidence", None) and status[4][0] == "retained_robust_consensus_inlier" and status[1][0] == "retained_rotation_synchronization"
    assert [r.transition for r in transitions.collect()] == ["a:b"]
    with pytest.raises(ValueError, match="omits"):
        rotation.rotation_consensus(frames(spark, records)[0], ["a"])
    with pytest.raises(ValueError, match="no conditioned evidence"):
        rotation.rotation_consensus(frames(spark, records[:2])[0], ["a", "b"])


def test_turns_are_chained_in_order(spark):
    rng = np.random.default_rng(6)
    names = [f"{r}{i}" for r in "abc" for i in range(3)]
    true = {n: random_rotation(rng) for n in names}
    pairs = [(x, y) for r in "abc" for x, y in ((f"{r}0", f"{r}1"), (f"{r}1", f"{r}2"))] + [("b1", "a0"), ("b0", "c2"), ("c0", "b2")]
    records = [record(k, a, b, true[b] @ true[a].T) for k, (a, b) in enumerate(pairs)]
    got = matrices(rotation.rotation_consensus(frames(spark, records)[0], ["a", "b", "c"])[0])
    base = got["a0"].T @ true["a0"]
    assert all(angle(got[n] @ base, true[n]) < 1e-4 for n in names)


@pytest.mark.parametrize("block", [2, 1024])
def test_a_ring_takes_the_gauge_of_most_votes(spark, block):
    rng = np.random.default_rng(3)
    true = {f"a{i}": random_rotation(rng) for i in range(7)}
    records = [record(i, f"a{i}", f"a{i + 1}", true[f"a{i + 1}"] @ true[f"a{i}"].T) for i in range(6)] + [record(9, "b0", "b1", np.eye(3)), record(10, "c0", "c1", np.eye(3))]
    gauge = random_rotation(rng)
    true = {n: m @ true["a0"].T for n, m in true.items()}  # the ring's own field, which the gauge is before
    reference = [(n, gauge @ m if n < "a4" else random_rotation(rng)) for n, m in true.items()] + [("z", gauge)]
    reference += [("c0", about((1, 0, 0), 0)), ("c1", about((1, 0, 0), 90))]
    turned, report = rotation.ring_aligned(*frames(spark, records, reference), block=block)
    got = matrices(turned)
    assert all(angle(got[n], gauge @ true[n]) < 1e-4 for n in true) and angle(got["z"], gauge) < 1e-6 and "b0" not in got
    r = {x.ring: x for x in report.collect()}
    assert (r["a"].candidates, r["a"].support, r["a"].status) == (7, 4, "supported") and r["a"].residuals[0] < 1e-4
    assert (r["b"].status, r["b"].candidates) == ("missing_reference_overlap", 0)
    assert (r["c"].support, r["c"].status) == (1, "supported")


def test_a_long_chain_of_islands_takes_few_rounds(spark, monkeypatch):
    """Each image is an island that only its neighbours lead to: 120 steps from the anchor, best link first at the far end."""
    n = 120
    rng = np.random.default_rng(5)
    names = [f"a{i:03d}" for i in range(n)]
    true = [about((0, 0, 1), 40 * i) for i in range(n)]
    reference = [(x, m @ random_rotation(rng)) for x, m in zip(names, true, strict=True)] + [("a999", np.eye(3))]
    reference[0] = names[0], true[0]
    records = [record(i, names[i], names[i + 1], true[i + 1] @ true[i].T, 100 + i) for i in range(n - 1)] + [record(n, "a000", "a999", true[0].T)]
    made = []
    keep = rotation.materialize
    monkeypatch.setattr(rotation, "materialize", lambda df, label="t": made.append(label) or keep(df, label))
    turned, measured, islands = rotation.island_repair(*frames(spark, records, reference))
    got, (want, of, assigned) = matrices(turned), islands_by_hand(records, reference)
    assert all(angle(got[k], want[k]) < 1e-4 for k in want) and islands.where("assigned").count() == len(assigned)
    assert len(made) < 50


def test_votes_meet_in_blocks_over_several_tasks(spark):
    """The leading vote of a search over all pairs; no task holds the distances of all votes."""
    import pandas as pd

    rng = np.random.default_rng(8)
    base = random_rotation(rng)
    votes = [("t" if k % 3 else "u", f"a{k:03d}", f"b{k % 7}", (about(rng.normal(size=3), rng.uniform(0, 14)) @ base).ravel().tolist(), float(rng.integers(1, 4))) for k in range(150)]
    df = spark.createDataFrame(votes, "transition string, a string, b string, rotation array<double>, weight double").repartition(3)
    got = {r.transition: r for r in graph.transition_consensus(df, threshold=6.0).collect()}
    for name in "tu":
        own = [v for v in votes if v[0] == name]
        r, w = np.array([v[3] for v in own]), np.array([v[4] for v in own])
        far = graph.distances(r, r)
        near = far <= 6.0
        best = max(range(len(own)), key=lambda i: (near[i] @ w, near[i].sum(), -np.median(far[i][near[i]]), own[i][1], own[i][2]))
        mean = graph.mean_rotation(r[near[best]].reshape(-1, 3, 3), w[near[best]])
        assert (got[name].inliers, got[name].support) == (near[best].sum(), near[best] @ w) and 3 < near[best].sum() < len(own)
        assert np.allclose(np.array(got[name].rotation).reshape(3, 3), mean, atol=1e-12)
    n = 5000
    share = pd.DataFrame({"own": np.arange(n) % graph.VOTE_PARTS, "part": 3})
    blocks = [(len(own), far.size) for own, far in graph.own_blocks(share, np.tile(base.ravel(), (n, 1)))]
    assert sum(own for own, _ in blocks) == (share["own"] == 3).sum() < n / 15 and max(size for _, size in blocks) <= graph.VOTE_CELLS


def test_a_large_ring_is_averaged_in_whole_array_steps(spark):
    """3,000 images took minutes when each was averaged by itself."""
    rng = np.random.default_rng(9)
    n = 3000
    true = [random_rotation(rng) for _ in range(n)]
    rows = [("g", f"n{i:05d}", f"n{i + d:05d}", (about((1, 2, 3), 40 if d == 2 and i % 50 == 0 else 0) @ true[i + d] @ true[i].T).ravel().tolist(), 900 if d == 1 else 100, d < 3) for i in range(n) for d in (1, 2, 3) if i + d < n]
    began = time.monotonic()
    got = matrices(graph.ring_orientations(spark.createDataFrame(rows, "ring string, a string, b string, rotation array<double>, inliers int, conditioned boolean")))
    assert time.monotonic() - began < 60 and len(got) == n
    # Wrong turns far away from the rest pull a little, and the less the farther they are.
    first = true[0].T
    assert np.median([angle(got[f"n{i:05d}"], m @ first) for i, m in enumerate(true)]) < 5
    assert angle(got["n00000"], np.eye(3)) == 0
