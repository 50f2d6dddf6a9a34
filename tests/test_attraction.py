"""Mean shift by bounds against climbing every row."""

import numpy as np
import pytest

from tidewire.operators import attraction, clustering


def plain(x, bandwidth, iterations, tolerance=1e-3):
    at, moves = x.copy(), np.ones(len(x), bool)
    for _ in range(iterations):
        if not moves.any():
            break
        was = at[moves]
        w = np.exp(-((was[:, None] - x[None]) ** 2).sum(2) / (2 * bandwidth * bandwidth))
        at[moves] = w @ x / w.sum(1)[:, None]
        moves[moves] = np.sqrt(((at[moves] - was) ** 2).sum(1)) >= tolerance
    centres, label = [], []
    for p in at:
        near = [i for i, c in enumerate(centres) if np.linalg.norm(p - c) < bandwidth / 2]
        label.append(near[0] if near else len(centres))
        if not near:
            centres.append(p)
    return np.array(label), np.array(centres)


def groups(n=900):
    rng = np.random.default_rng(7)
    middles = np.array([[0, 0, 0], [4, 0, 0], [0, 2.2, 0], [9, 9, 9]])
    return middles[rng.choice(4, n, p=[0.5, 0.3, 0.19, 0.01])] + rng.normal(0, 0.5, (n, 3))


@pytest.mark.parametrize("bandwidth,iterations", [(1.0, 60), (1.0, 3)])
def test_as_if_all_rows_climbed(spark, monkeypatch, bandwidth, iterations):
    monkeypatch.setattr(attraction, "FEW", 20)
    x = groups()
    df = spark.createDataFrame([(str(i), i, *map(float, r)) for i, r in enumerate(x)], "id string, seq long, x double, y double, z double")
    found = clustering.mean_shift(df, bandwidth, iterations, columns=["x", "y", "z"])
    got = dict(found.assignments.collect())
    label, centres = plain(x, bandwidth, iterations)
    assert len(got) == len(x) and [got[str(i)] for i in range(len(x))] == label.tolist()
    assert np.allclose(found.centroids, centres, atol=2e-6)


def test_most_rows_need_not_climb(spark, monkeypatch):
    """Before, each row climbed by sums over all rows."""
    climbed, whole = [], clustering._climbed
    monkeypatch.setattr(clustering, "_climbed", lambda rows, *a: climbed.append(rows.count()) or whole(rows, *a))
    monkeypatch.setattr(attraction, "FEW", 20)
    x = np.random.default_rng(8).uniform(0, 1, (3000, 8))
    df = spark.createDataFrame([(str(i), i, *map(float, r)) for i, r in enumerate(x)], "id string, seq long, " + ", ".join(f"c{i} double" for i in range(8)))
    found = clustering.mean_shift(df, 1.0, 50, columns=[f"c{i}" for i in range(8)])
    assert {r.cluster_id for r in found.assignments.collect()} == {0} and len(climbed) == 1 and climbed[0] <= 21


def test_bounds_hold(spark):
    x = groups(300)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "x double, y double, z double")
    rng, columns = np.random.default_rng(9), ["x", "y", "z"]
    step = lambda p: (w := np.exp(-((p[:, None] - x[None]) ** 2).sum(2) / 2)) @ x / w.sum(1)[:, None]
    points = x[:6]
    to = attraction.stepped(df, points, 1.0, columns)
    assert np.allclose(to, step(points))
    radii = np.tile([0.1, 0.5, 1.0], (6, 1))
    bound = attraction.spreads(df, points, to, radii, 1.0, columns)
    for p, t, b in zip(points, to, bound):
        for r, most in zip(radii[0], b):
            u = rng.normal(0, 1, (200, 3))
            u *= r / np.linalg.norm(u, axis=1)[:, None]
            assert np.linalg.norm(step(p + u) - t, axis=1).max() <= most
