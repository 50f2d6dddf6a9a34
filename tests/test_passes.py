"""Centres by products against plain distances; passes over all rows."""

import numpy as np

from tidewire.operators import clustering


def points(spark, x):
    return spark.createDataFrame([(str(i), i, *map(float, r)) for i, r in enumerate(x)], "id string, seq long, x double, y double")


def test_elbow_shares_its_passes(spark, monkeypatch):
    calls, plain = [], clustering.gathered
    monkeypatch.setattr(clustering, "gathered", lambda *a: calls.append(1) or plain(*a))
    df = points(spark, np.random.default_rng(1).normal(0, 1, (60, 2)))
    _, got = clustering.elbow(df, 4, 3, columns=["x", "y"])
    assert len(calls) == 3  # before: three for each of four k
    assert got == [clustering.k_means(df, k, max_iterations=3, columns=["x", "y"]).inertia for k in range(1, 5)]


def test_first_of_equally_near_centres():
    rng = np.random.default_rng(2)
    for x, c in ((rng.normal(0, 1, (500, 3)) + 1e4, rng.normal(0, 1, (40, 3)) + 1e4), (rng.integers(0, 3, (300, 3)).astype(float), rng.integers(0, 3, (20, 3)).astype(float))):
        assert (clustering.nearest_centres(x, c) == clustering._pairwise(x, c).argmin(1)).all()
        assert np.allclose(clustering._by_products(x, c), clustering._pairwise(x, c), rtol=1e-7, atol=0)
