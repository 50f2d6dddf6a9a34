"""Nearest neighbours by boxes against all pairs."""

import numpy as np
import pytest

from tidewire.operators import clustering, neighbours
from tidewire.operators.neighbours import box_distances, grow, nearest_neighbours, search


def made(kind, n, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "spread":
        return rng.normal(0, 1, (n, 3))
    if kind == "copies":  # a third of the rows at one place, others at few
        x = rng.integers(0, 3, (n, 3)).astype(float)
        x[: n // 3] = 1.0
        return x
    return np.concatenate((rng.normal(0, 1e-3, (n // 3, 3)), rng.normal(0, 50, (n - n // 3, 3))))  # a crowd


def kth(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, 1)[:, :k]


@pytest.mark.parametrize("kind", ["spread", "copies", "crowd"])
def test_neighbours(spark, monkeypatch, kind):
    for name, value in (("LEAF", 16), ("PART", 30), ("CHUNK", 20)):
        monkeypatch.setattr(neighbours, name, value)
    x = made(kind, 400)
    df = spark.createDataFrame([(str(i), *map(float, r)) for i, r in enumerate(x)], "id string, x double, y double, z double")
    rows = {r.id: r for r in nearest_neighbours(df, 4, ["x", "y", "z"]).collect()}
    want = kth(x, 4)
    assert len(rows) == len(x)
    for i in range(len(x)):
        r = rows[str(i)]
        assert r.distances == pytest.approx(want[i].tolist()) and len(set(r.neighbours)) == 4 and str(i) not in r.neighbours
        assert [float(np.sqrt(((x[i] - x[int(j)]) ** 2).sum())) for j in r.neighbours] == pytest.approx(r.distances)


def test_few_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 2)
    for n in (0, 1, 2, 4, 7):
        x = made("spread", n, n)
        df = spark.createDataFrame([(str(i), *map(float, r)) for i, r in enumerate(x)], "id string, x double, y double, z double")
        got = {r.id: r.distances for r in nearest_neighbours(df, 5, ["x", "y", "z"]).collect()}
        d = kth(x, 5)
        assert {k: pytest.approx(v) for k, v in got.items()} == {str(i): [v for v in d[i].tolist() if np.isfinite(v)] for i in range(n)}
    bad = spark.createDataFrame([("0", 1.0), ("1", float("nan"))], "id string, x double")
    with pytest.raises(ValueError, match="finite"):
        nearest_neighbours(bad, 1, ["x"])


def test_search_in_boxes(monkeypatch):
    monkeypatch.setattr(neighbours, "BOX", 7)
    for kind in ("spread", "copies", "crowd"):
        x, y = made(kind, 120, 1), made(kind, 150, 2)
        d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
        bound = np.random.default_rng(3).choice([np.inf, 0.0, 0.5, 3.0], 120)
        best, who = search(x, y, 3, bound, False)
        want = np.sort(np.where(d < bound[:, None], d, np.inf), 1)[:, :3]
        assert np.allclose(best, want) and ((who >= 0) == np.isfinite(best)).all()
        assert np.allclose(search(x, x, 3, np.full(120, np.inf), True)[0], kth(x, 3))
    assert search(x[:0], y, 3, np.zeros(0), False)[0].shape == (0, 3) and not np.isfinite(search(x, y[:0], 3, np.full(120, np.inf), False)[0]).any()


def test_tree():
    for kind in ("spread", "copies", "crowd"):
        x = made(kind, 3000)
        tree = grow(x, 50)
        leaf = tree.leaf_of(x)
        assert tree.leaves <= 50 and (kind == "copies" or np.bincount(leaf).max() < 3 * 3000 / 50)
        low = np.array([x[leaf == i].min(0) for i in range(tree.leaves)])
        high = np.array([x[leaf == i].max(0) for i in range(tree.leaves)])
        tree = tree.fitted(low, high)
        bound = np.full(len(x), 0.4)
        rows, leaves = tree.nearer(x, bound)
        every = np.stack([box_distances(x, low[i], high[i]) for i in range(tree.leaves)], 1) < 0.4
        assert sorted(zip(rows.tolist(), leaves.tolist())) == [tuple(p) for p in np.argwhere(every).tolist()]
    assert grow(np.zeros((0, 3)), 1).leaves == 1 and grow(np.ones((50, 3)), 8).leaves == 1


def test_k_distances_of_no_rows(spark):
    assert clustering.k_distances(spark.createDataFrame([], "id string, x double"), 5, ["x"]).count() == 0
    one = spark.createDataFrame([("a", 1.0)], "id string, x double")
    assert [tuple(r) for r in clustering.k_distances(one, 5, ["x"]).collect()] == [("a", 0.0)]


def test_distances_alone(spark, monkeypatch):
    """Without names, and from rows far from the origin with copies, whose distances products alone would blur."""
    for name, value in (("LEAF", 4), ("PART", 60), ("CHUNK", 20), ("BOX", 16)):
        monkeypatch.setattr(neighbours, name, value)
    x = made("crowd", 300) + 1e4
    x[5] = x[4]
    df = spark.createDataFrame([(str(i), *map(float, r)) for i, r in enumerate(x)], "id string, x double, y double, z double")
    near = nearest_neighbours(df, 4, ["x", "y", "z"], names=False)
    assert near.columns == ["id", "distances"]
    got, want = dict(near.collect()), kth(x, 4)
    assert len(got) == len(x) and all(got[str(i)] == pytest.approx(want[i].tolist(), rel=1e-14, abs=0) for i in range(len(x)))
