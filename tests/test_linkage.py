"""Single linkage by a spanning tree against the plain agglomeration."""

import numpy as np
import pytest
from test_neighbours import made

from tidewire.operators import clustering, linkage, neighbours


def frame(spark, x):
    return spark.createDataFrame([(f"r{i}", 3 * i, *map(float, r)) for i, r in enumerate(x)], "id string, seq long, x double, y double, z double")


def heights(x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    inside, best, out = np.zeros(len(x), bool), np.full(len(x), np.inf), []
    best[0] = 0
    for _ in range(len(x)):
        i = int(np.where(inside, np.inf, best).argmin())
        inside[i] = True
        out.append(best[i])
        best = np.minimum(best, d[i])
    return sorted(out[1:])


def groups(labels):
    out = {}
    for i, c in labels.items():
        out.setdefault(c, set()).add(i)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("kind", ["spread", "copies", "far groups"])
def test_tree(spark, monkeypatch, kind):
    for name, value in (("LEAF", 16), ("PART", 30), ("CHUNK", 20)):
        monkeypatch.setattr(neighbours, name, value)
    x = made(kind, 150) if kind != "far groups" else np.concatenate([made("spread", 50, i) * 0.1 + 100 * i for i in range(3)])
    tree = linkage.minimum_spanning_tree(frame(spark, x), ["x", "y", "z"], 3)
    rows = tree.collect()
    assert len(rows) == len(x) - 1 and all(r.a < r.b for r in rows)
    assert sorted(r.distance for r in rows) == pytest.approx(heights(x))
    if kind != "copies":  # ties may be cut otherwise
        for k in (1, 2, 5):
            got = {r.id: r.cluster_id for r in linkage.cut(frame(spark, x), tree, k).collect()}
            want, _ = clustering.agglomerate(x, k, "single")
            assert groups(got) == groups({f"r{i}": c for i, c in enumerate(want)}), k
        assert got["r0"] == 0
    steps = linkage.merges(tree).orderBy("step").collect()
    assert [r.step for r in steps] == list(range(len(x) - 1)) and [r.height for r in steps] == sorted(r.height for r in steps)


def test_few_rows(spark):
    for n in (0, 2):
        df = frame(spark, made("spread", n))
        tree = linkage.minimum_spanning_tree(df, ["x", "y", "z"])
        assert tree.count() == max(0, n - 1) and linkage.cut(df, tree, 3).count() == n
