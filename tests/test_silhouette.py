"""The exact silhouette over blocks of large and of small clusters, against plain loops."""

import numpy as np
import pytest

from tidewire.operators import clustering


def plain_silhouette(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = {}
    for i in np.flatnonzero(c >= 0):
        mean = {k: d[i, c == k].sum() / max((c == k).sum() - (k == c[i]), 1) for k in set(c[c >= 0].tolist())}
        a, b = mean.pop(c[i]), min(mean.values(), default=0.0)
        out[str(i)] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return out


@pytest.mark.parametrize("sizes", [(150, 90, 70), (120, 14, 9, 9, 3, 1, 1), (5, 4, 3, 2), (200,)])
def test_blocks_of_large_and_small_clusters(spark, monkeypatch, sizes):
    """No blocks of all pairs as before, whose parts were a row for each row, block and cluster."""

    def refused(*_, **__):
        raise AssertionError("parts of all pairs are shuffled")

    monkeypatch.setattr(clustering, "against_all", refused)
    monkeypatch.setattr(clustering, "BLOCK", 8)  # blocks of 64 rows; clusters of at most 16 share them
    rng = np.random.default_rng(7)
    c = rng.permutation(np.concatenate([np.full(n, k) for k, n in enumerate(sizes)] + [np.full(6, -1)]))
    x = rng.normal(0, 1, (len(c), 3)) + 50 + c[:, None]
    x[:, 2] = x[:, 2] > 50  # a column of few values
    x[3:9] = x[2]  # copies, of several clusters
    df = spark.createDataFrame([(str(i), i, *map(float, r)) for i, r in enumerate(x)], "id string, seq long, x double, y double, z double")
    labels = spark.createDataFrame([(str(i), int(k)) for i, k in enumerate(c)], "id string, cluster_id int")
    got = clustering.silhouette(df, labels, ["x", "y", "z"]).collect()
    want = plain_silhouette(x, c)
    assert len(got) == len(want) and {r.id: r.cluster_id for r in got} == {i: c[int(i)] for i in want}
    assert {r.id: r.score for r in got} == pytest.approx(want, abs=1e-12)


def test_sums_of_copies_and_far_rows():
    rng = np.random.default_rng(8)
    for x in (np.ones((300, 3)), np.round(rng.random((500, 3)), 1) + 1e4, np.concatenate((rng.random((400, 3)), [[1e6, 0, 0]]))):
        y = np.concatenate((x[:70], x[:200] + rng.random((200, 3))))
        d = clustering._pairwise(x, y)
        left, right = clustering._sums(x, y, False, 64)
        assert left == pytest.approx(d.sum(1), rel=1e-9, abs=1e-9) and right == pytest.approx(d.sum(0), rel=1e-9, abs=1e-9)
        assert clustering._sums(x, x, True, 64)[0] == pytest.approx(clustering._pairwise(x, x).sum(1), rel=1e-9, abs=1e-9)
