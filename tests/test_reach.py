"""Components by links of bounded length, and DBSCAN on them, against plain loops."""

import numpy as np
import pytest
from test_linkage import frame, groups
from test_neighbours import made
from test_whole_tables import plain_dbscan

from tidewire.operators import clustering, linkage, neighbours, reach


def plain_parts(x, height):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= height
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.where(near, label[None, :], len(x)).min(1)
    return label


@pytest.fixture
def small(monkeypatch):
    for name, value in (("LEAF", 24), ("PART", 40), ("CHUNK", 20), ("BOX", 8)):
        monkeypatch.setattr(neighbours, name, value)


@pytest.mark.parametrize("kind", ["spread", "copies"])
def test_flat_clusters(spark, small, monkeypatch, kind):
    x = made(kind, 300)
    for height, units in ((0.0, 1 << 17), (0.15, 1 << 17), (0.15, 20), (0.5, 20), (9.0, 20)):
        monkeypatch.setattr(reach, "UNITS", units)
        got = {r.id: r.cluster_id for r in linkage.flat(frame(spark, x), height, ["x", "y", "z"]).collect()}
        want = plain_parts(x, height)
        numbers = {c: i for i, c in enumerate(sorted(set(want.tolist())))}
        assert got == {f"r{i}": numbers[c] for i, c in enumerate(want.tolist())}, height


def test_links_of_exactly_the_length(spark, small):
    """A grid of step 1, and one row 1.0001 away from it."""
    x = np.array([[i % 12, i // 12, 0.0] for i in range(144)] + [[12.0001, 0, 0]], float)
    got = {r.id: r.cluster_id for r in linkage.flat(frame(spark, x), 1.0, ["x", "y", "z"]).collect()}
    assert groups(got) == sorted([sorted(f"r{i}" for i in range(144)), ["r144"]])


def test_dbscan_meets_no_blocks_of_all_pairs(spark, small, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("all pairs are met")

    monkeypatch.setattr(clustering, "against_all", refused)
    x = np.concatenate([made("spread", 200), made("copies", 60, 3) + 4])
    for epsilon, least in ((0.3, 5), (0.1, 2), (1.0, 5), (30.0, 5)):
        got = dict(clustering.dbscan(frame(spark, x), epsilon, least, ["x", "y", "z"]).assignments.collect())
        assert [got[f"r{i}"] for i in range(len(x))] == plain_dbscan(x, epsilon, least).tolist(), (epsilon, least)


def test_no_rows(spark):
    none = frame(spark, made("spread", 1)).limit(0)
    assert linkage.flat(none, 1.0, ["x", "y", "z"]).count() == 0 and clustering.dbscan(none, 1.0, 5, ["x", "y", "z"]).assignments.count() == 0


def flags(n, seed=5):
    """Rows of three numbers and three flags, so that rows of other flags are at least 1 away."""
    rng = np.random.default_rng(seed)
    return np.column_stack((rng.random((n, 2)), np.round(rng.random(n), 1), rng.integers(0, 2, (n, 3)))).astype(float)


def test_rows_of_other_flags_are_not_visited(spark, small, monkeypatch):
    """Leaves are cut by columns of many values, so rows that differ in a flag lie in the same part. Before, all rows visited
    the units of other flags."""
    sizes, plain = [], reach.stored
    monkeypatch.setattr(reach, "stored", lambda df: sizes.append(plain(df)) or sizes[-1])
    monkeypatch.setattr(neighbours, "LEAF", 8)  # leaves of 128 rows, not parted
    monkeypatch.setattr(neighbours, "PART", 400)
    x, names = flags(800), ["x", "y", "z", "u", "v", "w"]
    x[7] = [*x[8, :3], *(1 - x[8, 3:])]
    x[9] = [*x[8, :3], 1 - x[8, 3], *x[8, 4:]]  # exactly 1 from another
    df = spark.createDataFrame([(f"r{i}", i, *map(float, r)) for i, r in enumerate(x)], "id string, seq long, " + ", ".join(f"{c} double" for c in names))
    got = dict(clustering.dbscan(df, 1.0, 5, names).assignments.collect())
    assert [got[f"r{i}"] for i in range(len(x))] == plain_dbscan(x, 1.0, 5).tolist()
    assert max(s.count() for s in sizes if set(s.columns) >= {"_leaf", "label"} and "unit" not in s.columns) < len(x) // 2


def test_parts_of_a_group_and_links_between_two():
    for x, heights in ((np.round(flags(300), 1), (0.0, 0.1, 0.3, 1.0, 5.0)), (np.full((40, 2), 1e6), (0.0, 1.0)), (np.random.default_rng(6).random((200, 2)) + 1e6, (1e-9, 0.01, 0.05))):
        d = neighbours.distances(x, x)
        for height in heights:
            assert (neighbours.within(x, x, height) == (d <= height)).all()
            assert (reach._components(x, height) == plain_parts(x, height)).all()
            n = (d <= height).sum(1) - 1
            assert (np.minimum(reach._counted(x, height, 4), 4) == np.minimum(n, 4)).all()
