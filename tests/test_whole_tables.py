"""Queries without SQL take the whole table; parts of the table are not enough."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions.features import NAMES
from tidewire.operators import clustering, graph, models, reduction
from tidewire.plans.catalogue import QUERIES, scaled
from tidewire.plans.views import flows

SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["kmeans_pp", "gmm", "som", "agglomerative", "tsne"])
def test_all_flows_are_clustered(spark, name):
    got = QUERIES[name](spark, SMALLEST)
    assert got.select("id").distinct().count() == got.count() == flows(spark, SMALLEST).count() == 1000


def test_elbow_sums_over_all_flows(spark):
    x = scaled(flows(spark, SMALLEST)).select(*NAMES).toPandas().to_numpy()
    got = QUERIES["elbow"](spark, SMALLEST).filter("k = 1").first().inertia
    assert got == pytest.approx(((x - x.mean(0)) ** 2).sum())


def test_capture_holds_all_flows(spark):
    frame = F.when(F.col("protocol") == "UDP", 42).otherwise(54)
    want = flows(spark, SMALLEST).filter("protocol <> 'ICMP'").agg(F.sum(F.greatest("byte_count", frame)).alias("b")).first().b
    assert QUERIES["pcap_import"](spark, SMALLEST).agg(F.sum("byte_count").alias("b")).first().b == want


def test_comparison_reports_refusals(spark):
    got = models.compare(flows(spark, SMALLEST), [("hierarchical", {"k": 3}), ("K-Means++", {"k": 3, "max_iterations": 2})])
    refused, trained = got.orderBy("seq").collect()
    assert refused.name == "hierarchical" and "more than 400 rows" in refused.refused and refused.quality is None
    assert trained.refused is None and trained.quality is not None
    row = models.statistics(got).first()
    assert (row.n_models, row.best, row.latest) == (1, trained.id, trained.id)


def test_all_pairs_are_met_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (301, 2))
    x[5] = x[4]
    df = spark.createDataFrame([(str(i), i, *map(float, r)) for i, r in enumerate(x)], "id string, seq long, x double, y double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    off = np.where(np.eye(len(x), dtype=bool), np.inf, d)
    kth = np.sort(off, 1)[:, 4]
    got = dict(clustering.k_distances(df, 5, ["x", "y"]).collect())
    assert [got[str(i)] for i in range(len(x))] == pytest.approx(kth.tolist())
    ranked = np.sort(kth)
    assert clustering.estimate_epsilon(df, 5, ["x", "y"]) == pytest.approx(ranked[clustering.chord(ranked.tolist())])
    c = np.arange(len(x)) % 3
    mean = np.array([[d[i, (c == k) & (np.arange(len(x)) != i)].mean() for k in range(3)] for i in range(len(x))])
    a, b = mean[np.arange(len(x)), c], np.where(np.eye(3, dtype=bool)[c], np.inf, mean).min(1)
    got = {r.id: r.score for r in clustering.silhouette(df, df.select("id", (F.col("seq") % 3).cast("int").alias("cluster_id")), ["x", "y"]).collect()}
    assert [got[str(i)] for i in range(len(x))] == pytest.approx(((b - a) / np.maximum(a, b)).tolist())


def test_small_group_has_its_own_mode(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(0, 0.1, (2200, 2)), [[9.0, 9.0]]))
    df = spark.createDataFrame([(str(i), i, *map(float, r)) for i, r in enumerate(x)], "id string, seq long, x double, y double")
    monkeypatch.setattr(clustering, "BLOCK", 1000)
    found = clustering.mean_shift(df, 1.0, 30, columns=["x", "y"])
    got = dict(found.assignments.collect())
    assert len(found.centroids) == 2 and [i for i in got if got[i] != got["0"]] == ["2200"]


def test_map_trains_the_rounds_asked_for(spark):
    df = spark.createDataFrame([(str(i), i, float(i % 5), float(i % 3)) for i in range(30)], "id string, seq long, x double, y double")
    assert clustering.self_organizing_map(df, 2, 23, columns=["x", "y"]).iterations == 23


def plain_dbscan(x, epsilon, least):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= epsilon
    core = near.sum(1) - 1 >= least
    label = np.full(len(x), -1)
    for start in np.flatnonzero(core):
        if label[start] < 0:
            label[start] = new = label.max() + 1
            stack = [start]
            while stack:
                for i in np.flatnonzero(near[stack.pop()] & core & (label < 0)):
                    label[i] = new
                    stack.append(i)
    out = label.copy()
    for i in np.flatnonzero(~core):
        found = label[near[i] & core]
        out[i] = found.min() if len(found) else -1
    return out


@pytest.mark.parametrize(("epsilon", "block"), [(0.25, 40), (0.6, 40), (3.0, 40), (0.25, 4096), (0.0, 40)])
def test_dbscan_across_blocks_and_cells(spark, monkeypatch, epsilon, block):
    monkeypatch.setattr(clustering, "BLOCK", block)
    rng = np.random.default_rng(11)
    x = np.concatenate((rng.normal(0, 0.5, (150, 2)), rng.normal(4, 0.3, (100, 2)), rng.uniform(-6, 8, (60, 2)), np.full((7, 2), 7.5)))
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(str(i), i, *map(float, r)) for i, r in enumerate(x)], "id string, seq long, x double, y double")
    got = dict(clustering.dbscan(df, epsilon, 5, ["x", "y"]).assignments.collect())
    assert [got[str(i)] for i in range(len(x))] == plain_dbscan(x, epsilon, 5).tolist()


def test_dbscan_of_nothing(spark):
    df = spark.createDataFrame([], "id string, seq long, x double, y double")
    assert clustering.dbscan(df, 1.0, 5, ["x", "y"]).assignments.count() == 0


def test_links_of_a_dense_crowd_stay_few(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 100)
    seen = []
    monkeypatch.setattr(clustering, "components", lambda links: seen.append(links.count()) or graph.components(links))
    df = spark.createDataFrame([(str(i), i, 0.001 * i, 0.0) for i in range(400)], "id string, seq long, x double, y double")
    assert {r.cluster_id for r in clustering.dbscan(df, 1.0, 5, ["x", "y"]).assignments.collect()} == {0}
    assert seen[0] < 10 * 2 * 200  # ten pairs of blocks, against 79,800 pairs of rows


def test_agglomeration_of_centres(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.05, (n, 2)) for m, n in ((0, 500), (3, 300), (9, 20))])
    df = spark.createDataFrame([(str(i), i, *map(float, r)) for i, r in enumerate(x)], "id string, seq long, x double, y double")
    found = clustering.hierarchical_of_centres(df, 3, "ward", ["x", "y"], centres=60)
    got = dict(found.assignments.collect())
    assert len(got) == len(x) and sorted(len(set(list(map(got.get, map(str, range(a, b)))))) for a, b in ((0, 500), (500, 800), (800, 820))) == [1, 1, 1]
    assert len(set(got.values())) == 3


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "ward", "centroid"])
def test_weights_stand_for_repeated_points(linkage):
    x = np.array([[0.0, 0], [0.1, 0], [1, 1], [1.3, 1], [5, 5]])
    weights = np.array([3, 1, 2, 1, 2])
    repeated = np.repeat(np.arange(5), weights)
    labels, _ = clustering.agglomerate(x, 3, linkage, weights.astype(float))
    want, _ = clustering.agglomerate(x[repeated], 3, linkage)
    same = labels[repeated][:, None] == labels[repeated][None]
    assert (same == (want[:, None] == want[None])).all()


def test_rows_lie_by_their_landmarks(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(0, 0.1, (200, 3)), rng.normal(10, 0.1, (200, 3))))
    df = spark.createDataFrame([(str(i), i, *map(float, r)) for i, r in enumerate(x)], "id string, seq long, a double, b double, c double")
    got = {r.id: (r.x, r.y) for r in reduction.tsne_of_landmarks(df, columns=["a", "b", "c"], landmarks=40).collect()}
    y = np.array([got[str(i)] for i in range(len(x))])
    assert np.isfinite(y).all() and np.linalg.norm(y[:200].mean(0) - y[200:].mean(0)) > 0
