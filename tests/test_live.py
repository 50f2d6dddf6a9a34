"""The live pipeline: what a batch reads, what readers see, batches that fail and run again."""

import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions.features import NAMES, Scaler, features
from tidewire.plans.views import flows
from tidewire.streaming import live

SMALLEST = "/root/testdata/sf0.001"


def lines(n, start):
    return "\n".join(f"{start + i}.5\t10.0.0.{i % 5}\t8.8.8.8\t5000{i % 3}\t443\t\t\t6\t{100 + i}\t64\t100\t0x0002" for i in range(n)) + "\n"


def run(spark, folder, **options):
    query = live.start(live.read_lines(spark, f"{folder}/lines"), f"file://{folder}/out", f"{folder}/state", seconds=0, **options)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def total(spark, folder):
    return tuple(live.served(spark, f"file://{folder}/out", "totals").select("total_flows", "total_bytes").first())


def test_batches_do_not_read_the_history(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    with pytest.raises(FileNotFoundError, match="no complete batch"):
        live.served(spark, str(tmp_path), "totals")
    size = []
    for n in range(6):
        (tmp_path / "lines" / f"{n}.txt").write_text(lines(30, 1000 * n))
        run(spark, tmp_path, window=50, clusters=2)
        size += [100 + i for i in range(30)]
        assert total(spark, tmp_path) == (min(50, 30 * (n + 1)), sum(size[-50:]))
        assert live.served(spark, f"file://{tmp_path}/out", "clusters").count() == 2
        shutil.rmtree(tmp_path / "out" / "flows" / f"batch={n}")  # nothing reads it again
    for kind in ("recent", "clusters", "serving"):
        assert sorted(p.name for p in (tmp_path / "out" / kind).iterdir() if p.is_dir()) == ["batch=3", "batch=4", "batch=5"]


def test_a_failed_batch_is_not_seen_and_runs_again(spark, tmp_path, monkeypatch):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "0.txt").write_text(lines(10, 0))
    run(spark, tmp_path, clusters=2)
    before = total(spark, tmp_path)
    (tmp_path / "lines" / "1.txt").write_text(lines(20, 5000))

    def broken(recent):
        raise RuntimeError("broken")

    with monkeypatch.context() as m:
        m.setitem(live.TABLES, "series", broken)
        with pytest.raises(Exception, match="broken"):
            run(spark, tmp_path, clusters=2)
        assert total(spark, tmp_path) == before
    run(spark, tmp_path, clusters=2)
    assert total(spark, tmp_path) == (30, sum(range(100, 110)) + sum(range(100, 120)))
    assert spark.read.parquet(f"{tmp_path}/out/flows").count() == 30
    assert round(live.served(spark, f"file://{tmp_path}/out", "clusters").agg(F.sum("weight")).first()[0], 6) == 0.9 * 10 + 20


def test_centres_of_batches(spark):
    every = flows(spark, SMALLEST).persist()
    rng = random.Random(1)
    cuts = sorted(rng.sample(range(1000), 5))
    batches = [every.filter(F.col("seq").between(a, b - 1)) for a, b in zip([0, *cuts], [*cuts, 1000])] + [every.limit(0)]
    state, weights, centres = None, None, None
    for i, batch in enumerate(batches):
        rows = live.next_centres(batch, state, 3, 0.7)
        state = spark.createDataFrame(rows, live.CENTRES).orderBy("cluster_id").collect()
        raw = features(batch, "seq").orderBy("seq").toPandas()[NAMES].to_numpy()
        if centres is None:
            low, high = raw.min(0), raw.max(0)
            scale = lambda x: np.where(high > low, (x - low) / np.where(high > low, high - low, 1), 0)
            centres, weights = scale(raw)[:3].copy(), np.zeros(3)
        x = scale(raw)
        near = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(2)).argmin(1) if len(x) else np.zeros(0, int)
        for k in range(3):
            w = 0.7 * weights[k] + (near == k).sum()
            if w > 0:
                centres[k] = (0.7 * weights[k] * centres[k] + x[near == k].sum(0)) / w
            weights[k] = w
        assert np.allclose([r.centre for r in state], centres) and np.allclose([r.weight for r in state], weights), i
    assert live.next_centres(every.limit(0), None, 3, 0.7) == []
    assert Scaler(NAMES, state[0].offsets, state[0].scales).scales == pytest.approx((high - low).tolist())
