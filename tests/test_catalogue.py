"""Every query of the catalogue runs; those with SQL agree with DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

from tidewire.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="session")
def sql(sf_dir):
    connection = duckdb.connect()
    for f in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return connection


def rows(frame):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(x, 9) + 0.0 if isinstance(x, float) else x

    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, sql, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = sql.execute(ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


LEAST = {"kmeans_pp": 10_000, "elbow": 6, "isolation_forest": 10_000, "mean_shift": 10_000, "agglomerative": 10_000, "gmm": 10_000, "som": 10_000, "pca_projection": 10_000, "pca_reconstruction": 10_000, "viewport": 10_000, "tsne": 10_000, "cluster_hull": 9, "train_models": 2}


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= LEAST[name]


def test_isolation_forest_flags(spark, sf_dir):
    got = QUERIES["isolation_forest"](spark, sf_dir).toPandas()
    cut = got.score.sort_values(ascending=False).iloc[1000]
    assert ((got.cluster_id == -1) == (got.score >= cut)).all()


def test_stream_serves_all_lines(spark, sf_dir):
    row = QUERIES["stream_stats"](spark, sf_dir).first()
    assert row.total_flows == 10_000 and row.served_flows == 1000


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
