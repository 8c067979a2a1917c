"""Distances of units that are compared bit by bit, tile by tile."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.operators import distance, encode
from partita.plans import registry
from partita.sources.scratch import written


@pytest.fixture(scope="module")
def data(spark):
    """70 units of 0 to 80 ones among 80, so more than a word; some alike."""
    rng = np.random.default_rng(5)
    ones = {u: set(np.flatnonzero(rng.random(80) < rng.choice([0.05, 0.5, 0.9])).tolist()) for u in range(60)}
    ones |= {60 + u: ones[u] ^ {int(rng.integers(80))} for u in range(6)} | {66: set(), 67: set(), 68: set(range(80)), 69: ones[3]}
    units = written(spark.createDataFrame([(u, str(u)) for u in ones], "unit_id long, uid string"))
    attributes = written(spark.createDataFrame([(a + 1,) for a in range(80)], "attr_id int"))
    return encode.Dataset(units, None, attributes, written(spark.createDataFrame([(u, a + 1) for u, s in ones.items() for a in s], "unit_id long, attr_id int")))


def rows_of(df):
    return sorted((r.i, r.j, round(r.d, 12)) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_sql(data_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{data_dir}/embeddings.parquet')")
    return con.sql(registry.ORACLES[name])


def test_near_pairs_of_tiles(spark, data, data_dir, monkeypatch):
    monkeypatch.setattr(distance, "TILE", 33)
    for t in (0.0, 0.2, 0.4, 0.75):
        assert rows_of(distance.near_pairs(data, t, tiled=True)) == rows_of(distance.near_pairs(data, t, tiled=False))
    df = registry.QUERIES["near_pairs_embeddings"](spark, data_dir)
    assert "CartesianProduct" in plan(df) and "SortMergeJoin" not in plan(df)  # no attribute is rare there
    assert sorted(tuple(r) for r in df.select("i", "j", "d").collect()) == sorted(by_sql(data_dir, "near_pairs_embeddings").fetchall())


def test_medoids_of_tiles(spark, data, monkeypatch):
    monkeypatch.setattr(distance, "TILE", 33)
    assert sorted(distance.medoids(data, 5).collect()) == sorted(distance.k_medoids(distance.pairwise_distance(data, tiled=False), 5).collect())
    one = encode.Dataset(data.units.where("unit_id = 7"), None, data.attributes, data.ones.where("unit_id = 7"))
    assert [tuple(r) for r in distance.medoids(one, 3).collect()] == [(1, 7)]  # a unit alone is in no pair
    assert distance.medoids(encode.Dataset(data.units.limit(0), None, data.attributes, data.ones.limit(0)), 3).count() == 0


def test_thresholds_share_one_comparison(spark, data_dir):
    df = registry.QUERIES["near_pairs_by_threshold_embeddings"](spark, data_dir)
    assert plan(df).count("CartesianProduct") == 1
    got = sorted((r.threshold, r.i, r.j, r.d) for r in df.collect())
    assert got == sorted(by_sql(data_dir, "near_pairs_by_threshold_embeddings").fetchall())


def test_all_pairs_of_tiles(spark, data, data_dir, monkeypatch):
    monkeypatch.setattr(distance, "TILE", 33)
    pairs = rows_of(distance.pairwise_distance(data, tiled=True))
    assert len(pairs) == 70 * 69 // 2 and (66, 67, 0.0) in pairs
    assert pairs == rows_of(distance.pairwise_distance(data, tiled=False))
    df = registry.QUERIES["pairwise_distance_embeddings"](spark, data_dir)
    assert "CartesianProduct" in plan(df)
    wanted = by_sql(data_dir, "pairwise_distance_embeddings").fetchall()
    assert sorted(tuple(r) for r in df.select("i", "j", "d").collect()) == sorted(wanted)
