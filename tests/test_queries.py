"""Every query that SQL can say, against DuckDB on the given tables."""

import os

import duckdb
import pandas as pd
import pytest

from partita.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data_dir}/{t}.parquet')")
    return c


def rows_of(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v != v else f"{float(v) + 0.0:.5g}" if isinstance(v, (float, int)) or hasattr(v, "dtype") else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", ["sites_documents", "alphabet_part", "attributes_orders", "cluster_counts_customer", "classify_documents", "score_partition_part", "states_documents", "best_move_documents", "site_classes_documents", "k_medoids_embeddings", "bipnmf_objective_part", "score_many_orders", "stream_profile_orders", "move_sums_documents", "split_seeds_documents", "swap_gains_documents"])
def test_query_equals_sql(spark, con, data_dir, name):
    got, want = registry.QUERIES[name](spark, data_dir).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_the_search_of_documents_ends_by_itself(spark, data_dir):
    rows = registry.QUERIES["search_documents"](spark, data_dir).collect()
    assert sum(r.n for r in rows) == spark.read.parquet(f"{data_dir}/documents.parquet").count() and rows[0].rounds > 1
