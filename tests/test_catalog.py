"""A few registered queries against their SQL; tools/check.py runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry_mod

NAMES = ["make_decision", "behaviour_uid_nunique", "target_mean_encode_oof", "roc_curve",
         "online_velocity_counts_distinct", "label_encode", "match_reply"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("events", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    df = entry_mod.queries()[name](spark, sf_dir)
    result = con.execute(entry_mod.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(map(repr, result.fetchall()))
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert got == want


def test_registry_is_consistent():
    queries, oracle = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len(queries) > 150
