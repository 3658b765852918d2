"""Queries against their SQL on keys and times that the small tables do not have."""

import datetime as dt

import duckdb
import pytest

from paperweave.plans import registry

from .test_queries import rows

TABLES = {
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int", [(1, 1, 25_000, 1), (1, 2, 3, 1), (1, 1, 3, 2), (2, 2, 9, 1)]),
    "orders": ("o_orderkey long, o_orderpriority string", [(1, "1-URGENT"), (2, "5-LOW")]),
    "part": ("p_partkey long, p_name string, p_size int, p_retailprice double", [(1, "a", 20, 1000.0), (2, "b", 20, 1000.0)]),
    "events": ("event_id long, ts timestamp_ntz", [(i, dt.datetime(2024, 1, 20) - dt.timedelta(seconds=1_000_000 + s)) for i, s in ((19, 0.4), (39, 0.0), (59, -0.4), (79, 1.0), (99, 1.6))]),
}


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    path, con = tmp_path_factory.mktemp("large"), duckdb.connect()
    for name, (schema, data) in TABLES.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", ["candidate_accepted", "candidate_attempts", "ttl_cache_freshness"])
def test_same_as_sql(spark, large, name):
    ours, theirs = registry.QUERIES[name](spark, large[0]).toPandas(), large[1].execute(registry.ORACLE[name]).df()
    assert rows(ours) == rows(theirs)
