"""Every registered query against its SQL on the small tables, as sorted rows."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from paperweave.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    out = []
    for row in frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).itertuples(index=False):
        out.append(tuple(str(int(x)) if isinstance(x, float) and x.is_integer() else str(x.normalize()) if isinstance(x, Decimal) else str(x) for x in row))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, db, name):
    ours, theirs = registry.QUERIES[name](spark, DATA).toPandas(), db.execute(registry.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry_works_without_the_training_part(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
