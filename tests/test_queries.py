"""Every registered query against the SQL that it is registered with, in DuckDB, and all others for rows and stable results."""

import math

import duckdb
import pytest

from covaria import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(rows, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, sf_dir, duck, name):
    got = plans.queries()[name](spark, sf_dir)
    want = duck.sql(plans.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows_of(got.collect(), [got.columns.index(c) for c in names]) == rows_of(want.fetchall(), [want.columns.index(c) for c in names])


#: Values that may be null: retention where the test R2 isn't positive.
NULLS = {"accuracy_retention": {"value", "boot_mean", "lo", "hi", "p"}}


@pytest.mark.parametrize("name", sorted(plans.queries().keys() - plans.oracle_sql().keys()))
def test_rows(spark, sf_dir, name):
    df = plans.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows and not any(v is None and c not in NULLS.get(name, ()) or isinstance(v, float) and math.isnan(v) for r in rows for c, v in r.asDict().items())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 15 and {"user_id", "occ_0", "tp_0_0"} <= set(df.columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
