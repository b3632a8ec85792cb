"""Every query with an oracle gives the oracle's rows."""

import math
import os

import duckdb
import pytest

from quern.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, data, duck, name):
    df = catalog.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0


def test_the_entry_works_without_the_optional_subpackage():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and catalog.FLAGSHIP in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
