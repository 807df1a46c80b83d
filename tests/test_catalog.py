"""Every query that has SQL gives the SQL's rows."""

import math
import os

import duckdb
import pytest

from frameloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, float):
        return f"{x:.6g}"
    return str(x)


def _key(row):
    return tuple(_value(x) for x in row)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(_key(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    rel = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(_key([r[i] for i in order]) for r in rel.fetchall())
    assert len(ours) == len(theirs)
    close = lambda a, b: a == b or (a and b and a.replace(".", "").replace("-", "").replace("e+", "").replace("e", "").isdigit() and math.isclose(float(a), float(b), rel_tol=2e-5, abs_tol=1e-9))
    bad = [(a, b) for a, b in zip(ours, theirs) if not all(close(x, y) for x, y in zip(a, b))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
