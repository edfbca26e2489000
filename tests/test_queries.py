"""Every query that has SQL against DuckDB over the same small tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from auditlake.plans import registry  # noqa: E402

SF = os.path.join(os.environ.get("TESTDATA_DIR", "/root/testdata"), "sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, columns, order):
    at = [columns.index(c) for c in order]
    said = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(said(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    other = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(other.columns)
    order = sorted(df.columns)
    assert plain(df.collect(), df.columns, order) == plain(other.fetchall(), other.columns, order)
