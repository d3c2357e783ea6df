import decimal
import os

import duckdb
import pytest

from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
Q, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(names, found):
    """Rows as plain values by column name, in an order that does not tell 75 from 75.0."""

    def plain(x):
        if isinstance(x, (bool, str)) or x is None:
            return x
        if hasattr(x, "isoformat"):
            return x.isoformat()[:10]
        if isinstance(x, (int, float, decimal.Decimal)):
            return None if x != x else round(float(x), 6)
        return x

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = Q[name](spark, SF), duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(Q) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[:3] == ["event_id", "user_id", "published_at"]
