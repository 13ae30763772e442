"""Every query that has SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from inkveil.plans import catalogue

SF = "/root/testdata/sf0.001"


def rounded(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents",):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    wanted = db.execute(catalogue.oracle_sql()[name])
    columns = sorted(c[0] for c in wanted.description)
    at = [[c[0] for c in wanted.description].index(c) for c in columns]
    got = catalogue.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    key = lambda rows: sorted(rows, key=repr)
    assert key(tuple(r) for r in got.select(columns).collect()) == key(tuple(r[i] for i in at) for r in wanted.fetchall())
