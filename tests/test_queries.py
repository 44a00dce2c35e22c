"""Every annotation query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from annoquery.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _norm(rows):
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(clean(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(DATA):
        db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    found = QUERIES[name](spark, DATA)
    wanted = db.execute(ORACLES[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    assert _norm(found.select(*columns).collect()) == _norm(wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
