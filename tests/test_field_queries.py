"""Each query of plans.field_queries equals its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from tests.conftest import SF
from weirline.plans import field_queries, queries

NAMES = sorted(n for n, f in queries.QUERIES.items() if f.__module__ == field_queries.__name__)


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else list(v) if isinstance(v, (list, tuple)) else v
    return sorted((str([plain(r[i]) for i in order]) for r in rows))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "documents"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    df, told = queries.QUERIES[name](spark, SF), duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(told.columns)
    expected = _rows(told.fetchall(), told.columns)
    assert expected
    assert _rows(df.collect(), df.columns) == expected
