"""Every registered query against its DuckDB oracle on the smallest scale.

The driver runs the same comparison at sf0.01; here sf0.001 keeps the suite
quick. Queries without oracle SQL must at least run and keep their schema.
"""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as E

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(rows):
    return sorted((tuple(_norm(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    yield con
    con.close()


QUERIES = E.queries()
ORACLE = E.oracle_sql()


def test_every_query_named_uniquely():
    assert len(QUERIES) >= 140
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert len(cols) > 0
        return
    cur = duck.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    spark_types = dict(df.dtypes)
    duck_types = {d[0]: str(d[1]).split("(")[0] for d in cur.description}
    assert {c: TYPE_MAP.get(spark_types[c], spark_types[c]) for c in cols} == {c: duck_types[c] for c in cols}
    order = [dcols.index(c) for c in cols]
    drows = [tuple(r[i] for i in order) for r in cur.fetchall()]
    assert len(rows) == len(drows)
    assert _rows(rows) == _rows(drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["kungfus", "count", "won", "short", "rate"]
