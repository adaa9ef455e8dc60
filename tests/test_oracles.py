"""Every query that has SQL against DuckDB, on the tables of sf0.001 (ORACLE_SF for another)."""

import math
import os

import pytest

import __spark_entry__ as entry
from lexmill.catalog import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = f"/root/testdata/sf{os.environ.get('ORACLE_SF', '0.001')}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, cols):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    clean = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(repr([clean(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    cur = db.execute(ORACLES[name])
    cols = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(cols)
    want = cur.fetchall()
    assert want
    assert plain(got, df.columns) == plain(want, cols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["term", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
