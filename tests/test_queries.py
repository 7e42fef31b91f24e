"""Every registered query against its SQL, on the smallest tables."""

import datetime as dt
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, sql, name):
    got = queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(_plain(r[c]) for c in columns) for r in got.collect()]
    if name not in oracle_sql():
        assert rows
        return
    done = sql.execute(oracle_sql()[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    want = [tuple(_plain(r[names.index(c)]) for c in columns) for r in done.fetchall()]
    assert _sorted(rows) == _sorted(want)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["doc_id", "masked_text", "n_values"]
