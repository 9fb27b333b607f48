"""Registered queries against their equivalents in SQL, on the smallest tables."""

import os

import duckdb
import pytest

from framewise.plans import catalog


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(rows):
    value = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(value(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_equal(spark, sf, sql, name):
    df = catalog.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    want = sql.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == names
    quoted = ", ".join(f'"{c}"' for c in names)
    want = sql.sql(f"SELECT {quoted} FROM ({catalog.ORACLES[name]})").fetchall()
    assert plain(df.select(*names).collect()) == plain(want)


def test_whole_tables(spark, sf):
    """No query on chunks or activity leaves a part of its table out."""
    chunks = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    events = spark.read.parquet(f"{sf}/events.parquet")
    rows = lambda name: catalog.QUERIES[name](spark, sf).count()
    assert rows("m1_hann_window") == rows("u1_score_sequences") == chunks * 64
    assert rows("j4_extract_segments") == chunks
    assert rows("w11_log_pred_score") == events.count() * events.select("event_type").distinct().count()


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() > 0
