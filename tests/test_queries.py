"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import datetime as dt
import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS FROM '{FOLDER}/{name}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}".replace("-0.000000", "0.000000")
    return str(v) if not isinstance(v, dt.datetime) else v.replace(tzinfo=None).isoformat(" ")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([plain(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = df.collect()
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, result.fetchall())


#: Windows of these are longer than the feeds of the smallest tables.
LONG = {"i11_covariance_ladder", "i7_ridge_out_of_sample", "i7_spline_and_logistic", "r11_event_logit", "r4_shock_half_life", "r7_walk_forward"}


@pytest.fixture(scope="module")
def long_folder(tmp_path_factory):
    """The smallest tables, but a daily panel of one feed of 1,400 days."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("long")
    for name in os.listdir(FOLDER):
        if name != "assets_daily.parquet":
            os.symlink(f"{FOLDER}/{name}", folder / name)
    rng = np.random.default_rng(12)
    schema = pq.read_schema(f"{FOLDER}/assets_daily.parquet")
    days = [dt.date(2010, 1, 1) + dt.timedelta(days=i) for i in range(1400)]
    storm = 1 + 2 * (np.arange(1400) % 300 > 240)
    columns = {"source_id": ["us_long"] * 1400, "region": ["us"] * 1400, "date": days, "load_id": [1] * 1400}
    columns |= {c: rng.standard_t(5, 1400) * 0.006 * storm for c in schema.names if c not in columns}
    pq.write_table(pa.table(columns, schema=schema), folder / "assets_daily.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_runs(spark, long_folder, name):
    df = entry.queries()[name](spark, long_folder if name in LONG else FOLDER)
    rows = df.collect()
    assert rows and all(len(r) == len(df.columns) for r in rows)
    assert len(set(df.columns)) == len(df.columns) and any(any(v is not None for v in r) for r in rows)


def test_windows_longer_than_the_smallest_feeds(spark, long_folder):
    for name in ("i9_vector_autoregression", "r7_walk_forward"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW assets_daily AS FROM '{long_folder}/assets_daily.parquet'")
        df = entry.queries()[name](spark, long_folder)
        got = df.collect()
        if name in entry.oracle_sql():
            result = con.execute(entry.oracle_sql()[name])
            columns = [d[0] for d in result.description]
            assert got and rows_of(df.columns, got) == rows_of(columns, result.fetchall())
        else:
            assert {r.state for r in got} >= {-1, 0}


def test_no_case_comes_twice(spark):
    for name in entry.queries():
        if name.endswith("_found"):
            df = entry.queries()[name](spark, FOLDER)
            assert df.count() == df.distinct().count(), name


def test_llm_is_optional():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "chronoplane"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "chronoplane.llm" not in path.read_text(), path
