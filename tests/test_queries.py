"""Every library query that has SQL gives the rows of its SQL; the others are compared where they are tested."""

import math
import os
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tallyloft.plans import queries as library

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return v if isinstance(v, datetime) else float(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_query_matches_its_sql(spark, duck, name):
    df = library.QUERIES[name](spark, FOLDER)
    want = duck.execute(library.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_entry_and_registries(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(library.QUERIES) <= set(entry.queries())


def test_the_registry_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, check=True, timeout=120)


def test_survivorship_over_order_keys_beyond_a_million(spark, tmp_path):
    lines = [(1, 2, 3, 1, 0.01, 0.05), (2_500_000, 2, 1, 2, 0.02, 0.0), (5_000_000, 2, 2, 1, 0.0, 0.07), (7, 3, 9, 1, 0.0, 0.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_tax double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    got = library.survivorship(spark, str(tmp_path))
    assert got.columns == ["l_partkey", "tax", "discount"]
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(library.SQL["survivorship"]).fetchall()) == [(2, 0.01, 0.05), (3, None, None)]
