"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{t}.parquet") else "")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(bytes(v) if isinstance(v, bytearray) else v) for v in (r[i] for i in order)) for r in values)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    found = df.collect()
    if name in entry.oracle_sql():
        result = duck.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, found) == rows(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
