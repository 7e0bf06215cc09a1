"""Every registered query against its SQL, on the smallest tables."""

import datetime
import importlib
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if v != v else repr(round(v, 6))
    return None if v is None else str(v)[:19] if isinstance(v, datetime.date) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf_dir, duck, name):
    got = entry.queries()[name](spark, sf_dir)
    rows = got.collect()
    if name not in entry.oracle_sql():
        assert got.columns
        return
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_library_stands_without_the_llm_subpackage():
    for name in ("casegrid.plans.text_queries", "casegrid.plans.case_queries", "casegrid.plans.flow_queries"):
        source = importlib.import_module(name).__file__
        with open(source, encoding="utf-8") as f:
            assert "casegrid.llm" not in f.read()


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "chunk_id"
