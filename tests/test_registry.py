import glob
import importlib.util
import os
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.plans import registry


def test_every_query_has_a_function_and_sql_only_for_queries():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and all(callable(f) for f in q.values()) and len(q) > 130


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "spin" and df.count() >= 0


def test_the_core_does_not_import_the_subpackage():
    root = Path(entry.__file__).parent / "gridloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts[:1]:
            assert "gridloom.llm" not in p.read_text(), p


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql())))
def test_sql_agrees(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    plain = lambda rows: sorted(repr(tuple(int(v) if isinstance(v, Decimal) else v for v in r)) for r in rows)
    got = plain(tuple(r[x] for x in columns) for r in df.collect())
    cur = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert columns == sorted(names) and got == plain(tuple(r[names.index(x)] for x in columns) for r in cur.fetchall())


def test_bench_names_exist():
    spec = importlib.util.spec_from_file_location("bench", Path(entry.__file__).parent / "bench.py")
    bench = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(bench)
    assert {n for n in bench.HEADLINE if n[0] != "p"} <= set(entry.queries())
    assert "gridloom" in sys.modules
