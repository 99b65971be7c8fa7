import glob
import os

import duckdb
import pytest

from gridloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, data, name):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    cur = c.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert columns == sorted(names)
    assert sorted(repr(tuple(r[x] for x in columns)) for r in df.collect()) == sorted(repr(tuple(r[names.index(x)] for x in columns)) for r in cur.fetchall())
