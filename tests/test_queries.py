import glob
import math
import os

import duckdb
import pytest

from folio import queries as content

DATA = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(content.queries()))
def test_query_and_sql_agree(spark, duck, name):
    df = content.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    sql = content.oracle_sql().get(name)
    if sql is None:
        assert found
        return
    result = duck.execute(sql)
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert found == sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())


def test_entry():
    import __spark_entry__ as e

    assert set(content.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
