"""Queries against their SQL on made tables: values that the small given tables do not have."""

import duckdb
import pytest

from folio import queries as content
from tests.test_queries import plain


def agrees(spark, folder, name, **tables):
    """Whether a query gives the rows of its SQL on the tables, {name: DataFrame}."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = content.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    result = con.execute(content.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    found = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    return found == sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())


def test_part_keys_beyond_a_million(spark, tmp_path):
    part = spark.createDataFrame([(k, "Brand#1") for k in (0, 999, 1000, 1049, 1050, 999_949, 999_950, 1_000_000, 1_200_050, 2_345_678_901)], "p_partkey long, p_brand string")
    assert agrees(spark, tmp_path, "names_and_numbers", part=part)


@pytest.mark.parametrize("text", ["The&a", "q &q", "x&am", "&amp", "&mid", "&", "&&amp;&", "&b c", "&A", "&copy;", "a &quo"])
def test_entities_cut_off(spark, tmp_path, text):
    pages = spark.createDataFrame([(1, "https://example.org/1", f"<html><head><title>{text}</title></head><body><h1>{text}</h1><p>{text}</p></body></html>")], "page_id long, url string, html string")
    assert agrees(spark, tmp_path, "rss_of_pages", pages=pages)
