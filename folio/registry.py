"""The register of driver queries with their SQL, and the stand-in for posts that many of them read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.plans.storage import table

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a function by its name, with the SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return keep


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}


def order_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts: many share a date; the priority is the category and, split, the tags."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("slug"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.col("o_orderdate").cast("timestamp").alias("published"), (F.col("o_orderstatus") == "P").alias("draft"),
        F.split("o_orderpriority", "-").alias("tags"), F.col("o_orderpriority").alias("category"),
    )


_POSTS = """with posts as (
  select cast(o_orderkey as varchar) as slug, 'Order ' || cast(o_orderkey as varchar) as title, cast(o_orderdate as timestamp) as published,
         o_orderstatus = 'P' as draft, string_split(o_orderpriority, '-') as tags, o_orderpriority as category from orders)
"""
