"""Counts of tags and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import js_trim
from folio.functions.urls import category_url, tag_url

from .listing import by_name


def tag_counts(df: DataFrame, normalize: bool = False, base: str = "/") -> DataFrame:
    """(name, count, url) in order of name. Occurrences count, exact and untrimmed; normalize trims first.

    Null tags and null lists count nothing. The counts are summed before they are shuffled.
    """
    named = df.select(F.explode("tags").alias("name")).where(F.col("name").isNotNull())
    named = named.withColumn("name", js_trim(F.col("name"))) if normalize else named
    counts = named.groupBy("name").agg(F.count("*").alias("count"))
    return by_name(counts.withColumn("url", tag_url(F.col("name"), base)))


def category_counts(df: DataFrame, uncategorized: str = "Uncategorized", base: str = "/") -> DataFrame:
    """(name, count, url) in order of name. Null and '' count as `uncategorized`, others trimmed (blanks under '')."""
    raw = F.coalesce("category", F.lit(""))
    name = F.when(raw == "", uncategorized).otherwise(js_trim(raw))
    counts = df.groupBy(name.alias("name")).agg(F.count("*").alias("count"))
    return by_name(counts.withColumn("url", category_url(F.col("name"), uncategorized, base)))
