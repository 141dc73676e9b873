"""Projections of posts for lists and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.config import COLLAPSE_CATEGORIES, COLLAPSE_TAGS
from folio.functions.markdown import excerpt, flat_text
from folio.functions.text import first_truthy, reading_minutes, word_count
from folio.functions.urls import post_url

from .filters import has_cover, shows_update


def without_body(df: DataFrame) -> DataFrame:
    return df.drop("body")


def with_metrics(df: DataFrame) -> DataFrame:
    """df with words, minutes and excerpt of its body, read as Markdown. Null and empty bodies: 0 words, 1 minute, ''."""
    counted = df.withColumn("words", word_count(flat_text(F.col("body"))))
    return counted.withColumns({"minutes": reading_minutes(F.col("words")), "excerpt": excerpt(F.col("body"))})


def cards(df: DataFrame, base: str = "/", uncategorized: str = "Uncategorized") -> DataFrame:
    """What a list shows of a post; needs the columns of with_metrics()."""
    return df.select(
        "title", "slug", post_url(F.col("slug"), base).alias("url"), "tags",
        first_truthy(F.col("category"), uncategorized).alias("category"),
        "published", F.when(shows_update(F.col("updated"), F.col("published")), F.col("updated")).alias("updated"),
        "image", has_cover(F.col("image")).alias("has_cover"),
        first_truthy(F.col("description"), F.col("excerpt")).alias("description"),
        "words", "minutes", "draft",
    )


def collapse_flag(counts: DataFrame, least: int) -> DataFrame:
    """One row: n of the counted names, and whether a list of them is collapsed."""
    return counts.agg(F.count("*").alias("n")).select("n", (F.col("n") >= least).alias("collapsed"))


def tags_collapsed(tags: DataFrame) -> DataFrame:
    return collapse_flag(tags, COLLAPSE_TAGS)


def categories_collapsed(categories: DataFrame) -> DataFrame:
    return collapse_flag(categories, COLLAPSE_CATEGORIES)
