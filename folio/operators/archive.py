"""The archive: posts by year of publication in a reader's time zone, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions.dates import month_day, year
from folio.functions.text import formatted_tags, plural
from folio.functions.urls import post_url
from folio.plans.order import positions

from .listing import newest_first


def years(df: DataFrame, tz: str = "UTC", one: str = "post", many: str = "posts") -> DataFrame:
    """(year, n_posts, label), newest first; rows without a date are left out."""
    counts = df.where(F.col("published").isNotNull()).groupBy(year(F.col("published"), tz).alias("year")).agg(F.count("*").alias("n_posts"))
    return counts.withColumn("label", plural(F.col("n_posts"), one, many)).orderBy(F.desc("year"))


def rows(df: DataFrame, tz: str = "UTC", base: str = "/") -> DataFrame:
    """A row for each post with its year, newest first: year, month_day, title, slug, url, tags_label. Nothing is gathered per year."""
    return (
        df.where(F.col("published").isNotNull())
        .orderBy(*newest_first())
        .select(
            year(F.col("published"), tz).alias("year"), month_day(F.col("published"), tz).alias("month_day"),
            "title", "slug", post_url(F.col("slug"), base).alias("url"), formatted_tags(F.col("tags")).alias("tags_label"),
        )
    )


def placed(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """df with year and place, its rank in the year from the newest on. The order is global and dealt by ranges; a row per year is all that a window sees."""
    found = positions(df.where(F.col("published").isNotNull()), *newest_first(), position="__position", total="__total").withColumn("year", year(F.col("published"), tz))
    newer = Window.orderBy(F.desc("year")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = found.groupBy("year").agg(F.count("*").alias("n")).select("year", F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("__ahead"))
    return found.join(ahead, "year").select(*df.columns, "year", (F.col("__position") - F.col("__ahead")).alias("place"))


def grouped(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """(year, n_posts, posts): each year's posts as an array, newest first. For what one reader is shown: a year must fit into a row; see rows()."""
    place = F.struct((-F.unix_micros(F.col("published").cast("timestamp"))).alias("o"), "slug", "title", month_day(F.col("published"), tz).alias("month_day"))
    found = df.where(F.col("published").isNotNull()).groupBy(year(F.col("published"), tz).alias("year")).agg(F.sort_array(F.collect_list(place)).alias("all"))
    posts = F.transform("all", lambda p: F.struct(p["slug"].alias("slug"), p["title"].alias("title"), p["month_day"].alias("month_day")))
    return found.select("year", F.size("all").cast("long").alias("n_posts"), posts.alias("posts")).orderBy(F.desc("year"))
