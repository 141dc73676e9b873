"""The schema of posts, and the rules by which front matter becomes a row of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a collection of posts.
POSTS = (
    "id string, slug string, body string, title string, published timestamp, updated timestamp, draft boolean, description string, "
    "image string, tags array<string>, category string, lang string, prevTitle string, prevSlug string, nextTitle string, nextSlug string"
)
#: Strings that default to ''. category may be null as well.
TEXTS = ("description", "image", "lang", "prevTitle", "prevSlug", "nextTitle", "nextSlug")


def conform(df: DataFrame) -> DataFrame:
    """A table shaped like posts in the columns of POSTS: missing columns and nulls get their defaults, others are left out.

    category keeps null where the column is there; updated stays null.
    """
    defaults: dict[str, Column] = dict.fromkeys((*TEXTS, "id", "slug", "body", "category"), F.lit(""))
    defaults |= {"draft": F.lit(False), "tags": F.array().cast("array<string>")}
    out = []
    for name, kind in (x.rsplit(" ", 1) for x in POSTS.split(", ")):
        if name not in df.columns:
            value = defaults.get(name, F.lit(None))
        elif name == "category" or name not in defaults:
            value = F.col(name)
        else:
            value = F.coalesce(F.col(name), defaults[name])
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def rejected(df: DataFrame) -> DataFrame:
    """The rows without a title or a publication date, with the reason as `error`."""
    reason = F.when(F.col("title").isNull(), "title is required").when(F.col("published").isNull(), "published is not a date")
    return df.withColumn("error", reason).where(F.col("error").isNotNull())


def strict(df: DataFrame) -> DataFrame:
    """df, failing the query at a row that rejected() would show."""
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit(f"{c} is missing or invalid in "), F.coalesce("id", "slug", F.lit("?"))))).otherwise(F.col(c))
    return df.withColumns({c: need(c) for c in ("title", "published")})
