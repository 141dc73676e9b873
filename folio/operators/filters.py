"""Filters of a collection of posts. Each keeps the columns; null never passes by accident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import js_trim


def _no(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def published_only(df: DataFrame, prod: bool = True) -> DataFrame:
    """Without drafts in production; a null draft flag is no draft. Elsewhere everything stays."""
    return df.where(~F.col("draft").eqNullSafe(True)) if prod else df


def with_any_tag(df: DataFrame, tags: list[str], normalize: bool = False) -> DataFrame:
    """Rows with any of the tags, compared as they stand; no tags: no constraint.

    normalize: tags are trimmed on both sides, so that a link to a tag with stray spaces finds its posts.
    """
    if not tags:
        return df
    own = F.transform("tags", js_trim) if normalize else F.col("tags")
    wanted = [t.strip() for t in tags] if normalize else tags
    return df.where(_no(F.arrays_overlap(own, F.array(*map(F.lit, wanted)))))


def in_categories(df: DataFrame, categories: list[str]) -> DataFrame:
    """Rows whose category is one of these, untrimmed and case-sensitive; '' never matches; none: no constraint."""
    return df.where(_no(F.col("category").isin(*categories) & (F.col("category") != ""))) if categories else df


def without_category(df: DataFrame, asked: str | None = "true") -> DataFrame:
    """Rows whose category is null or ''. Any non-empty `asked` asks for it, `false` too; None and '' do not."""
    return df.where(F.coalesce("category", F.lit("")) == "") if asked else df


def archive_filter(df: DataFrame, tags: list[str] = (), categories: list[str] = (), uncategorized: str | None = None) -> DataFrame:
    """All three filters: any of the tags, and any of the categories, and uncategorized. The last two together keep nothing."""
    return without_category(in_categories(with_any_tag(df, list(tags)), list(categories)), uncategorized)


def shows_update(updated: Column, published: Column) -> Column:
    """There is an update, at another instant than publication."""
    return _no(updated.isNotNull() & (updated != published))


def has_cover(image: Column) -> Column:
    return F.coalesce(image, F.lit("")) != ""
