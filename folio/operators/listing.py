"""Order, neighbours and pages. Equal dates are ordered by slug, so that links and pages are fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.config import ADJACENT_PAGES, PAGE_SIZE
from folio.functions.urls import page_url
from folio.plans.order import positions, positions_and_neighbours, with_neighbours

#: What a post is told of the newer and the older one.
_ADJACENT = {"nextSlug": ("slug", -1), "nextTitle": ("title", -1), "prevSlug": ("slug", 1), "prevTitle": ("title", 1)}


def newest_first() -> list[Column]:
    return [F.col("published").desc_nulls_last(), F.col("slug").asc_nulls_last()]


def sorted_posts(df: DataFrame) -> DataFrame:
    return df.orderBy(*newest_first())


def by_name(df: DataFrame, name: str = "name") -> DataFrame:
    """In alphabetical order of all scripts without regard to case; equal ones by code point."""
    return df.orderBy(F.collate(F.lower(name), "UNICODE"), F.col(name))


def adjacent(df: DataFrame) -> DataFrame:
    """df with nextSlug, nextTitle (the newer post) and prevSlug, prevTitle (the older one); '' at the ends."""
    return with_neighbours(df, newest_first(), _ADJACENT)


def paginated(df: DataFrame, size: int = PAGE_SIZE, base: str = "/") -> DataFrame:
    """df with page, position, last_page, prev_url, next_url (null at the ends) and delay_ms, newest first."""
    return _paged(positions(df, *newest_first(), position="position", total="__total"), size, base)


def adjacent_and_paginated(df: DataFrame, size: int = PAGE_SIZE, base: str = "/") -> DataFrame:
    """adjacent() and paginated() in one go: the order is made once."""
    return _paged(positions_and_neighbours(df, newest_first(), _ADJACENT, position="position", total="__total"), size, base)


def _paged(placed: DataFrame, size: int, base: str) -> DataFrame:
    page = (F.floor((F.col("position") - 1) / size) + 1).cast("long")
    paged = placed.withColumns({"page": page, "last_page": F.ceil(F.col("__total") / size).cast("long"), "delay_ms": F.pmod(F.col("position") - 1, F.lit(size)) * 50})
    links = {
        "prev_url": F.when(F.col("page") > 1, page_url(F.col("page") - 1, base)),
        "next_url": F.when(F.col("page") < F.col("last_page"), page_url(F.col("page") + 1, base)),
    }
    return paged.withColumns(links).drop("__total")


def page_slice(df: DataFrame, page: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page, in order. Only the rows up to its end are kept while sorting."""
    return df.orderBy(*newest_first()).limit(page * size).offset((page - 1) * size)


def page_strip(current: Column, last: Column) -> Column:
    """Page numbers to show: five around the current one, the first and last, and -1 for a gap of two or more."""
    around = 2 * ADJACENT_PAGES
    low = F.greatest(F.lit(1), F.least(current - ADJACENT_PAGES, last - around))
    high = F.least(last, F.greatest(current + ADJACENT_PAGES, F.lit(around + 1)))
    some = lambda when, x: F.when(when, F.array(x.cast("int"))).otherwise(F.array().cast("array<int>"))
    gap = F.lit(-1)
    return F.concat(
        some(low > 1, F.lit(1)),
        F.when(low > 3, F.array(gap)).otherwise(some(low == 3, F.lit(2))),
        F.sequence(low.cast("int"), high.cast("int")),
        F.when(high < last - 2, F.array(gap)).otherwise(some(high == last - 2, last - 1)),
        some(high < last, last),
    )
