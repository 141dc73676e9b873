"""The site's queries from end to end, as lists of steps applied in order."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.config import Site
from folio.functions.blocks import with_blocks
from folio.functions.markdown import headings_of, plain_lines, slugged, unique_names
from folio.functions.urls import post_url, url
from folio.operators import archive, filters, listing, projections, search
from folio.sources import sinks
from folio.sources.parameters import archive_query

Step = Callable[[DataFrame], DataFrame]


def applied(df: DataFrame, steps: Iterable[Step]) -> DataFrame:
    """The extension point: each step sees what the one before made, so their order counts."""
    return reduce(DataFrame.transform, steps, df)


def home(posts: DataFrame, site: Site = Site(), prod: bool = True, steps: Iterable[Step] = ()) -> DataFrame:
    """Cards with page numbers and neighbours, newest first; `steps` run on the posts before."""
    found = applied(filters.published_only(posts, prod), steps)
    shown = projections.with_metrics(found)
    paged = listing.adjacent_and_paginated(shown.drop("body", "nextSlug", "nextTitle", "prevSlug", "prevTitle"), site.page_size, site.base)
    return paged.select(*projections.cards(paged, site.base).columns[:2], "page", "last_page", "position", "nextSlug", "prevSlug", "words", "minutes", "excerpt")


def archive_of(posts: DataFrame, address: str = "", prod: bool = True, tz: str = "UTC") -> DataFrame:
    """Years with their number of posts, of those that the URL's parameters leave."""
    q = archive_query(address)
    return archive.years(filters.archive_filter(filters.published_only(posts, prod), list(q.tags), list(q.categories), q.uncategorized), tz)


def feed(posts: DataFrame, site: Site = Site(), prod: bool = True) -> DataFrame:
    return sinks.rss_items(filters.published_only(posts, prod), site)


def searchable(posts: DataFrame, doc: str = "slug", body: str = "body") -> DataFrame:
    """(doc, content, headings) of Markdown texts: what a page shows, and each heading's anchor, text, depth and the number of words before it."""
    texts = with_blocks(posts, doc, body).withColumn("found", headings_of(F.col("lines"), F.col("blocks")))
    read = texts.select("doc", "found", unique_names(F.transform("found", lambda h: slugged(h["text"]))).alias("anchors"), plain_lines(F.col("lines"), F.col("blocks"), math=False, rendered=True).alias("plain"))
    before = lambda line: F.aggregate(F.slice("plain", F.lit(1), line), F.lit(0), lambda n, x: n + F.size(search.content_words(x)))
    headings = F.transform("found", lambda h, i: F.struct(F.get("anchors", i).alias("anchor"), h["text"].alias("text"), h["depth"].alias("depth"), before(h["line"]).alias("location")))
    return read.select("doc", F.array_join(F.filter("plain", lambda x: F.trim(x) != ""), "\n").alias("content"), headings.alias("headings"))


def search_index(posts: DataFrame, site: Site = Site(), prod: bool = True, pages: DataFrame | None = None) -> search.Index:
    """Of posts, with their titles, and of pages (id, body), such as the about page, without; both are Markdown and indexed as they are shown. Rendered pages can be indexed by build_index() after html_text()."""
    found = filters.published_only(posts, prod)
    texts = found.select(F.col("slug").alias("doc"), post_url(F.col("slug"), site.base).alias("url"), "title", "body")
    if pages is not None:
        address = url(F.concat(F.lit("/"), F.col("id"), F.lit("/")), site.base)
        texts = texts.unionByName(pages.select(F.col("id").alias("doc"), address.alias("url"), F.lit("").alias("title"), "body"))
    named = texts.withColumn("__own", F.struct("doc", "url", "title"))
    read = searchable(named, "__own").select("doc.doc", "doc.url", "doc.title", "content", "headings")
    return search.build_index(read)
