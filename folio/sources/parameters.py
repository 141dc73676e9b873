"""Query parameters from URLs, for one reader and for columns of URLs."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.urls import basename, query_values


@dataclass(frozen=True)
class ArchiveQuery:
    tags: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    uncategorized: str | None = None


def archive_query(url: str) -> ArchiveQuery:
    """tag and category may repeat; of uncategorized the first counts, with any value."""
    pairs = parse_qsl(urlsplit(url).query, keep_blank_values=True)
    of = lambda key: tuple(v for k, v in pairs if k == key)
    return ArchiveQuery(of("tag"), of("category"), next(iter(of("uncategorized")), None))


def archive_parameters(query: Column) -> dict[str, Column]:
    """The same as columns, for a table of requests: tags, categories, uncategorized."""
    return {"tags": query_values(query, "tag"), "categories": query_values(query, "category"), "uncategorized": F.try_element_at(query_values(query, "uncategorized"), F.lit(1))}


PLAYLIST = "title string, artist string, src string, idx int"


def track_parameters(query: Column) -> dict[str, Column]:
    """The track that a query names, as columns for a table of requests: src (null without one), title (else the file's name) and artist (else '')."""
    first = lambda key: F.try_element_at(query_values(query, key), F.lit(1))
    src = F.nullif(first("src"), F.lit(""))
    return {"title": F.coalesce(F.nullif(first("title"), F.lit("")), basename(src)), "artist": F.coalesce(first("artist"), F.lit("")), "src": src}


def playlist(spark: SparkSession, url: str, default: list[tuple[str, str, str]] = ()) -> DataFrame:
    """The track that a URL names by src (title and artist optional), else the default (title, artist, src)."""
    first: dict[str, str] = {}
    for k, v in parse_qsl(urlsplit(url).query, keep_blank_values=True):
        first.setdefault(k, v)
    if not first.get("src"):
        return spark.createDataFrame([(*t, n) for n, t in enumerate(default)], PLAYLIST)
    one = spark.createDataFrame([(first.get("title"), first.get("artist") or "", first["src"], 0)], PLAYLIST)
    return one.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), basename(F.col("src")))).select("title", "artist", "src", "idx")
