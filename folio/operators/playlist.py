"""A playlist (title, artist, src, idx): stepping, shuffling and adding files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.urls import basename


def ring_index(index: Column, size: Column) -> Column:
    """The place on a ring: -1 is the last, size the first."""
    return F.pmod(index, size)


def shuffled_next(playlist: DataFrame, current: int, seed: int) -> DataFrame:
    """Another track than the current one, drawn evenly; none if there is no other."""
    return playlist.where(F.col("idx") != current).orderBy(F.rand(seed), "idx").limit(1)


def another_index(current: Column, size: Column, *draw: Column) -> Column:
    """For a table of listeners: a place other than the current one, drawn by a hash of `draw`, each of them as likely; null if there is no other."""
    others = size - 1
    return F.when(others > 0, F.pmod(current + 1 + F.pmod(F.xxhash64(*draw), F.when(others > 0, others).otherwise(1)), size))


def track_titles(playlist: DataFrame) -> DataFrame:
    """playlist with label (title, else Track n) and now_playing (title, else the file's name)."""
    titled = F.nullif(F.col("title"), F.lit(""))
    return playlist.withColumns({"label": F.coalesce(titled, F.format_string("Track %d", F.col("idx") + 1)), "now_playing": F.coalesce(titled, basename(F.col("src")))})


def with_dropped_files(playlist: DataFrame, files: DataFrame) -> DataFrame:
    """The playlist and after it the MP3 files of files (nth, name, type, src), known by type or ending; titles without the ending."""
    keep = (F.col("type") == "audio/mpeg") | F.endswith(F.lower("name"), F.lit(".mp3"))
    last = playlist.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("m")).select("m").scalar()
    added = files.where(F.coalesce(keep, F.lit(False))).select(F.regexp_replace("name", r"(?i)\.mp3\z", "").alias("title"), F.lit("").alias("artist"), "src", (last + 1 + F.col("nth")).cast("int").alias("idx"))
    return playlist.select("title", "artist", "src", "idx").unionByName(added)
