"""Lookups: images in the asset list, texts in translations, navigation presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.config import Site
from folio.functions.urls import image_kind, normalized_path, url

# Texts by key in English.
ENGLISH = {
    "home": "Home", "about": "About", "archive": "Archive", "search": "Search",
    "tags": "Tags", "categories": "Categories", "recentPosts": "Recent Posts", "comments": "Comments",
    "untitled": "Untitled", "uncategorized": "Uncategorized", "noTags": "No Tags",
    "wordCount": "word", "wordsCount": "words", "minuteCount": "minute", "minutesCount": "minutes", "postCount": "post", "postsCount": "posts",
    "themeColor": "Theme Color", "lightMode": "Light", "darkMode": "Dark", "systemMode": "System",
    "more": "More", "author": "Author", "publishedAt": "Published at", "license": "License",
}
# Language codes (lower case) and the dictionary that each uses.
LANGUAGES = {
    "es": "es", "en": "en", "en_us": "en", "en_gb": "en", "en_au": "en", "zh_cn": "zh_CN", "zh_tw": "zh_TW", "ja": "ja", "ja_jp": "ja",
    "ko": "ko", "ko_kr": "ko", "th": "th", "th_th": "th", "vi": "vi", "vi_vn": "vi", "id": "id", "tr": "tr", "tr_tr": "tr",
}
# Navigation presets, by the key of their name.
PRESETS = {"home": "/", "about": "/about/", "archive": "/archive/"}


def english(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("en", k, t) for k, t in ENGLISH.items()], "lang string, key string, text string")


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """(lang, key, text) from JSON lines of these columns, with English where it has none."""
    found = spark.read.schema("lang string, key string, text string").json(path).where("lang is not null and key is not null").dropDuplicates(["lang", "key"])
    return found.unionByName(english(spark).join(found, ["lang", "key"], "left_anti"))


def dictionary_of(lang: Column) -> Column:
    """The dictionary of a language code in any case; en for unknown ones and null."""
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(lang)), F.lit("en"))


def translated(df: DataFrame, translations: DataFrame, lang: str = "lang", key: str = "key", out: str = "text") -> DataFrame:
    """df with the text of (lang, key): of the code's dictionary, else the English one; null for unknown keys.

    Spark broadcasts the translations below its own size limit and shuffles otherwise.
    """
    own = translations.select(F.col("lang").alias("__lang"), F.col("key").alias("__key"), F.col("text").alias("__own"))
    base = translations.where("lang = 'en'").select(F.col("key").alias("__base_key"), F.col("text").alias("__base"))
    found = df.join(own, (dictionary_of(df[lang]) == F.col("__lang")) & (df[key] == F.col("__key")), "left").join(base, df[key] == F.col("__base_key"), "left")
    return found.select(*[df[c] for c in df.columns if c != out], F.coalesce("__own", "__base").alias(out))


def with_assets(df: DataFrame, assets: DataFrame, base_path: str = "", image: str = "image") -> DataFrame:
    """df with image_kind, asset (the path found for a local image) and asset_missing. assets (path), relative to the content's root.

    A local path is taken below base_path and normalized; other kinds look nothing up.
    """
    src = F.coalesce(F.col(image), F.lit(""))
    local = F.when((src != "") & (image_kind(src) == "local"), normalized_path(F.concat(F.lit(f"{base_path}/" if base_path else ""), src)))
    wanted = df.withColumn("__path", local)
    known = assets.select(normalized_path(F.col("path")).alias("asset")).distinct()
    found = wanted.join(known, F.col("__path") == F.col("asset"), "left")
    return found.select(*df.columns, F.when(src != "", image_kind(src)).alias("image_kind"), "asset", (F.col("__path").isNotNull() & F.col("asset").isNull()).alias("asset_missing"))


def missing_assets(df: DataFrame, assets: DataFrame, base_path: str = "", image: str = "image") -> DataFrame:
    """The rows whose local image is not among the assets."""
    return with_assets(df, assets, base_path, image).where("asset_missing").drop("asset", "asset_missing")


def navigation_of(links: DataFrame, translations: DataFrame, base: str = "/") -> DataFrame:
    """links (key, name, path, external, lang and others) with name and url: a preset's key gives both, in the dictionary of lang; other links keep theirs."""
    presets = F.create_map(*[F.lit(x) for kv in PRESETS.items() for x in kv])
    named = translated(links.withColumn("__preset", F.col("key")), translations, key="__preset", out="__text")
    path = F.coalesce(F.try_element_at(presets, F.col("key")), F.col("path"))
    where = F.when(F.coalesce("external", F.lit(False)), path).otherwise(url(path, base))
    return named.withColumns({"name": F.coalesce(F.when(F.col("key").isNotNull(), F.col("__text")), "name"), "url": where}).drop("__text", "__preset", "path")


def navigation(spark: SparkSession, site: Site, translations: DataFrame | None = None) -> DataFrame:
    """(nth, name, url, external) of the site's links; presets are named in its language."""
    rows = [(n, x, None, None, False) if isinstance(x, str) else (n, None, x.name, x.url, x.external) for n, x in enumerate(site.nav)]
    links = spark.createDataFrame(rows, "nth int, key string, name string, path string, external boolean").withColumn("lang", F.lit(site.lang))
    return navigation_of(links, translations if translations is not None else english(spark), site.base).select("nth", "name", "url", "external").orderBy("nth")
