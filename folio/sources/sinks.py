"""Exports: feed, linked data, sitemap, robots.txt, pages, search index, and new posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.config import Site
from folio.functions.dates import iso_date, rfc822, today
from folio.functions.html import ENTITY, sanitized
from folio.functions.text import first_truthy, language_tag, markdown_name, valid_xml
from folio.functions.urls import page_url, post_url, url
from folio.operators.listing import newest_first, paginated, sorted_posts
from folio.operators.search import Index
from folio.plans.order import positions

#: Fixed value: addresses that one sitemap file may have.
SITEMAP_URLS = 50_000
#: Items that a file of a feed has at most, unless the caller says otherwise.
FEED_ITEMS = 10_000


def rss_items(posts: DataFrame, site: Site = Site(), rendered: bool = False, whole: str = ENTITY) -> DataFrame:
    """(title, pubDate, description, link, content) of all posts, newest first; content is the source text without what XML does not allow.

    rendered: bodies are HTML; of these the content has allowed tags and attributes only. whole: see sanitized().
    """
    content = valid_xml(F.coalesce("body", F.lit("")))
    return sorted_posts(posts).select(
        "title", rfc822(F.col("published")).alias("pubDate"), F.coalesce("description", F.lit("")).alias("description"),
        post_url(F.col("slug"), site.base).alias("link"), (sanitized(content, whole=whole) if rendered else content).alias("content"),
    )


def _escaped(text: Column) -> Column:
    out = valid_xml(F.coalesce(text, F.lit("")))
    for plain, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(mark))
    return out


def _element(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), _escaped(text), F.lit(f"</{name}>"))


def write_rss(posts: DataFrame, path: str, site: Site = Site(), most: int = FEED_ITEMS) -> None:
    """An RSS 2.0 document in the folder `path`: the channel's title, link, description and language, and an item for each post, newest first.

    most: items of a part file, about; put together in order of their names the files are the document.
    """
    files = max(1, -(-posts.count() // most))
    item = F.concat(F.lit("<item>"), *[_element(c, F.col(c)) for c in ("title", "link")], F.lit('<guid isPermaLink="true">'), _escaped(F.col("link")), F.lit("</guid>"),
                    *[_element(c, F.col(c)) for c in ("description", "pubDate")], _element("content:encoded", F.col("content")), F.lit("</item>"))
    rows = posts.select("slug", "published", "title", "description", "body")
    own = F.concat(F.lit(site.origin.rstrip("/")), post_url(F.col("slug"), site.base))
    items = rows.select(F.lit(1).alias("part"), "slug", "published", "title", rfc822(F.col("published")).alias("pubDate"), "description", own.alias("link"), F.col("body").alias("content"))
    home = F.concat(F.lit(site.origin.rstrip("/")), page_url(F.lit(1), site.base))
    channel = (("title", F.lit(site.title)), ("link", home), ("description", F.lit(site.subtitle or site.title)), ("language", language_tag(F.lit(site.lang))))
    # The document's version and the name space of an item's whole content.
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'), *[_element(n, v) for n, v in channel])
    one = posts.sparkSession.range(1, numPartitions=1)
    ends = [one.select(F.lit(n).alias("part"), F.lit("").alias("slug"), F.lit(None).cast("timestamp").alias("published"), x.alias("value")) for n, x in ((0, head), (2, F.lit("</channel></rss>")))]
    lines = items.select("part", "slug", "published", item.alias("value")).unionByName(ends[0]).unionByName(ends[1])
    order = ["part", *newest_first()]
    lines.repartitionByRange(files, *order).sortWithinPartitions(*order).select("value").write.mode("errorifexists").text(path)


def json_ld(posts: DataFrame, site: Site = Site()) -> DataFrame:
    """(slug, json): one record of linked data per post."""
    record = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("BlogPosting").alias("@type"),
        F.col("title").alias("headline"),
        first_truthy(F.col("description"), F.col("title")).alias("description"),
        F.col("tags").alias("keywords"),
        F.struct(F.lit("Person").alias("@type"), F.lit(site.author).alias("name"), F.lit(site.origin).alias("url")).alias("author"),
        iso_date(F.col("published")).alias("datePublished"),
        language_tag(first_truthy(F.col("lang"), site.lang)).alias("inLanguage"),
    )
    return posts.select("slug", F.to_json(record).alias("json"))


def sitemap(posts: DataFrame, site: Site = Site()) -> DataFrame:
    """(url) of the posts, the list's pages, the archive and the about page. Posts are counted at once."""
    spark = posts.sparkSession
    n_pages = max(1, -(-posts.count() // site.page_size))
    pages = spark.range(1, n_pages + 1).select(page_url(F.col("id"), site.base).alias("url"))
    fixed = spark.createDataFrame([("/archive/",), ("/about/",)], "p string").select(F.regexp_replace(F.concat(F.lit(f"/{site.base}/"), "p"), "/+", "/").alias("url"))
    own = posts.select(post_url(F.col("slug"), site.base).alias("url"))
    return own.unionByName(pages).unionByName(fixed).select(F.concat(F.lit(site.origin.rstrip("/")), "url").alias("url"))


def _store(spark: SparkSession, path: str):
    """The file system that a path is in, and a function that makes paths for it."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), make


def write_sitemap(posts: DataFrame, path: str, site: Site = Site(), most: int = SITEMAP_URLS) -> None:
    """Files of `most` addresses or fewer below path/files, and an index of them, path/sitemap-index.xml."""
    spark = posts.sparkSession
    placed = positions(sitemap(posts, site), F.col("url"))
    numbered = placed.select(F.col("url").alias("loc"), F.floor((F.col("position") - 1) / most).alias("file"))
    numbered.repartition("file").write.partitionBy("file").format("xml").option("rootTag", "urlset").option("rowTag", "url").mode("errorifexists").save(f"{path}/files")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/files")
    name = F.regexp_extract(F.col("path"), r"(files/file=\d+/[^/]+)\z", 1)
    loc = F.concat(F.lit(site.origin.rstrip("/")), url(F.concat(F.lit("/sitemap/"), name), site.base))
    index = found.select(loc.alias("loc")).coalesce(1)  # a row for `most` addresses
    index.write.format("xml").option("rootTag", "sitemapindex").option("rowTag", "sitemap").mode("errorifexists").save(f"{path}/index")
    store, make = _store(spark, path)
    (part,) = [x.getPath() for x in store.listStatus(make(f"{path}/index")) if x.getPath().getName().startswith("part-")]
    store.rename(part, make(f"{path}/sitemap-index.xml"))
    store.delete(make(f"{path}/index"), True)


def robots_of(rules: DataFrame) -> DataFrame:
    """(origin, nth, value): the lines of the robots file of each origin, by nth and then value; rules (origin, path), path null for an origin without any."""
    own = rules.where("path is not null").select("origin", F.lit(1).alias("nth"), F.concat(F.lit("Disallow: "), "path").alias("value")).distinct()
    origins = rules.groupBy("origin").agg(F.count("path").alias("n"))
    fixed = F.array(
        F.struct(F.lit(0).alias("nth"), F.lit("User-agent: *").alias("value")), F.struct(F.when(F.col("n") == 0, 1).alias("nth"), F.lit("Disallow:").alias("value")),
        F.struct(F.lit(2).alias("nth"), F.lit("").alias("value")), F.struct(F.lit(3).alias("nth"), F.concat(F.lit("Sitemap: "), F.regexp_replace("origin", "/+\\z", ""), F.lit("/sitemap-index.xml")).alias("value")),
    )
    return origins.select("origin", F.explode(fixed).alias("l")).select("origin", "l.nth", "l.value").where("nth is not null").unionByName(own)


def robots(spark: SparkSession, site: Site = Site()) -> DataFrame:
    lines = ["User-agent: *", *([f"Disallow: {x}" for x in site.disallow] or ["Disallow:"]), "", f"Sitemap: {site.origin.rstrip('/')}/sitemap-index.xml"]
    return spark.createDataFrame([("\n".join(lines),)], "value string")


def write_robots(spark: SparkSession, path: str, site: Site = Site()) -> None:
    robots(spark, site).coalesce(1).write.mode("errorifexists").text(path)


def write_posts(posts: DataFrame, path: str, buckets: int = 256) -> None:
    """Posts by address. A folder per slug would be a file per row; a hash of it gives a fixed number of folders that a lookup prunes."""
    posts.withColumn("bucket", F.pmod(F.xxhash64("slug"), F.lit(buckets))).write.partitionBy("bucket").mode("errorifexists").parquet(path)


def post_at(spark: SparkSession, path: str, slug: str, buckets: int = 256) -> DataFrame:
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(slug)), F.lit(buckets)).alias("b")).select("b").scalar()
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("slug") == slug)).drop("bucket")


def write_list_pages(posts: DataFrame, path: str, site: Site = Site()) -> None:
    """The list, bodies dropped, with page numbers, in order; statistics of page let a reader skip to one page."""
    pages = paginated(posts.drop("body"), site.page_size, site.base)
    pages.repartitionByRange("page", "position").sortWithinPartitions("page", "position").write.mode("errorifexists").parquet(path)


def list_page(spark: SparkSession, path: str, page: int) -> DataFrame:
    """A page of what write_list_pages() wrote, in order, however deep it lies: files and row groups of other pages are skipped."""
    return spark.read.parquet(path).where(F.col("page") == page).orderBy("position")


def write_index(index: Index, path: str) -> None:
    index.write(path)


def new_post(spark: SparkSession, folder: str, name: str, day: str | None = None) -> str:
    """Writes a post's empty front matter to the file folder/name.md and returns that path; fails if it is there. Folders are made; Hadoop takes no colon in names."""
    # The fields of a new post, in their order.
    fields = ("title", "published", "description", "image", "tags", "category", "draft", "lang")
    known = spark.range(1).select(markdown_name(F.lit(name)).alias("file"), (F.lit(day) if day else today()).alias("day")).first()
    values = {"title": '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '"', "published": known["day"], "tags": "[]", "draft": "false"}
    text = "\n".join(["---", *(f"{k}: {values.get(k, chr(39) * 2)}" for k in fields), "---", ""])
    path = f"{folder.rstrip('/')}/{known['file']}"
    store, make = _store(spark, path)
    file = make(path)
    if store.exists(file):
        raise FileExistsError(path)
    out = store.create(file, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    return path
