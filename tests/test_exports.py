import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from folio.config import Site
from folio.operators import search
from folio.plans import site
from folio.schema import conform
from folio.sources import repositories, sinks
from folio.sources.markdown import read_posts
from folio.streaming.watch import running_tag_counts, watch_posts

SITE = Site(title="S", origin="https://example.org", author="Someone", page_size=1)


def posts(spark):
    rows = [("old", "Old", "2024-01-02", "", "b\x00ody & <x>", ["t"], ""), ("new", "New", "2025-01-02", "Desc", "text ::x", ["u"], "pt_BR")]
    return conform(spark.createDataFrame(rows, "slug string, title string, p string, description string, body string, tags array<string>, lang string").withColumn("published", F.to_timestamp("p")))


def test_feed(spark, tmp_path):
    items = site.feed(posts(spark), SITE).collect()
    assert [r["title"] for r in items] == ["New", "Old"] and items[1]["content"] == "body & <x>" and items[0]["link"] == "/posts/new/"
    sinks.write_rss(posts(spark), str(tmp_path / "rss"), SITE)
    feed = ElementTree.fromstring("".join(p.read_text() for p in sorted((tmp_path / "rss").glob("part-*"))))
    channel = feed.find("channel")
    assert feed.tag == "rss" and feed.get("version") == "2.0" and [channel.findtext(x) for x in ("title", "link", "description", "language")] == ["S", "https://example.org/", "S", "en"]
    found = [(x.findtext("title"), x.findtext("link"), x.findtext("{http://purl.org/rss/1.0/modules/content/}encoded")) for x in channel.findall("item")]
    assert found == [("New", "https://example.org/posts/new/", "text ::x"), ("Old", "https://example.org/posts/old/", "body & <x>")]
    sinks.write_rss(posts(spark), str(tmp_path / "cut"), SITE, most=1)
    assert "".join(p.read_text() for p in sorted((tmp_path / "cut").glob("part-*"))) == "".join(p.read_text() for p in sorted((tmp_path / "rss").glob("part-*")))


def test_linked_data_sitemap_and_robots(spark, tmp_path):
    found = {r["slug"]: json.loads(r["json"]) for r in sinks.json_ld(posts(spark), SITE).collect()}
    assert found["old"]["description"] == "Old" and found["new"]["inLanguage"] == "pt-BR" and found["old"]["inLanguage"] == "en"
    assert found["new"]["datePublished"] == "2025-01-02" and found["new"]["keywords"] == ["u"] and found["new"]["@type"] == "BlogPosting"
    urls = {r["url"] for r in sinks.sitemap(posts(spark), SITE).collect()}
    assert urls == {f"https://example.org{x}" for x in ("/posts/old/", "/posts/new/", "/", "/2/", "/archive/", "/about/")}
    sinks.write_sitemap(posts(spark), str(tmp_path / "map"), SITE)
    sinks.write_robots(spark, str(tmp_path / "robots"), SITE)
    assert "Sitemap: https://example.org/sitemap-index.xml" in "".join(p.read_text() for p in (tmp_path / "robots").glob("part-*"))


def test_pages(spark, tmp_path):
    sinks.write_posts(posts(spark), str(tmp_path / "posts"))
    assert sinks.post_at(spark, str(tmp_path / "posts"), "new").first()["title"] == "New" and sinks.post_at(spark, str(tmp_path / "posts"), "none").count() == 0
    sinks.write_list_pages(posts(spark), str(tmp_path / "list"), SITE)
    assert [r["slug"] for r in spark.read.parquet(str(tmp_path / "list")).where("page = 2").collect()] == ["old"]
    sinks.write_index(site.search_index(posts(spark), SITE), str(tmp_path / "index"))
    assert [r["doc"] for r in search.search(search.Index.read(spark, str(tmp_path / "index")), "new").collect()] == ["new"]


def test_new_post_fails_if_there(spark, tmp_path):
    path = sinks.new_post(spark, str(tmp_path), "some/thing", day="2025-01-01")
    assert path.endswith("some/thing.md") and "published: 2025-01-01" in (tmp_path / "some" / "thing.md").read_text()
    with pytest.raises(FileExistsError):
        sinks.new_post(spark, str(tmp_path), "some/thing")
    sinks.new_post(spark, str(tmp_path), 'a "quoted" name.MDX')
    sinks.new_post(spark, str(tmp_path), 'a "quoted" name')
    found = {r["title"]: r for r in read_posts(spark, str(tmp_path)).collect()}  # *.md only
    assert set(found) == {"some/thing", 'a "quoted" name'} and found["some/thing"]["tags"] == [] and found["some/thing"]["draft"] is False and str(found["some/thing"]["published"])[:10] == "2025-01-01"


def test_the_index_has_pages_too(spark):
    pages = spark.createDataFrame([("about", "who writes this")], "id string, body string")
    found = search.search(site.search_index(posts(spark), SITE, pages=pages), "writes text").collect()
    assert {(r["doc"], r["url"]) for r in found} == {("about", "/about/"), ("new", "/posts/new/")}


def test_repository_cards(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"full_name": "o/r", "description": ":x: Good", "language": "C", "forks": 1234, "stargazers_count": 5}))
    docs = posts(spark).withColumn("body", F.when(F.col("slug") == "new", '::github{repo="o/r"}').otherwise('::github{repo="bad"}'))
    found = {r["doc"]: r for r in repositories.cards(docs, repositories.read_snapshot(spark, str(tmp_path / "s.json"))).collect()}
    assert (found["new"]["description"], found["new"]["forks"], found["new"]["license"], found["new"]["owner"]) == (" Good", "1.2K", "no-license", "o") and found["old"]["valid"] is False


def test_watched_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"p{n}.md").write_text(f"---\ntitle: P{n}\npublished: 2025-01-0{n + 1}\ntags: [all, t{n}]\n---\nx")
    counts = running_tag_counts(watch_posts(spark, str(tmp_path / "in")))
    query = counts.writeStream.format("memory").queryName("watched").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        assert {r["name"]: r["count"] for r in spark.table("watched").collect()} == {"all": 3, "t0": 1, "t1": 1, "t2": 1}
    finally:
        query.stop()
