"""Search: places, headings, words being typed, and the packed index against the full ranking."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from folio.operators import listing, lookup, playlist, search
from folio.plans import site
from folio.schema import conform
from folio.sources import parameters, sinks


def pages(spark, seed=1, n=300):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ell", "el", "sea", "whale", "x") for b in ("", "a", "e", "ipse", "s")]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda: " ".join(r.choices(vocabulary, weights)[0] + r.choice(["", ",", "-", "."]) for _ in range(r.randrange(60)))
    rows = [(f"d{k:03}", f"/{k}/", r.choice(["", None, "Whale", "ella sea"]), r.choice([None, ""]) if k % 40 == 0 else text()) for k in range(n)]
    return rows, spark.createDataFrame(rows, "doc string, url string, title string, content string")


def brute(rows, whole, start=None):
    """(doc, score), best first."""
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    tf, length = {}, {}
    for doc, _, title, content in rows:
        for weight, t in ((10, title), (1, content)):
            for w in tokens(t):
                length[doc] = length.get(doc, 0) + weight
                for term in {w} & set(whole) | ({f"{start}*"} if start and w.startswith(start) else set()):
                    tf[term, doc] = tf.get((term, doc), 0) + weight
    n, mean, score = len(length), sum(length.values()) / max(1, len(length)), {}
    for (term, doc), f in tf.items():
        df = sum(t == term for t, _ in tf)
        score[doc] = score.get(doc, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[doc] / mean))
    return sorted(((d, round(s, 6)) for d, s in score.items()), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("query, whole, start", [("whale ell", ["whale"], "ell"), ("ELL", [], "ell"), ("sea ell ", ["sea", "ell"], None), ("nowhere zzz", ["nowhere"], "zzz"), ("sea sea", ["sea"], "sea"), ("", [], None), ("?!", [], None)])
def test_typed_queries_equal_brute_force(spark, query, whole, start):
    rows, df = pages(spark)
    index = search.build_index(df)
    found = [(r["doc"], r["score"]) for r in search.search(index, query, typed=True).collect()]
    assert sorted(found) == sorted(brute(rows, whole, start))
    packed = search.packed(index, size=8)
    best, read = search.best_of(packed, query, 7, typed=True, size=8)
    assert [s for _, s in sorted(((r["doc"], r["score"]) for r in best.collect()), key=lambda x: (-x[1], x[0]))] == [s for _, s in brute(rows, whole, start)[:7]]
    counts = read.first()
    assert counts["ranges_read"] <= counts["ranges"] and counts["blocks_read"] <= counts["blocks"]


def test_a_prefix_reads_a_range_of_tokens(spark, tmp_path):
    search.build_index(pages(spark)[1]).write(str(tmp_path / "index"))
    index = search.Index.read(spark, str(tmp_path / "index"))
    plan = search.search(index, "ell", typed=True)._jdf.queryExecution().toString()
    assert "StringStartsWith(token,ell)" in plan


def test_ranges_without_good_documents_are_not_read(spark):
    rows = [(f"{k:05}", "", "", " ".join(["rare"] * (6 if k < 40 else 1) + [f"w{i}" for i in range(5 if k < 40 else 60)])) for k in range(1000)]
    index = search.packed(search.build_index(spark.createDataFrame(rows, "doc string, url string, title string, content string")), size=16)
    best, read = search.best_of(index, "rare", 5, size=16, first=1)
    assert sorted(r["doc"] for r in best.collect()) == [f"{k:05}" for k in range(5)]
    assert read.first()["ranges"] == 63 and read.first()["ranges_read"] <= 8
    rebuilt = {(r["token"], r["number"]): r["tf"] for r in search.unpacked(index.blocks, 16).collect()}
    assert rebuilt == {(t, k): 6 if t == "rare" and k < 40 else 1 for k in range(1000) for t in ["rare"] + [f"w{i}" for i in range(5 if k < 40 else 60)]}


BODY = """Before the *whale*.

# First whale

A sea of words, $whale$ and [sea](http://whale.example).

```
whale = code
```

## First whale

> quoted whale-fish here
"""


def test_posts_are_found_under_their_headings(spark):
    posts = conform(spark.createDataFrame([("p", "Title", BODY), ("q", "A whale", "nothing here"), ("r", "None", "no hit")], "slug string, title string, body string").withColumn("published", F.lit("2025-01-01").cast("timestamp")))
    index = site.search_index(posts)
    found = search.sub_results(index, "whale").collect()
    rows = {(r["doc"], r["anchor"]): r for r in found}
    assert set(rows) == {("p", ""), ("p", "first-whale"), ("p", "first-whale-1"), ("q", "")}
    assert rows["p", ""]["locations"] == [2] and rows["p", "first-whale"]["locations"] == [4, 11] and rows["p", "first-whale-1"]["locations"] == [15, 17] and rows["q", ""]["locations"] == []
    assert rows["p", "first-whale"]["url"] == "/posts/p/#first-whale" and rows["p", "first-whale"]["heading"] == "First whale" and rows["p", "first-whale-1"]["depth"] == 2
    assert "<mark>whale</mark> = code" in rows["p", "first-whale"]["excerpt"] and rows["q", ""]["excerpt"] == "nothing here"
    assert [r["doc"] for r in found] == ["q", "p", "p", "p"] and [r["anchor"] for r in found[1:]] == ["", "first-whale", "first-whale-1"]
    assert search.search(index, "http").count() == 0 and search.search(index, "example").count() == 0  # addresses are not indexed
    assert {r["doc"] for r in search.sub_results(index, "whale", limit=1).collect()} == {"q"}


def test_deep_pages_robots_and_sitemap_index(spark, tmp_path):
    posts = conform(spark.range(200).select(F.format_string("s%03d", "id").alias("slug"), F.lit("T").alias("title"), F.timestamp_seconds(F.col("id") * 86400).alias("published")))
    sinks.write_list_pages(posts, str(tmp_path / "list"))
    assert [r["slug"] for r in sinks.list_page(spark, str(tmp_path / "list"), 25).collect()] == [r["slug"] for r in listing.page_slice(posts, 25).collect()] == [f"s{n:03}" for n in range(7, -1, -1)]
    assert sinks.list_page(spark, str(tmp_path / "list"), 26).count() == 0
    sinks.write_sitemap(posts, str(tmp_path / "map"), most=50)
    index = (tmp_path / "map" / "sitemap-index.xml").read_text()
    assert index.count("<loc>https://example.org/sitemap/files/file=") == 5 and not (tmp_path / "map" / "index").exists()
    rules = spark.createDataFrame([("https://a", "/x/"), ("https://a", "/x/"), ("https://a", "/b/"), ("https://c/", None)], "origin string, path string")
    lines = {o: [r["value"] for r in sinks.robots_of(rules).where(F.col("origin") == o).orderBy("nth", "value").collect()] for o in ("https://a", "https://c/")}
    assert lines == {"https://a": ["User-agent: *", "Disallow: /b/", "Disallow: /x/", "", "Sitemap: https://a/sitemap-index.xml"], "https://c/": ["User-agent: *", "Disallow:", "", "Sitemap: https://c/sitemap-index.xml"]}


def test_feed_of_rendered_bodies(spark):
    posts = conform(spark.createDataFrame([("a", "A", "<p onclick=x>hi<script>y</script> <img src='i.png'></p>\x00")], "slug string, title string, body string").withColumn("published", F.lit(None).cast("timestamp")))
    assert sinks.rss_items(posts, rendered=True).first()["content"] == '<p>hi <img src="i.png" /></p>'


def test_links_tracks_and_other_tracks_as_tables(spark):
    links = spark.createDataFrame([(1, "home", None, None, False, "es"), (2, None, "Own", "/own/", None, None), (3, None, "Ext", "https://x", True, "en")], "n int, key string, name string, path string, external boolean, lang string")
    named = {r["n"]: (r["name"], r["url"]) for r in lookup.navigation_of(links, lookup.english(spark), "/b/").collect()}
    assert named == {1: ("Home", "/b/"), 2: ("Own", "/b/own/"), 3: ("Ext", "https://x")}
    asked = spark.createDataFrame([("src=%2Fa%2Fs.mp3&src=2",), ("src=",), ("title=T&src=x&artist=A+B",), (None,)], "q string")
    found = [tuple(r) for r in asked.select(*[c.alias(k) for k, c in parameters.track_parameters(F.col("q")).items()]).collect()]
    assert found == [("s.mp3", "", "/a/s.mp3"), (None, "", None), ("T", "A B", "x"), (None, "", None)]
    drawn = spark.range(6000).select((F.col("id") % 4).alias("now"), playlist.another_index(F.col("id") % 4, F.lit(4), F.col("id")).alias("idx"))
    counts = {(r["now"], r["idx"]): r["count"] for r in drawn.groupBy("now", "idx").count().collect()}
    assert set(counts) == {(a, b) for a in range(4) for b in range(4) if a != b} and min(counts.values()) > 400
    assert spark.range(1).select(playlist.another_index(F.lit(0), F.lit(1), F.col("id"))).first()[0] is None


def test_a_packed_index_moves_postings_once(spark, tmp_path):
    rows, df = pages(spark, n=60)
    index = search.build_index(df)
    packed = search.packed(index, size=8)
    plan = packed.blocks._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(token") == 1 and "Exchange rangepartitioning" not in plan
    packed.write(str(tmp_path / "packed"))
    kept = search.unpacked_postings(search.PackedIndex.read(spark, str(tmp_path / "packed")), 8)
    assert sorted(map(tuple, kept.select("token", "doc", F.col("tf").cast("long")).collect())) == sorted(map(tuple, index.postings.select("token", "doc", "tf").collect()))


def test_a_document_given_twice_has_its_words_added_up(spark, tmp_path):
    df = spark.createDataFrame([("a", "", "T", "sea sea"), ("a", "", None, "sea b"), ("b", "", "", "")], "doc string, url string, title string, content string")
    search.build_index(df).write(str(tmp_path / "index"))
    assert sorted(map(tuple, search.Index.read(spark, str(tmp_path / "index")).postings.select("token", "doc", "tf").collect())) == [("b", "a", 1), ("sea", "a", 3), ("t", "a", 10)]
