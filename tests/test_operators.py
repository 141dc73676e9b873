import random

import pytest
from pyspark.sql import functions as F

from folio.config import NavLink, Site
from folio.operators import archive, filters, listing, lookup, playlist, projections, search, taxonomy, toc
from folio.plans import site
from folio.plans.order import positions, with_neighbours
from folio.plans.storage import passing_tables, written
from folio.schema import conform
from folio.sources import parameters

POSTS = [
    ("b", "B", "2025-10-01", ["Poetic", "Love"], "Romance", False), ("a", "A", "2025-10-01", ["Love", " Love "], " Romance ", False),
    ("c", "C", "2025-01-01", [], None, False), ("d", "D", "2024-04-01", ["constructor", "Love", "Love"], "", None),
    ("e", "E", "2023-08-01", ["éclair", "Zed", "banana"], "  ", True), ("f", "F", "2023-01-01", None, "Uncategorized", False),
]


def posts(spark):
    df = spark.createDataFrame(POSTS, "slug string, title string, p string, tags array<string>, category string, draft boolean")
    return df.withColumn("published", F.to_timestamp("p")).drop("p")


def slugs(df):
    return [r["slug"] for r in df.collect()]


def test_filters(spark):
    p = posts(spark)
    assert slugs(filters.published_only(p)) == list("abcdf")[1:2] + ["a", "c", "d", "f"] and filters.published_only(p, prod=False).count() == 6
    assert slugs(filters.with_any_tag(p, ["Love", "Zed"])) == ["b", "a", "d", "e"] and slugs(filters.with_any_tag(p, [" Love "])) == ["a"]
    assert slugs(filters.with_any_tag(p, ["love"])) == [] and filters.with_any_tag(p, []).count() == 6
    assert slugs(filters.with_any_tag(p.withColumn("tags", F.array(F.lit(" x "))), ["x"], normalize=True)) == list("bacdef")
    assert slugs(filters.in_categories(p, ["Romance", ""])) == ["b"]
    assert slugs(filters.without_category(p, "false")) == ["c", "d"] and filters.without_category(p, "").count() == filters.without_category(p, None).count() == 6
    assert slugs(filters.archive_filter(p, ["Love"], ["Romance"], "true")) == []


def test_order_ties_neighbours_and_pages(spark):
    p = posts(spark)
    assert slugs(listing.sorted_posts(p)) == list("abcdef")
    near = {r["slug"]: (r["nextSlug"], r["prevSlug"], r["nextTitle"], r["prevTitle"]) for r in listing.adjacent(p).collect()}
    assert near["a"] == ("", "b", "", "B") and near["f"] == ("e", "", "E", "") and near["c"] == ("b", "d", "B", "D")
    pages = {r["slug"]: (r["position"], r["page"], r["last_page"], r["prev_url"], r["next_url"]) for r in listing.paginated(p, size=4).collect()}
    assert pages["a"] == (1, 1, 2, None, "/2/") and pages["f"] == (6, 2, 2, "/", None)
    assert slugs(listing.page_slice(p, 2, size=4)) == ["e", "f"]
    empty = p.where("false")
    assert listing.adjacent(empty).count() == listing.paginated(empty).count() == 0


def test_positions_over_many_parts(spark):
    values = list(range(5000))
    random.Random(3).shuffle(values)
    df = spark.createDataFrame([(v, v % 7) for v in values], "v long, position_of_x long").repartition(8)
    found = positions(df, F.desc("v")).collect()
    assert {r["v"]: r["position"] for r in found} == {v: 5000 - v for v in values} and {r["total"] for r in found} == {5000}
    near = with_neighbours(df.withColumn("s", F.col("v").cast("string")), [F.col("v")], {"up": ("s", 1), "down": ("s", -1)}).collect()
    assert all(r["up"] == (str(r["v"] + 1) if r["v"] < 4999 else "") and r["down"] == (str(r["v"] - 1) if r["v"] else "") for r in near)


def strip_by_steps(cur, last):
    """Grows around the current page until five are shown, then closes the gaps."""
    low = high = cur
    while high - low < 4 and (low > 1 or high < last):
        if low > max(1, cur - 2) or (high == last and low > 1):
            low -= 1
        elif high < last:
            high += 1
        else:
            low -= 1
    shown = [*range(low, high + 1)]
    head = [] if low == 1 else [1] if low == 2 else [1, 2] if low == 3 else [1, -1]
    tail = [] if high == last else [last] if high == last - 1 else [last - 1, last] if high == last - 2 else [-1, last]
    return head + shown + tail


def test_page_strip(spark):
    df = spark.range(1, 30).select(F.col("id").alias("last")).withColumn("cur", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))))
    for r in df.select("cur", "last", listing.page_strip(F.col("cur"), F.col("last")).alias("s")).collect():
        assert r["s"] == strip_by_steps(r["cur"], r["last"]), (r["cur"], r["last"])


def test_counts(spark):
    p = posts(spark)
    tags = {r["name"]: (r["count"], r["url"]) for r in taxonomy.tag_counts(p).collect()}
    assert tags["Love"] == (4, "/archive/?tag=Love") and tags[" Love "] == (1, "/archive/?tag=Love") and tags["constructor"][0] == 1
    assert taxonomy.tag_counts(p, normalize=True).where("name = 'Love'").first()["count"] == 5
    names = [r["name"] for r in taxonomy.tag_counts(p).collect()]
    assert names.index("banana") < names.index("éclair") < names.index("Zed")
    found = {r["name"]: (r["count"], r["url"]) for r in taxonomy.category_counts(p).collect()}
    none = "/archive/?uncategorized=true"
    assert found == {"Romance": (2, "/archive/?category=Romance"), "Uncategorized": (3, none), "": (1, none)}
    assert projections.tags_collapsed(taxonomy.tag_counts(p)).first()["collapsed"] is False
    assert projections.categories_collapsed(spark.range(5)).first()["collapsed"] is True


def test_archive(spark):
    p = posts(spark)
    assert [tuple(r) for r in archive.years(p).collect()] == [(2025, 3, "posts"), (2024, 1, "post"), (2023, 2, "posts")]
    assert [r["n_posts"] for r in archive.years(p, tz="America/New_York").collect()] == [2, 2, 1, 1]
    assert [x["slug"] for x in archive.grouped(p).first()["posts"]] == ["a", "b", "c"]
    first = archive.rows(p).first()
    assert (first["year"], first["month_day"], first["url"], first["tags_label"]) == (2025, "10-01", "/posts/a/", "#Love # Love ")
    q = parameters.archive_query("https://x/archive/?tag=a%26b&tag=c+d&category=&uncategorized=false")
    assert q == parameters.ArchiveQuery(("a&b", "c d"), ("",), "false")
    assert [r["n_posts"] for r in site.archive_of(p, "?tag=Love").collect()] == [2, 1]
    columns = parameters.archive_parameters(F.lit("tag=a&tag=b&uncategorized=1"))
    assert tuple(spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()) == (["a", "b"], [], "1")


def test_cards_and_home(spark):
    p = conform(posts(spark).withColumn("body", F.lit("# h\n\nSome words.")).withColumn("updated", F.col("published")))
    card = projections.cards(projections.with_metrics(p)).where("slug = 'c'").first()
    assert (card["category"], card["description"], card["updated"], card["has_cover"], card["minutes"]) == ("Uncategorized", "Some words.", None, False, 1)
    shown = site.home(p, Site(page_size=2)).collect()
    assert {r["slug"]: r["page"] for r in shown} == {"a": 1, "b": 1, "c": 2, "d": 2, "f": 3} and {r["last_page"] for r in shown} == {3}
    only = site.home(p, steps=[lambda d: filters.with_any_tag(d, ["Zed", "Poetic"])], prod=False)
    assert sorted(slugs(only)) == ["b", "e"]


def test_contents(spark):
    rows = [("d", 1, 2, "a", "A#"), ("d", 2, 3, "b", "B"), ("d", 3, 4, "c", "C"), ("d", 4, 2, "e", "E"), ("x", 1, 1, "y", "Y")]
    heads = spark.createDataFrame(rows, "doc string, pos int, depth int, slug string, text string")
    assert sorted(tuple(r) for r in toc.contents(heads).collect()) == [("d", 1, 0, 1, "a", "A"), ("d", 2, 1, None, "b", "B"), ("d", 4, 0, 2, "e", "E"), ("x", 1, 0, 1, "y", "Y")]
    docs = spark.createDataFrame([("d",), ("none",)], "slug string")
    assert {tuple(r) for r in toc.least_depths(docs, heads).collect()} == {("d", 2), ("none", 10)}
    active = heads.withColumn("active", F.col("pos").isin(1, 3, 4))
    assert {tuple(r) for r in toc.visible_run(active).collect()} == {("d", 3, 4), ("x", 1, 1)}


def test_lookups(spark):
    texts = lookup.english(spark).unionByName(spark.createDataFrame([("zh_CN", "home", "主页")], "lang string, key string, text string"))
    asked = spark.createDataFrame([("ZH_cn", "home"), ("zh_cn", "about"), ("xx", "home"), (None, "home"), ("en", "nothing")], "lang string, key string")
    assert sorted(r["text"] or "" for r in lookup.translated(asked, texts).collect()) == ["", "About", "Home", "Home", "主页"]
    docs = spark.createDataFrame([(1, "./img/../a.png"), (2, "/public.png"), (3, "gone.png"), (4, ""), (5, None), (6, "https://x/y.png")], "n int, image string")
    assets = spark.createDataFrame([("posts/x/a.png",), ("posts/x/a.png",)], "path string")
    found = {r["n"]: (r["image_kind"], r["asset"], r["asset_missing"]) for r in lookup.with_assets(docs, assets, "posts/x").collect()}
    assert found[1] == ("local", "posts/x/a.png", False) and found[3] == ("local", None, True) and found[2][0] == "public" and found[4] == found[5] == (None, None, False)
    assert [r["n"] for r in lookup.missing_assets(docs, assets, "posts/x").collect()] == [3]
    nav = lookup.navigation(spark, Site(base="/b/", nav=("home", NavLink("Code", "https://x", True)))).collect()
    assert [(r["name"], r["url"], r["external"]) for r in nav] == [("Home", "/b/", False), ("Code", "https://x", True)]


def test_search(spark, tmp_path):
    rows = [("a", "/a", "Blue whale", "The sea is wide"), ("b", "/b", "Sea", " ".join(f"w{n}" for n in range(40)) + " a whale, here"), ("c", "/c", None, None), ("d", "/d", "Other", "blue blue")]
    index = search.build_index(spark.createDataFrame(rows, "doc string, url string, title string, content string"))
    index.write(str(tmp_path / "index"))
    kept = search.Index.read(spark, str(tmp_path / "index"))
    found = search.search(kept, "WHALE!").collect()
    assert [r["doc"] for r in found] == ["a", "b"] and "<mark>whale,</mark>" in found[1]["excerpt"] and len(found[1]["excerpt"].split()) == 8
    assert search.search(kept, " ?! ").count() == 0 and search.search(kept, "nowhere").count() == 0
    assert [r["doc"] for r in search.search(kept, "blue sea", limit=1).collect()] == ["a"]


def test_playlist(spark):
    default = [("", "", "/music/x.mp3"), ("T", "A", "y.mp3")]
    tracks = parameters.playlist(spark, "https://x/?foo=1", default)
    assert [(r["label"], r["now_playing"]) for r in playlist.track_titles(tracks).orderBy("idx").collect()] == [("Track 1", "x.mp3"), ("T", "T")]
    assert tuple(parameters.playlist(spark, "?src=%2Fa%2Fsong.mp3").first()) == ("song.mp3", "", "/a/song.mp3", 0)
    files = spark.createDataFrame([(0, "Song.MP3", "", "blob:1"), (1, "x.wav", "audio/wav", "blob:2"), (2, "noext", "audio/mpeg", "blob:3"), (3, None, None, "b")], "nth int, name string, type string, src string")
    added = playlist.with_dropped_files(tracks, files).where("idx > 1").orderBy("idx").collect()
    assert [(r["title"], r["src"]) for r in added] == [("Song", "blob:1"), ("noext", "blob:3")]
    assert playlist.shuffled_next(tracks, 0, seed=1).first()["idx"] == 1 and playlist.shuffled_next(tracks.where("idx = 0"), 0, seed=1).count() == 0
    assert [r[0] for r in spark.range(3).select(playlist.ring_index(F.col("id") - 1, F.lit(2))).collect()] == [1, 0, 1]


def test_neighbours_of_null_values_stay_null(spark):
    rows = [(n, None if n % 2 else f"t{n}") for n in range(200)]
    df = spark.createDataFrame(rows, "n long, title string").repartition(7)
    found = {r["n"]: (r["before"], r["after"]) for r in with_neighbours(df, [F.col("n").asc()], {"before": ("title", -1), "after": ("title", 1)}).collect()}
    title = dict(rows)
    assert found == {n: (title[n - 1] if n else "", title[n + 1] if n < 199 else "") for n in range(200)}


def test_passing_tables_go_and_results_stay(spark):
    with passing_tables(spark) as keep:
        first = written(spark.range(5), "first")
        with passing_tables(spark) as keep_inner:
            written(first, "inner")
            second = keep_inner(first.withColumn("x", F.col("id") * 2), "second")
        assert second.count() == 5
        kept = keep(second.where("x > 2"), "kept")
    assert kept.count() == 3
    for gone in (first, second):
        with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
            gone.count()
