from urllib.parse import quote

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.functions import dates, html, text, urls
from folio.functions.markdown import repository


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", list: "array<string>", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column).first()[0]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=20), min_size=1, max_size=60))
def test_components_are_encoded_and_decoded(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", urls.encode_uri_component(F.col("v")).alias("e"))
    for v, e, d in df.select("v", "e", urls.decode_uri_component(F.col("e"))).collect():
        assert e == quote(v, safe="!'()*~-._") and d == v


def test_urls(spark):
    v = F.col("v")
    assert one(spark, urls.tag_url(v), v="  Poetry & Prose ") == "/archive/?tag=Poetry%20%26%20Prose"
    assert [one(spark, urls.tag_url(v, "/b/"), v=x) for x in (None, "")] == ["/b/archive/"] * 2
    assert {one(spark, urls.category_url(v), v=x) for x in (None, "", " \t", "uncategorized", " UNCATEGORIZED ")} == {"/archive/?uncategorized=true"}
    assert one(spark, urls.category_url(v), v=" a b ") == "/archive/?category=a%20b"
    assert [one(spark, urls.directory(v), v=x) for x in ("a/b/c.md", "c.md", "/")] == ["a/b/", "/", "/"]
    assert one(spark, urls.paths_equal(v, F.lit("About")), v="/about/")
    assert [one(spark, urls.page_url(v), v=n) for n in (1, 2)] == ["/", "/2/"]
    paths = {"a/./b//c": "a/b/c", "../x/../y": "../y", "/../a": "/a", "a/..": ".", "": "."}
    assert {p: one(spark, urls.normalized_path(v), v=p) for p in paths} == paths
    assert [one(spark, urls.image_kind(v), v=x) for x in ("a.png", "/a.png", "https://x", "data:x")] == ["local", "public", "remote", "remote"]
    assert one(spark, urls.query_values(v, "tag"), v="?tag=a+b&x=1&tag=%26&tag") == ["a b", "&", ""]


def test_dates(spark):
    v = F.col("v").cast("timestamp")
    assert one(spark, dates.year(v, "America/New_York"), v="2025-01-01") == 2024 and one(spark, dates.year(v), v="2025-01-01") == 2025
    assert one(spark, dates.month_day(v, "America/New_York"), v="2025-01-01") == "12-31"
    assert one(spark, dates.rfc822(v), v="2025-10-01") == "Wed, 01 Oct 2025 00:00:00 GMT"
    assert [one(spark, dates.track_time(F.col("v")), v=x) for x in (0.0, 61.9, float("nan"), float("inf"))] == ["0:00", "1:01", "0:00", "0:00"]
    assert len(one(spark, dates.today())) == 10 and one(spark, dates.current_year()) >= 2025


def test_text(spark):
    v = F.col("v")
    assert one(spark, text.js_trim(v), v=" ﻿\t a b\n") == "a b"
    assert [one(spark, text.reading_minutes(v), v=n) for n in (0, 299, 300, 500)] == [1, 1, 2, 3]
    assert one(spark, text.word_count(v), v="one 漢字 two") == 4 and one(spark, text.word_count(v), v=None) == 0
    assert one(spark, text.formatted_tags(v), v=["a", "b"]) == "#a #b" and one(spark, text.without_trailing_hash(v), v="x##") == "x#"
    assert one(spark, text.valid_xml(v), v="a\x00b\x85c\td") == "abc\td" and one(spark, text.language_tag(v), v="zh_CN_x") == "zh-CN_x"
    assert [one(spark, text.markdown_name(v), v=x) for x in ("a", "a.MD", "a.mdx")] == ["a.md", "a.MD", "a.mdx"]
    numbers = {0: "0", 999: "999", 1000: "1K", 1234: "1.2K", 999_950: "1M", 4_500_000_000: "4.5B"}
    assert {n: one(spark, text.compact_number(v), v=n) for n in numbers} == numbers
    assert one(spark, text.without_emoji_codes(v), v=":star: hi :a_1:") == " hi "
    assert tuple(one(spark, repository(v), v="a/b/c")) == ("a", "b", True) and tuple(one(spark, repository(v), v="a")) == (None, None, False)
    page = '<title> T </title><script>no</script><p>a<b>b</b> <span class="katex">x</span> <i data-ignore>skip</i>c</p>'
    assert one(spark, html.html_text(v), v=page) == "T a b c" and one(spark, html.html_title(v), v=page) == "T"
    assert one(spark, text.page_title(v, "S", "sub"), v="") == "S - sub" and one(spark, text.page_title(v, "S", "sub"), v="t") == "t - S"


@pytest.mark.parametrize("values, wanted", [((None, "", "x"), "x"), (("a", "b", "c"), "a"), ((None, None, ""), "")])
def test_first_truthy_skips_empty_texts(spark, values, wanted):
    df = spark.createDataFrame([values], "a string, b string, c string")
    assert df.select(text.first_truthy(F.col("a"), F.col("b"), F.col("c"))).first()[0] == wanted
