import pytest
from pyspark.sql import functions as F

from folio.functions.markdown import admonitions, directives, excerpt, headings
from folio.sources.assets import read_assets
from folio.sources.markdown import entry, read_pages, read_posts, rejected_posts

FILES = {
    "First Post/First Post.md": '---\ntitle: First & Only\npublished: 2025-10-01\ntags: [One, "Two, Three", \'It\'\'s\']\ncategory: Poetry & Prose\nsubtitle: not kept\ndraft: false \n---\n# Top\n\nPara **bold** [link](x).\n',
    "guide/index.md": '---\ntitle: "Guide: \\"quoted\\""\npublished: 2024-04-01T10:30:00Z\nupdated: 2024-05-01\ntags:\n  - "a"\n  - b # note\ncategory:\nlang: zh_CN\ndraft: true\n---\n> quote\n\nfirst real\nparagraph\n\n```yaml\n---\ntitle: inner\n---\n# no heading\n```\n## Sub #\n## Sub\n:::note[Label here]\ninside\n:::\n:::tip\n:::\n::github{repo="own/er"}\ntext :icon[x]{a=1}\n',
    "plain.md": "no front matter",
    "ignored.mdx": "---\ntitle: x\npublished: 2025-01-01\n---\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("some posts")
    for name, text in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_front_matter(spark, folder):
    rows = {r["slug"]: r for r in read_posts(spark, folder, invalid="drop").collect()}
    assert set(rows) == {"first-post/first-post", "guide"}
    first, guide = rows["first-post/first-post"], rows["guide"]
    assert first["title"] == "First & Only" and first["tags"] == ["One", "Two, Three", "It's"] and first["category"] == "Poetry & Prose"
    assert str(first["published"]) == "2025-10-01 00:00:00" and first["updated"] is None and first["draft"] is False and first["description"] == ""
    assert guide["title"] == 'Guide: "quoted"' and guide["tags"] == ["a", "b"] and guide["category"] is None and guide["draft"] is True
    assert guide["id"] == "guide/index.md" and "title: inner" in guide["body"] and str(guide["published"]) == "2024-04-01 10:30:00"


def test_invalid_posts_are_reported_or_fail(spark, folder):
    assert [(r["id"], r["error"]) for r in rejected_posts(spark, folder).collect()] == [("plain.md", "title is required")]
    with pytest.raises(Exception, match="missing or invalid"):
        read_posts(spark, folder).collect()


def test_entry_needs_one_row(spark, folder):
    pages = read_pages(spark, folder)
    assert entry(pages, "plain").first()["body"] == "no front matter"
    with pytest.raises(Exception, match="0 entries"):
        entry(pages, "about").collect()


def test_blocks(spark, folder):
    posts = read_posts(spark, folder, invalid="drop")
    assert {r[0]: r[1] for r in posts.select("slug", excerpt(F.col("body"))).collect()} == {"first-post/first-post": "Para bold link.", "guide": "first real\nparagraph"}
    found = sorted(tuple(r) for r in headings(posts).collect())
    assert found == [("first-post/first-post", 1, 1, "top", "Top"), ("guide", 1, 2, "sub", "Sub"), ("guide", 2, 2, "sub-1", "Sub")]
    rows = {(r["kind"], r["name"]): r for r in directives(posts).where("doc = 'guide'").collect()}
    assert set(rows) == {("container", "note"), ("container", "tip"), ("leaf", "github"), ("text", "icon")}
    assert rows["leaf", "github"]["attributes"] == {"repo": "own/er"} and rows["text", "icon"]["label"] == "x"
    assert sorted((r["type"], r["title"], r["text"], r["valid"]) for r in admonitions(posts).collect()) == [("note", "Label here", "inside", True), ("tip", "TIP", "", False)]


@pytest.mark.parametrize("body, wanted", [(None, ""), ("", ""), ("# only", ""), ("# h\ntext", "text"), ("Title\n===\n\nbody", "body"), ("- a\n- b\n\n1. c\n\n![alt](i.png) and `code`", "alt and code"), ("```\nx\n```\n\r\n\r\nend", "end")])
def test_excerpt_cases(spark, body, wanted):
    assert spark.createDataFrame([(body,)], "body string").select(excerpt(F.col("body"))).first()[0] == wanted


def test_assets(spark, folder):
    assert sorted(r[0] for r in read_assets(spark, folder, "*.md").select("path").collect()) == ["First Post/First Post.md", "guide/index.md", "plain.md"]


@pytest.mark.parametrize("value, wanted", [
    ("|\n  a\n   b\n\n  c\n", "a\n b\n\nc\n"), ("|-\n  a\n\n", "a"), ("|+\n  a\n\n", "a\n\n\n"), (">\n  a\n  b\n\n\n  c\n", "a b\n\nc\n"), (">-\n\n  a\n    x\n    y\n  b\n", "\na\n  x\n  y\nb"),
    ("|2-\n    a\n  b\n", "  a\nb"), ("> # why\n  a\n  b\n", "a b\n"), ("|\n", ""), ("'it''s\n  two'", "it's two"), ("a\n  b", "a b"),
])
def test_scalars_over_lines(spark, value, wanted):
    from folio.sources.markdown import parsed

    files = spark.createDataFrame([("x.md", f"---\ntitle: T\ndescription: {value}\nlang: en\npublished: 2025-01-01\n---\nbody")], "name string, value string")
    found = parsed(files).first()
    assert (found["description"], found["lang"], found["title"], found["body"]) == (wanted, "en", "T", "body")


def test_front_matter_beyond_the_subset_is_rejected(spark, tmp_path):
    odd = ["&a x", "*a", "!!str x", "{a: b}", "[a, [b]]", "[{a: b}]", '"open', "\n  - - a", "\n  - {a: b}", '"a\n\n  b"']
    fine = ["x & y", "'&a'", "[a, 'b]']", "a *b*", "\n  - '[x]'"]
    for n, value in enumerate(odd + fine):
        (tmp_path / f"{n}.md").write_text(f"---\ntitle: T\npublished: 2025-01-01\ntags: {value}\nother: {{a: b}}\n---\n")
    assert {r["id"] for r in rejected_posts(spark, str(tmp_path)).collect()} == {f"{n}.md" for n in range(len(odd))}
    assert read_posts(spark, str(tmp_path), invalid="drop").count() == len(fine) and read_posts(spark, str(tmp_path), invalid="keep").count() == len(odd + fine)
    with pytest.raises(Exception, match="the form of tags is not read in"):
        read_posts(spark, str(tmp_path)).collect()
