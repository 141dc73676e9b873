"""URLs of posts, tags, categories and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import js_trim

#: What form encoding has and URI components have: a space, and six marks that stay as they are.
_UNFORM = {r"\+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def encode_uri_component(value: Column) -> Column:
    out = F.url_encode(value)
    for form, plain in _UNFORM.items():
        out = F.regexp_replace(out, form, plain)
    return out


def decode_uri_component(value: Column) -> Column:
    """Null for malformed input; a plus sign stays."""
    return F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))


def url(path: Column, base: str = "/") -> Column:
    """The path below the site's base, runs of slashes as one."""
    return F.regexp_replace(F.concat(F.lit(f"/{base}/"), path), "/+", "/")


def post_url(slug: Column, base: str = "/") -> Column:
    return url(F.concat(F.lit("/posts/"), slug, F.lit("/")), base)


def tag_url(tag: Column, base: str = "/") -> Column:
    """Null and '' lead to the whole archive."""
    found = F.concat(F.lit("/archive/?tag="), encode_uri_component(js_trim(tag)))
    return url(F.when(F.coalesce(tag, F.lit("")) == "", "/archive/").otherwise(found), base)


def category_url(category: Column, uncategorized: str = "Uncategorized", base: str = "/") -> Column:
    """Null, blank and the word for "uncategorized" in any case lead to the posts without a category."""
    name = js_trim(F.coalesce(category, F.lit("")))
    none = (name == "") | (F.lower(name) == uncategorized.lower())
    return url(F.when(none, "/archive/?uncategorized=true").otherwise(F.concat(F.lit("/archive/?category="), encode_uri_component(name))), base)


def page_url(page: Column, base: str = "/") -> Column:
    """The first page is the base itself."""
    return url(F.when(page == 1, "/").otherwise(F.concat(F.lit("/"), page.cast("string"), F.lit("/"))), base)


def directory(path: Column) -> Column:
    """Up to the last slash, with it; `/` without one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "(?s)^(.*/)", 1)).otherwise("/")


def paths_equal(a: Column, b: Column) -> Column:
    """Without regard to case and to one slash at either end."""
    plain = lambda p: F.lower(F.regexp_replace(p, r"^/|/\z", ""))
    return plain(a) == plain(b)


def normalized_path(path: Column) -> Column:
    """`.`, `..` and repeated slashes resolved, as for files; leading `..` of a relative path stay."""
    rooted = F.startswith(path, F.lit("/"))
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        back = F.when(up, F.slice(done, 1, F.size(done) - 1)).when(rooted, done).otherwise(F.array_append(done, part))
        return F.when(part.isin("", "."), done).when(part == "..", back).otherwise(F.array_append(done, part))

    # try_element_at would give null for an empty array; the guard above never reads one
    parts = F.aggregate(F.split(path, "/"), none, lambda d, p: step(d, p))
    joined = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def image_kind(src: Column) -> Column:
    """local, public or remote, by the beginning."""
    return F.when(F.startswith(src, F.lit("/")), "public").when(src.rlike("^(http|data:)"), "remote").otherwise("local")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def query_values(query: Column, key: str) -> Column:
    """All values of a key in a query string, in order, decoded (a plus sign is a space)."""
    pairs = F.split(F.regexp_replace(F.coalesce(query, F.lit("")), r"^\?", ""), "&")
    own = F.filter(pairs, lambda p: F.try_url_decode(F.substring_index(p, "=", 1)) == key)
    return F.transform(own, lambda p: F.when(F.contains(p, F.lit("=")), F.try_url_decode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise(""))
