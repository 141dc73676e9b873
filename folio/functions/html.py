"""HTML as a stream of tokens: text, title, exclusion by open elements, and an allow-list of tags.

A page is an array of tokens: comments, scripts and styles with what is in them, tags, and runs of text.
What an element excludes is found by a fold over the tags of its own name alone, which counts how many
of them are open, so that elements of that name within it are passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.blocks import let

_TOKEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</\1\s*>|\z)|<[!?/a-z](?:\"[^\"]*\"|'[^']*'|[^'\">])*+>|[^<]++|<"
_NAME = r"^</?([a-zA-Z][\w:-]*)"
_ATTRIBUTE = r"(?s)\s([a-zA-Z][\w:-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"
_RANGES = "array<struct<first:int,last:int>>"

# Elements without an end, those whose text is never shown, entities with names, what a feed
# may have (tags and, for some, attributes), and kinds of addresses.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
HIDDEN = "textarea option noscript template".split()
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "euro": "€"}
ALLOWED = (
    "address article aside footer header h1 h2 h3 h4 h5 h6 hgroup main nav section blockquote dd div dl dt figcaption figure hr li menu ol p pre ul "
    "a abbr b bdi bdo br cite code data dfn em i kbd mark q rb rp rt rtc ruby s samp small span strong sub sup time u var wbr "
    "caption col colgroup table tbody td tfoot th thead tr img"
).split()
ALLOWED_ATTRIBUTES = {"a": ("href", "name", "target"), "img": ("src", "srcset", "alt", "title", "width", "height", "loading")}
SCHEMES = "http https ftp mailto tel".split()
#: What makes an entity of an `&` before it.
ENTITY = r"(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);"

#: What a search leaves out: what is marked so, formulas, and the search's own panel.
IGNORED = r"(?is)^<(?:\w[^>]*\sdata-(?:\w+-)?ignore(?=[\s=/>])|span\b[^>]*\bclass\s*=\s*[\"']?[^\"'>]*\bkatex(?:-display)?\b|\w[^>]*\s(?:class|id)\s*=\s*(?:[\"'][^\"'>]*)?(?<![\w-])search-panel(?![\w-]))"


def tokens(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_TOKEN), F.lit(0))


def _name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, _NAME, 1))


def ranges(found: Column, starts: Callable[[Column], Column]) -> Column:
    """array<struct<first, last>> of the tokens of each element that starts with a tag that `starts` picks, the outermost ones; one that never ends lasts to the end."""
    pick = lambda t: t.rlike(r"^<[a-zA-Z]") & starts(t)
    names = F.array_distinct(F.transform(F.filter(found, pick), _name))

    def folded(names: Column) -> Column:
        tags = F.transform(found, lambda t, i: F.struct(i.alias("at"), _name(t).alias("name"), F.startswith(t, F.lit("</")).alias("closing"), (_name(t).isin(*VOID) | t.rlike(r"/>\z")).alias("void"), pick(t).alias("picked")))
        relevant = F.filter(tags, lambda t: F.array_contains(names, t["name"]))
        state = lambda name, depth, first, out: F.struct(name.alias("name"), depth.cast("int").alias("depth"), first.cast("int").alias("first"), out.cast(_RANGES).alias("out"))

        def step(s: Column, t: Column) -> Column:
            span = F.array(F.struct(F.when(s["depth"] > 0, s["first"]).otherwise(t["at"]).alias("first"), t["at"].alias("last")))
            opens, own = t["picked"] & ~t["closing"], t["name"] == s["name"]
            depth = F.when(s["depth"] > 0, F.when(own & t["closing"], s["depth"] - 1).when(own & ~t["void"], s["depth"] + 1).otherwise(s["depth"])).when(opens & ~t["void"], 1).otherwise(0)
            ends = (s["depth"] > 0) & (depth == 0) | (s["depth"] == 0) & opens & t["void"]
            begins = (s["depth"] == 0) & (depth == 1)
            return state(F.when(begins, t["name"]).otherwise(s["name"]), depth, F.when(begins, t["at"]).otherwise(s["first"]), F.when(ends, F.concat(s["out"], span.cast(_RANGES))).otherwise(s["out"]))

        last = lambda s: F.when(s["depth"] > 0, F.concat(s["out"], F.array(F.struct(s["first"].alias("first"), F.size(found).alias("last"))).cast(_RANGES))).otherwise(s["out"])
        return F.aggregate(relevant, state(F.lit(""), F.lit(0), F.lit(0), F.array()), step, last)

    return F.when(F.exists(found, pick), let(names, folded)).otherwise(F.array().cast(_RANGES))


def decoded(text: Column) -> Column:
    """Text with its entities as characters: numeric ones and ENTITIES; others stay."""
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0)))

    def character(code: Column) -> Column:
        number = F.when(code.rlike("^&#[xX]"), F.conv(F.regexp_extract(code, "[xX]([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(code, "([0-9]+)", 1)).cast("long")
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(63)), 8, "0")), "UTF-32")).otherwise("�")

    out = F.when(F.size(codes) > 0, F.aggregate(codes, text, lambda s, c: F.replace(s, c, character(c)))).otherwise(text)
    for name, sign in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return F.when(F.contains(text, F.lit("&")), F.replace(out, F.lit("&amp;"), F.lit("&"))).otherwise(text)


def _is_text(token: Column) -> Column:
    return ~F.startswith(token, F.lit("<")) | (token == "<")


def _outside(spans: Column, at: Column) -> Column:
    return ~F.exists(spans, lambda r: (r["first"] <= at) & (at <= r["last"]))


def html_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments, what a search ignores, and tags; entities decoded, white space as one space."""

    def shown(found: Column) -> Column:
        return let(ranges(found, lambda t: t.rlike(IGNORED)), lambda spans: F.array_join(F.filter(F.transform(found, lambda t, i: F.when(~_is_text(t), " ").when(_outside(spans, i), t)), lambda t: t.isNotNull()), ""))

    return F.trim(F.regexp_replace(decoded(let(tokens(html), shown)), r"[\s ]+", " "))


def html_title(html: Column) -> Column:
    title = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title\b[^>]*>(.*?)</title", 1)
    return F.trim(decoded(title))


def sanitized(html: Column, allowed: list[str] | None = None, whole: str = ENTITY) -> Column:
    """HTML with the allowed tags and attributes only, addresses of known schemes or none.

    Other tags go and their text stays, but not what scripts, styles, comments and HIDDEN elements hold. Tags
    are not balanced. Signs that could begin a tag are written as entities; entities stay. Null is ''.
    whole: a pattern, or look-ahead, of what stands after an `&` that stays.
    """
    names = ALLOWED if allowed is None else allowed

    def tag(token: Column) -> Column:
        name = _name(token)
        kept = F.array().cast("array<string>")
        for of, known in ALLOWED_ATTRIBUTES.items():
            kept = F.when(name == of, F.array(*map(F.lit, known))).otherwise(kept)

        def attribute(raw: Column) -> Column:
            key = F.lower(F.regexp_extract(raw, _ATTRIBUTE, 1))
            value = F.regexp_replace(F.regexp_extract(raw, _ATTRIBUTE, 2), "^[\"']|[\"']\\z", "")
            plain = F.lower(F.regexp_replace(decoded(value), "[\\x00-\\x20]+", ""))
            safe = ~key.isin("href", "src", "srcset") | ~plain.rlike("^[^/?#]*:") | plain.rlike(f"^(?:{'|'.join(SCHEMES)}):")
            return F.when(F.array_contains(kept, key) & safe, F.concat(F.lit(" "), key, F.lit('="'), F.replace(value, F.lit('"'), F.lit("&quot;")), F.lit('"')))

        attributes = F.filter(F.transform(F.regexp_extract_all(token, F.lit(_ATTRIBUTE), F.lit(0)), attribute), lambda a: a.isNotNull())
        end = F.when(name.isin(*VOID), F.lit(" />")).otherwise(">")
        opened = F.concat(F.lit("<"), name, F.array_join(attributes, ""), end)
        closed = F.when(name.isin(*VOID), "").otherwise(F.concat(F.lit("</"), name, F.lit(">")))
        return F.when(~name.isin(*names), "").when(F.startswith(token, F.lit("</")), closed).otherwise(opened)

    def text(token: Column) -> Column:
        return F.replace(F.replace(F.regexp_replace(token, f"&(?!{whole})", "&amp;"), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def written(found: Column) -> Column:
        kept = lambda spans: F.transform(found, lambda t, i: F.when(~_outside(spans, i), "").when(_is_text(t), text(t)).when(t.rlike(r"(?i)^<(?:[!?]|(?:script|style)\b)"), "").otherwise(tag(t)))
        return let(ranges(found, lambda t: _name(t).isin(*HIDDEN)), lambda spans: F.array_join(kept(spans), ""))

    return let(tokens(html), written)
