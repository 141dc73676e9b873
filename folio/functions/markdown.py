"""Markdown by expressions: headings, directives, excerpts and plain text of a documented subset.

Known: ATX and setext headings, fenced code and math, paragraphs, quotes, lists, tables, raw HTML, `:::`
container, `::` leaf and `:` text directives, `> [!NOTE]` quotes. blocks.py says which lines are code and
which open or close a container; all that is read here is read from those that are neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.blocks import CONTAINER, LIST_MARK, blocks_if_any, blocks_of, code_of, inside, is_mark, let, lines_of, marks_of, unix_lines, unquoted, with_blocks

_HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\z"
_UNDERLINE = r"^ {0,3}(=+|-+)[ \t]*\z"
_RULE = r"^ {0,3}([-*_][ \t]*){3,}\z"
#: How blocks begin that are not paragraphs.
_NO_PARAGRAPH = r"^( {4}|\t| {0,3}(#{1,6}(\s|\z)|>|[-*+]\s|\d{1,9}[.)]\s|:::?|\||<|`{3}|~{3}|([-*_][ \t]*){3,}\z))"
_LEAF = r"^ {0,3}::([a-zA-Z][\w-]*)(\[[^\]]*\])?(\{[^}]*\})?[ \t]*\z"
_INLINE = r"(?<![:\w]):([a-zA-Z][\w-]*)(\[[^\]\n]*\])(\{[^}\n]*\})?"
#: Kinds of admonitions.
ADMONITIONS = ("note", "tip", "important", "caution", "warning")


#: What may open a block; a text without it has none but paragraphs, lists, headings and the like.
_OPENS = r"(?m)^[ \t>\d.)*+-]*(?:`{3}|~~~|\$\$|:::|>)"


def inline_text(text: Column) -> Column:
    """Without the marks of images, links, emphasis and code; line ends stay."""
    out = F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"`([^`\n]+)`", "$1")
    # a run of marks that no text follows opens nothing
    out = F.regexp_replace(out, r"(?<![*_~])(\*\*|__|~~)(?=[^\s*_~])(.+?)(?<=[^\s*_~])\1(?![*_~])", "$2")
    return F.regexp_replace(out, r"(?<![\w*])([*_])(?=[^\s*_])(.+?)(?<=[^\s*_])\1(?![\w*])", "$2")


def excerpt(body: Column) -> Column:
    """The plain text of the first top-level paragraph; '' without one. Headings, quotes, lists, code and containers before it are passed over."""
    within = lambda blocks, i: inside(blocks, i, "fence") | inside(blocks, i, "container")
    kept = let(lines_of(body), lambda x: let(blocks_of(x), lambda blocks: F.array_join(F.transform(x, lambda line, i: F.when(within(blocks, i), "").otherwise(line)), "\n")))
    text = F.when(F.coalesce(body.rlike(_OPENS), F.lit(False)), kept).otherwise(unix_lines(body))
    apart = F.regexp_replace(text, r"(?m)^( {0,3}#{1,6}(?:[ \t].*)?)$", "\n$1\n")
    blocks = F.split(apart, r"\n[ \t]*(?:\n[ \t]*)+")
    plain = F.filter(
        F.transform(blocks, lambda b: F.regexp_replace(b, r"^\n+|\n+\z", "")),
        lambda b: (F.trim(b) != "") & ~b.rlike(_NO_PARAGRAPH) & ~b.rlike(r"\n {0,3}(=+|-+)[ \t]*\z"),
    )
    return F.coalesce(_inline(F.trim(F.try_element_at(plain, F.lit(1))), math=True, rendered=False), F.lit(""))


def slugged(text: Column) -> Column:
    """An anchor's name: lower case, only letters, digits, hyphens and underscores, spaces as hyphens."""
    return F.replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}\p{Pc}\- ]", ""), F.lit(" "), F.lit("-"))


def unique_names(names: Column) -> Column:
    """Each name, or if an earlier one of the array is the same, the name with the least -1, -2, ... that none has."""

    def named(taken: Column, h: Column) -> Column:
        tried = lambda n: F.concat_ws("-", h["name"], n.cast("string"))
        # as many as have it before have taken numbers, and names that look like it with a number may have some
        numbers = F.sequence(F.greatest(F.lit(1), h["before"]), h["before"] + h["alike"] + 1)
        free = F.transform(F.filter(numbers, lambda n: ~F.array_contains(taken, tried(n))), tried)
        return F.array_append(taken, F.when(F.array_contains(taken, h["name"]), free[0]).otherwise(h["name"]))

    def counted(name: Column, at: Column) -> Column:
        before = F.size(F.filter(F.slice(names, F.lit(1), at), lambda x: x == name))
        alike = F.size(F.filter(names, lambda x: F.startswith(x, F.concat(name, F.lit("-"))) & F.substring(x, F.length(name) + 2, F.length(x)).rlike(r"^\d+\z")))
        return F.struct(name.alias("name"), before.alias("before"), alike.alias("alike"))

    return F.aggregate(F.transform(names, counted), F.array().cast("array<string>"), named)


def _paragraphs(lines: Column, blocks: Column) -> Column:
    """For each line 1 if it can be a paragraph's, 2 if in a quote, else 0."""

    def kind(line: Column, at: Column) -> Column:
        text = unquoted(line)
        other = (F.trim(text) == "") | text.rlike(_NO_PARAGRAPH) | text.rlike(_UNDERLINE) | inside(blocks, at, "fence") | is_mark(blocks, at)
        return F.when(other, 0).when(line == text, 1).otherwise(2)

    return F.transform(lines, kind)


def headings_of(lines: Column, blocks: Column) -> Column:
    """array<struct<line, depth, text>> of the headings outside code, in order; line: the first of it."""

    def atx(line: Column, at: Column) -> Column:
        text = unquoted(line)
        return F.struct(at.alias("line"), F.length(F.regexp_extract(text, _HEADING, 1)).alias("depth"), F.regexp_extract(text, _HEADING, 2).alias("raw"))

    def setext(kinds: Column) -> Column:
        def heading(line: Column, at: Column) -> Column:
            own = kinds[at - 1]
            back = F.array_position(F.transform(F.reverse(F.slice(kinds, F.lit(1), at)), lambda k: k != own), True).cast("int")  # lines of the paragraph and one
            start = F.when(back == 0, 0).otherwise(at - back + 1)
            text = F.array_join(F.transform(F.slice(lines, start + 1, at - start), lambda x: F.trim(unquoted(x))), "\n")
            return F.when((at > 0) & (own > 0) & ((own == 1) == (line == unquoted(line))) & unquoted(line).rlike(_UNDERLINE), F.struct(start.alias("line"), F.when(F.contains(line, F.lit("=")), 1).otherwise(2).alias("depth"), text.alias("raw")))

        return F.filter(F.transform(lines, heading), lambda h: h.isNotNull())

    first = F.filter(F.transform(lines, lambda x, i: F.when(unquoted(x).rlike(_HEADING), atx(x, i))), lambda h: h.isNotNull())
    first = F.filter(first, lambda h: ~inside(blocks, h["line"], "fence"))
    second = F.when(F.exists(lines, lambda x: unquoted(x).rlike(_UNDERLINE)), let(_paragraphs(lines, blocks), setext))
    both = F.concat(first, F.coalesce(second, F.slice(first, 1, 0)))
    return F.transform(F.array_sort(both), lambda h: F.struct(h["line"].alias("line"), h["depth"].alias("depth"), inline_text(h["raw"]).alias("text")))


def headings(df: DataFrame, doc: str = "slug", body: str = "body") -> DataFrame:
    """(doc, pos, depth, slug, text): a row for each heading outside code, pos from 1; see placed_headings()."""
    return placed_headings(df, doc, body).drop("line")


def placed_headings(df: DataFrame, doc: str = "slug", body: str = "body") -> DataFrame:
    """(doc, pos, depth, slug, text, line): a row for each heading outside code, pos from 1, line (its first) from 0.

    Setext headings are those of a paragraph with a line of = or - below. No two of a document have one
    slug: see unique_names(). Null and empty bodies have none.
    """
    found = with_blocks(df, doc, body).select("doc", headings_of(F.col("lines"), F.col("blocks")).alias("found"))  # a filter here would have all that is below computed for it once more
    found = found.withColumn("slugs", unique_names(F.transform("found", lambda h: slugged(h["text"]))))
    rows = found.select("doc", F.posexplode(F.arrays_zip("found", "slugs")).alias("at", "h"))
    return rows.select("doc", (F.col("at") + 1).alias("pos"), F.col("h.found.depth").alias("depth"), F.col("h.slugs").alias("slug"), F.col("h.found.text").alias("text"), F.col("h.found.line").alias("line"))


def attributes(braced: Column) -> Column:
    """map of {key="value" key2=value2}; the last of a repeated key counts."""
    pairs = F.regexp_extract_all(braced, F.lit(r"([\w-]+)=(\"[^\"]*\"|'[^']*'|[^\s}\"']+)"), F.lit(0))
    split = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(F.regexp_replace(p, r"^[^=]*=", ""), r"^[\"']|[\"']\z", "").alias("value")))
    keys = F.array_distinct(F.transform(split, lambda x: x["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(split, lambda x: x["key"] == k), -1)["value"]))


_CODE_SPAN = r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)"
#: Fixed value: how a quote that is an admonition begins.
_ALERT = r"^\[!([a-zA-Z]+)\][ \t]*\z"


def _content(lines: Column, block: Column) -> Column:
    """The lines within a block, of a quoted one without quote marks."""
    own = F.slice(lines, block["start"] + 2, block["end"] - block["start"] - 1)
    quoted = lines[block["start"]] != unquoted(lines[block["start"]])
    return F.array_join(F.when(quoted, F.transform(own, unquoted)).otherwise(own), "\n")


def directives(df: DataFrame, doc: str = "slug", body: str = "body") -> DataFrame:
    """(doc, kind, name, label, has_label, attributes, content, line, depth): a row for each directive outside code; kind is container, leaf or text.

    content: a container's lines, those of directives in it included; each of these has a row too. depth: how
    many blocks a container lies in (0 for other kinds).
    """
    texts = with_blocks(df, doc, body)
    lines, blocks = F.col("lines"), F.col("blocks")
    row = lambda kind, raw, pattern, content, line, depth: F.struct(
        F.lit(kind).alias("kind"), *[F.regexp_extract(raw, pattern, n).alias(c) for n, c in enumerate(("name", "label", "braced"), 2 if kind == "container" else 1)],
        content.alias("content"), line.cast("int").alias("line"), depth.cast("int").alias("depth"))
    nothing, zero = F.lit(""), F.lit(0)
    containers = F.transform(F.filter(blocks, lambda b: b["kind"] == "container"), lambda b: row("container", unquoted(lines[b["start"]]), CONTAINER, _content(lines, b), b["start"], b["depth"]))
    read = F.transform(lines, lambda x, i: F.when(~inside(blocks, i, "fence") & ~is_mark(blocks, i) & F.contains(x, F.lit(":")), unquoted(x)))
    leaves = F.filter(F.transform(read, lambda x, i: F.when(x.rlike(_LEAF), row("leaf", x, _LEAF, nothing, i, zero))), lambda r: r.isNotNull())
    inline = F.flatten(F.transform(read, lambda x, i: F.transform(F.regexp_extract_all(F.coalesce(F.regexp_replace(x, _CODE_SPAN, ""), F.lit("")), F.lit(_INLINE), F.lit(0)), lambda t: row("text", t, _INLINE, nothing, i, zero))))
    rows = texts.select("doc", F.explode(F.concat(containers, leaves, inline)).alias("d")).select("doc", "d.*")
    label = F.regexp_replace("label", r"^\[|\]\z", "")
    return rows.select("doc", "kind", "name", label.alias("label"), (label != "").alias("has_label"), attributes(F.col("braced")).alias("attributes"), "content", "line", "depth")


def alerts(df: DataFrame, doc: str = "slug", body: str = "body") -> DataFrame:
    """(doc, name, content, line) of the quotes that begin with `[!NOTE]` or another of ADMONITIONS in any case; content is what the quote holds below."""
    texts = with_blocks(df, doc, body)
    quotes = F.filter("blocks", lambda b: b["kind"] == "quote")
    rows = F.transform(quotes, lambda b: F.struct(F.lower(F.regexp_extract(F.trim(unquoted(F.col("lines")[b["start"]])), _ALERT, 1)).alias("name"), _content(F.col("lines"), b).alias("content"), b["start"].alias("line")))
    return texts.select("doc", F.explode(rows).alias("q")).select("doc", "q.*").where(F.col("name").isin(*ADMONITIONS))


def admonitions(df: DataFrame, doc: str = "slug", body: str = "body") -> DataFrame:
    """(doc, type, title, text, valid) of directives named as one of ADMONITIONS, at any depth, and of alerts(): the label or the type in capitals is the title.

    Without a label and content an admonition is invalid, as one that is no container.
    """
    found = directives(df, doc, body).where(F.col("name").isin(*ADMONITIONS)).select("doc", "name", "label", "has_label", "content")
    found = found.unionByName(alerts(df, doc, body).select("doc", "name", F.lit("").alias("label"), F.lit(False).alias("has_label"), "content"))
    title = F.when(F.col("has_label"), F.col("label")).otherwise(F.upper("name"))
    text = F.regexp_replace("content", r"^\s+|\s+\z", "")
    valid = F.col("has_label") | (text != "")
    return found.select("doc", F.col("name").alias("type"), title.alias("title"), text.alias("text"), valid.alias("valid"))


def _inline(text: Column, math: bool, rendered: bool) -> Column:
    """Inline text without marks. Code spans stay as they are while all else is read: each pattern passes over them. A pattern is only tried where its sign is."""
    span = r"((?<!`)(`+)(?!`).+?(?<!`)\2(?!`))|"

    def each(out: Column) -> Column:
        steps = [(r"$", r"(?<![\\$])\$\$?(?=[^\s$])([^$]*?[^\s$\\]|)\$\$?(?![\d$])", "$3" if math else ""), ("[", r"!\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])", "" if rendered else "$3"),
                 ("[", r"\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])", "$3"), ("<", r"<((?:https?|mailto|ftp):[^>\s]+)>", "$3")]
        steps += [("<", r"(?:<!--.*?-->|</?[a-zA-Z][^>]*>)", "")] if rendered else []
        steps += [
            ("[", r"(?<![:\w]):[a-zA-Z][\w-]*(?:\[([^\]]*)\])(?:\{[^}]*\})?", "$3"), ("*_~", r"(?<![*_~\\])(\*\*|__|~~)(?=[^\s*_~])(.+?)(?<=[^\s*_~])\3(?![*_~])", "$4"),
            ("*_", r"(?<![\w*\\])([*_])(?=[^\s*_])(.+?)(?<=[^\s*_])\3(?![\w*])", "$4"), ("\\", r"\\([!-/:-@\[-`{-~])", "$3"),
        ]
        return chained(out, steps)

    def chained(out: Column, steps: list[tuple[str, str, str]]) -> Column:
        if not steps:
            return F.when(F.contains(out, F.lit("`")), F.regexp_replace(out, _CODE_SPAN, "$2")).otherwise(out)
        (signs, pattern, to), *rest = steps

        def one(x: Column) -> Column:
            there = F.contains(x, F.lit(signs[0]))
            for sign in signs[1:]:
                there = there | F.contains(x, F.lit(sign))
            without = F.regexp_replace(x, pattern.replace(r"\3", r"\1"), to.replace("$3", "$1").replace("$4", "$2"))
            return F.when(there, F.when(F.contains(x, F.lit("`")), F.regexp_replace(x, span + pattern, f"$1{to}")).otherwise(without)).otherwise(x)

        return let(out, lambda x: chained(one(x), rest))

    # most text has none of the signs
    return let(text, lambda x: F.when(x.rlike(r"[\[<$*_~`\\]"), each(x)).otherwise(x))


_REFERENCE = r"^ {0,3}\[[^\]]+\]:\s*\S+"
_TABLE_RULE = r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*\z"


#: How lines begin that may be more than text: blank ones, code by its indent, and those with a first sign of any of the patterns above.
_SIGNED = r"^(?: {4}|\t|[ \t]*(?:[#>*+0-9:|<`~_=\[-]|\z))"


def plain_lines(lines: Column, blocks: Column, math: bool, rendered: bool) -> Column:
    """Each line's plain text; '' for lines that only bear marks.

    Code stays as it is, labels of directives stay, addresses of links go. math: whether formulas stay, inline
    and in `$$` blocks. rendered: as a page shows it, without raw HTML and texts of images.
    """

    def label(text: Column, pattern: str, n: int) -> Column:
        return F.regexp_replace(F.regexp_extract(text, pattern, n), r"^\[|\]\z", "")

    def signed(text: Column) -> Column:
        bare = text.rlike(_UNDERLINE) | text.rlike(_RULE) | text.rlike(_REFERENCE) | text.rlike(_TABLE_RULE) | F.trim(text).rlike(_ALERT)
        prose = F.trim(F.regexp_replace(F.when(text.rlike(_HEADING), F.regexp_extract(text, _HEADING, 2)).otherwise(text), rf"(?:{LIST_MARK})+(?:\[[ xX]\][ \t]+)?", ""), F.lit(" \t"))
        cells = let(prose, lambda x: F.when(F.startswith(x, F.lit("|")), F.trim(F.regexp_replace(x, r"[ \t]*(?<!\\)\|[ \t]*", " "))).otherwise(x))
        return F.when(bare, "").otherwise(cells)

    def read(codes: Column, marks: Column) -> Column:
        def plain(line: Column, at: Column) -> Column:
            def of(text: Column) -> Column:
                code = text if math else F.when(codes[at] == "$", "").otherwise(text)
                marked = F.when(text.rlike(CONTAINER), label(text, CONTAINER, 3)).otherwise("")
                leaf = F.contains(text, F.lit("::")) & text.rlike(_LEAF)
                prose = F.when(text.rlike(_SIGNED), signed(text)).otherwise(F.trim(text, F.lit(" \t")))
                return F.when(codes[at] != "", code).when(F.array_contains(marks, at), marked).when(leaf, label(text, _LEAF, 2)).otherwise(_inline(prose, math, rendered))

            return let(unquoted(line), of)

        return F.transform(lines, plain)

    return let(code_of(lines, blocks), lambda codes: let(marks_of(blocks), lambda marks: read(codes, marks)))


def plain_of(lines: Column, blocks: Column) -> Column:
    """A text as a page shows it, for a search: lines without marks, formulas, addresses and raw HTML, code as it is."""
    return F.array_join(F.filter(plain_lines(lines, blocks, False, True), lambda line: F.trim(line) != ""), "\n")


def flat_of(lines: Column, blocks: Column) -> Column:
    """All values of a text put together, as words are counted: formulas, code and texts of images too, no space between blocks, line ends within them."""

    def edges(line: Column) -> Column:
        def of(text: Column) -> Column:
            either = (F.trim(text) == "") | text.rlike(_UNDERLINE) | text.rlike(_REFERENCE)
            starts, ends = either | text.rlike(_NO_PARAGRAPH), either | text.rlike(_HEADING) | F.trim(text).rlike(_ALERT)
            none = F.struct(F.lit(False).alias("starts"), F.lit(False).alias("ends"))
            return F.when(text.rlike(_SIGNED), F.struct(starts.alias("starts"), ends.alias("ends"))).otherwise(none)

        return let(unquoted(line), of)

    def joined(edges: Column, codes: Column, marks: Column) -> Column:
        def piece(line: Column, at: Column) -> Column:
            edge = F.array_contains(marks, at) | F.array_contains(marks, at - 1) | edges[at]["starts"] | edges[at - 1]["ends"]
            goes_on = F.when(at == 0, False).when(codes[at] != "", codes[at - 1] != "").otherwise(~edge)
            return F.when(goes_on, F.concat(F.lit("\n"), line)).otherwise(line)

        return F.array_join(F.transform(plain_lines(lines, blocks, True, False), piece), "")

    return let(F.transform(lines, edges), lambda e: let(code_of(lines, blocks), lambda codes: let(marks_of(blocks), lambda marks: joined(e, codes, marks))))


def plain_text(body: Column) -> Column:
    """plain_of() a body."""
    return let(lines_of(body), lambda x: let(blocks_if_any(x), lambda blocks: plain_of(x, blocks)))


def flat_text(body: Column) -> Column:
    """flat_of() a body."""
    return let(lines_of(body), lambda x: let(blocks_if_any(x), lambda blocks: flat_of(x, blocks)))


def repository(repo: Column) -> Column:
    """struct(owner, name, valid) of `owner/name`; valid if there is a slash."""
    valid = F.coalesce(F.contains(repo, F.lit("/")), F.lit(False))
    part = lambda n: F.when(valid, F.try_element_at(F.split(repo, "/"), F.lit(n)))
    return F.struct(part(1).alias("owner"), part(2).alias("name"), valid.alias("valid"))
