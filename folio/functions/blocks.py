"""The lines of a Markdown text and the blocks that hold others: fences, containers and quotes.

A text is an array of lines. Those of them that can open or close something are few; an ordered fold
over these alone keeps a stack of what is open and writes down each opening and closing. Blocks are
ranges of lines from that, and the line table asks them what each line is.

What is open closes as follows. A container (`:::name`) ends with the first line of bare colons, as many
as its own at least; the outermost that the line fits ends, with all that is open in it, since it looks for its
end before its content is read. A fence of backticks, tildes or dollars ends with a line of its own mark, as
long at least. A quote ends with the first line that is not quoted; a line that goes on with a quoted
paragraph without its mark is not counted to it. What is still open at the end of the text ends there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quote marks before a line, and list marks.
QUOTED = r"^ {0,3}>"
QUOTE_MARKS = r"^(?: {0,3}> ?)+"
LIST_MARK = r"^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+"
_FENCE = r"^([ \t]*)((?:(?:[-*+]|\d{1,9}[.)])[ \t]+)*)(`{3,}(?=[^`]*\z)|~{3,}|\${2,}(?=[^$]*\z))(.*)\z"
_COLONS = r"^[ \t]{0,3}(:{3,})(?:([a-zA-Z][\w-]*)(\[[^\]]*\])?(\{[^}]*\})?)?[ \t]*\z"
#: The name, label and attributes of a container's first line.
CONTAINER = _COLONS

#: start and end: lines, the end exclusive; own: whether the line at the end is the block's own last mark; depth: how many others it lies in.
BLOCKS = "array<struct<kind:string,mark:string,start:int,end:int,own:boolean,depth:int>>"
_OPEN = "struct<kind:string,mark:string,n:int>"
_EVENT = "struct<at:int,size:int,kind:string,mark:string,own:boolean>"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once. By element_at: a [0] would ask the type of all that of() made, which walks through it, for each value."""
    return F.element_at(F.transform(F.array(value), of), 1)


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")


def lines_of(body: Column) -> Column:
    return F.split(unix_lines(body), "\n")


def unquoted(line: Column) -> Column:
    return F.when(F.contains(line, F.lit(">")), F.regexp_replace(line, QUOTE_MARKS, "")).otherwise(line)


#: Lines that open or end something but quotes; fences so far in that they may be code of a list.
_CANDIDATE = r"^[ \t>]*(?:(?:[-*+]|\d{1,9}[.)])[ \t]+)*(?:`{3}|~~~|\$\$|:::)"
_FAR_FENCE = r"^[> ]*(?: {4}|\t)[ \t]*(?:`{3}|~~~|\$\$)"


def _marks(lines: Column) -> Column:
    """The lines that can open or close a block, with what the fold asks of them, in order. Those that begin or end a list are asked for only where a fence stands so far in that it matters."""
    before = lambda at: F.when(at > 0, lines[at - 1]).otherwise("")

    def mark(found: Column) -> Column:
        line, at, quoted = found["line"], found["at"], found["quoted"]

        def read(text: Column) -> Column:
            def of(x: Column) -> Column:
                fence, colons = x["fence"], x["colons"]
                kind = F.when(fence != "", "fence").when((colons != "") & (F.regexp_extract(text, _COLONS, 2) != ""), "container").when(colons != "", "colons").when(x["listed"], "list").when(text.rlike(r"^[^\s>]") & (F.trim(before(at)) == ""), "plain")
                is_fence = fence != ""
                return F.struct(
                    at.alias("at"), quoted.alias("quoted"), kind.alias("kind"), F.substring(fence, 1, 1).alias("mark"), F.length(F.when(is_fence, fence).otherwise(colons)).alias("n"),
                    (is_fence & (F.trim(F.regexp_extract(text, _FENCE, 4)) == "") & (F.regexp_extract(text, _FENCE, 2) == "")).alias("bare"),
                    (x["listed"] | (is_fence & (F.length(F.replace(F.regexp_extract(text, _FENCE, 1), F.lit("\t"), F.lit("    "))) < 4))).alias("near"),
                )

            return let(F.struct(F.regexp_extract(text, _FENCE, 3).alias("fence"), F.regexp_extract(text, _COLONS, 1).alias("colons"), text.rlike(LIST_MARK).alias("listed")), of)

        return let(unquoted(line), read)

    def asked(lists: Column) -> Column:
        def first(line: Column, at: Column) -> Column:
            quoted = line.rlike(QUOTED)
            turn = quoted != before(at).rlike(QUOTED)
            in_lists = lists & ((F.trim(before(at)) == "") | unquoted(line).rlike(LIST_MARK))
            return F.when(line.rlike(_CANDIDATE) | turn | in_lists, F.struct(at.alias("at"), line.alias("line"), quoted.alias("quoted")))

        return F.transform(F.filter(F.transform(lines, first), lambda f: f.isNotNull()), mark)

    return let(F.exists(lines, lambda x: x.rlike(_FAR_FENCE)), asked)


def _step(s: Column, m: Column) -> Column:
    """The state after a line. What several parts need is bound once: sizes after the quote and after what the line ends, and whether a fence is open."""
    is_kind = lambda k: m["kind"].eqNullSafe(k)

    def with_quote(quote_at: Column) -> Column:
        size = F.when((quote_at > 0) & ~m["quoted"], quote_at - 1).otherwise(F.size(s["stack"]))

        def after_quote(rest: Column) -> Column:
            inside, size = F.when(m["quoted"], quote_at).otherwise(0), F.size(rest)
            closing = F.array_position(F.transform(rest, lambda e, i: (e["kind"] == "container") & (e["n"] <= m["n"]) & (i >= inside)), True).cast("int")

            def with_top(top: Column) -> Column:
                in_fence = top["kind"].eqNullSafe("fence")
                ends_fence = in_fence & is_kind("fence") & (top["mark"] == m["mark"]) & (top["n"] <= m["n"]) & m["bare"]
                left = F.when(is_kind("colons"), let(closing, lambda c: F.when(c > 0, c - 1).otherwise(size))).when(ends_fence, size - 1).otherwise(size)
                return let(F.struct(left.alias("left"), size.alias("size"), in_fence.alias("in_fence")), pushed)

            def pushed(x: Column) -> Column:
                left, free = x["left"], ~x["in_fence"] & (x["left"] == x["size"])
                quote = F.when(m["quoted"] & (quote_at == 0), F.struct(F.lit("quote").alias("kind"), F.lit("").alias("mark"), F.lit(0).alias("n")))
                block = F.when(is_kind("container") | (is_kind("fence") & (m["near"] | s["listed"])), F.struct(m["kind"].alias("kind"), m["mark"].alias("mark"), m["n"].alias("n")))
                none = F.array().cast(f"array<{_OPEN}>")
                more = F.when(free, F.filter(F.array(quote.cast(_OPEN), block.cast(_OPEN)), lambda e: e.isNotNull())).otherwise(none)
                listed = F.when(is_kind("list"), True).when(is_kind("plain"), False).otherwise(s["listed"])

                def state(more: Column) -> Column:
                    gone = F.when(left < F.size(s["stack"]), F.array(F.struct(m["at"].alias("at"), left.alias("size"), F.lit(None).cast("string").alias("kind"), F.lit("").alias("mark"), (left < x["size"]).alias("own"))).cast(f"array<{_EVENT}>")).otherwise(F.array().cast(f"array<{_EVENT}>"))
                    opened = F.transform(more, lambda e, i: F.struct(m["at"].alias("at"), (left + i).alias("size"), e["kind"].alias("kind"), e["mark"].alias("mark"), F.lit(False).alias("own")))
                    same = (left == F.size(s["stack"])) & (F.size(more) == 0)
                    events = F.when(same, s["events"]).otherwise(F.concat(s["events"], gone, opened.cast(f"array<{_EVENT}>")))
                    return F.struct(F.when(same, s["stack"]).otherwise(F.concat(F.slice(rest, F.lit(1), left), more)).alias("stack"), listed.alias("listed"), events.alias("events"))

                return let(more, state)

            return let(F.try_element_at(rest, F.greatest(size, F.lit(1))), with_top)

        return let(F.slice(s["stack"], F.lit(1), size), after_quote)

    return let(F.array_position(F.transform(s["stack"], lambda e: e["kind"]), "quote").cast("int"), with_quote)


def blocks_of(lines: Column) -> Column:
    """BLOCKS of an array of lines, in the order in which they open."""
    none = F.struct(F.array().cast(f"array<{_OPEN}>").alias("stack"), F.lit(False).alias("listed"), F.array().cast(f"array<{_EVENT}>").alias("events"))
    events = F.aggregate(_marks(lines), none, _step, lambda s: s["events"])

    def ranges(events: Column) -> Column:
        def block(e: Column, at: Column) -> Column:
            later = F.filter(events, lambda x, i: (i > at) & x["kind"].isNull() & (x["size"] <= e["size"]))
            end = F.try_element_at(later, F.lit(1))
            own = end["own"] & (end["size"] == e["size"])
            return F.struct(e["kind"].alias("kind"), e["mark"].alias("mark"), e["at"].alias("start"), F.coalesce(end["at"], F.size(lines)).alias("end"), F.coalesce(own, F.lit(False)).alias("own"), e["size"].alias("depth"))

        return F.filter(F.transform(events, block), lambda b: b["kind"].isNotNull()).cast(BLOCKS)

    return let(events, ranges)


def blocks_if_any(lines: Column) -> Column:
    """blocks_of(); most texts have no line that opens anything."""
    return F.when(F.exists(lines, lambda x: x.rlike(rf"{QUOTED}|^[ \t>\d.)*+-]*(?:`{{3}}|~~~|\$\$|:::)")), blocks_of(lines)).otherwise(F.array().cast(BLOCKS))


def with_blocks(df: DataFrame, doc: str, body: str) -> DataFrame:
    """(doc, lines, blocks) of df's texts; null texts have one empty line."""
    lines = df.select(F.col(doc).alias("doc"), lines_of(F.col(body)).alias("lines"))
    return lines.withColumn("blocks", blocks_if_any(F.col("lines")))


def inside(blocks: Column, at: Column, kind: str) -> Column:
    """Whether a line is within a block of that kind, its own marks included."""
    return F.exists(blocks, lambda b: (b["kind"] == kind) & (b["start"] <= at) & ((at < b["end"]) | (b["own"] & (at == b["end"]))))


def is_mark(blocks: Column, at: Column) -> Column:
    """Whether a line is the first or last of a fence or container."""
    return F.exists(blocks, lambda b: (b["kind"] != "quote") & ((b["start"] == at) | (b["own"] & (at == b["end"]))))


def code_of(lines: Column, blocks: Column) -> Column:
    """For each line the mark of the fence that it is within, '' outside. Fences do not lie in each other, so that the lines between and within them follow in order."""

    def ranges(fences: Column) -> Column:
        def until(b: Column, i: Column) -> Column:
            before = F.when(i > 0, fences[i - 1]["end"]).otherwise(0)
            return F.concat(F.array_repeat(F.lit(""), b["start"] + 1 - before), F.array_repeat(b["mark"], b["end"] - b["start"] - 1))

        after = F.when(F.size(fences) > 0, F.size(lines) - fences[F.size(fences) - 1]["end"]).otherwise(F.size(lines))
        return F.concat(F.flatten(F.transform(fences, until)), F.array_repeat(F.lit(""), after))

    return let(F.filter(blocks, lambda b: b["kind"] == "fence"), ranges)


def marks_of(blocks: Column) -> Column:
    """The lines that is_mark() is true of."""
    return F.flatten(F.transform(F.filter(blocks, lambda b: b["kind"] != "quote"), lambda b: F.when(b["own"], F.array(b["start"], b["end"])).otherwise(F.array(b["start"]))))


def line_table(df: DataFrame, doc: str = "slug", body: str = "body") -> DataFrame:
    """(doc, line, text, code, mark, depth): a row for each line, from 0; text is without quote marks. code: within a fence; mark: opens or ends a fence or container; depth: blocks around it."""
    found = with_blocks(df, doc, body).select("doc", "blocks", F.posexplode("lines").alias("line", "text"))
    around = F.size(F.filter("blocks", lambda b: (b["start"] < F.col("line")) & (F.col("line") < b["end"])))
    return found.select("doc", "line", unquoted(F.col("text")).alias("text"), inside(F.col("blocks"), F.col("line"), "fence").alias("code"), is_mark(F.col("blocks"), F.col("line")).alias("mark"), around.alias("depth"))
