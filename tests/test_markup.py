"""Lines, blocks, headings, plain text and HTML against slow readers and hand-made cases."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from folio import site_queries
from folio.functions import blocks, html, markdown


def texts(spark, *bodies):
    return spark.createDataFrame([(n, b) for n, b in enumerate(bodies)], "slug int, body string")


def slow_lines(body):
    """(code, mark) of each line, by reading one after another."""
    stack, out, listed, before = [], [], False, ""
    for line in body.split("\n"):
        quoted, text = bool(re.match(" {0,3}>", line)), re.sub(r"^(?: {0,3}> ?)+", "", line)
        kinds = [b["kind"] for b in stack]
        if "quote" in kinds and not quoted:
            del stack[kinds.index("quote") :]
        fence = re.match(r"^([ \t]*)((?:(?:[-*+]|\d{1,9}[.)])[ \t]+)*)(`{3,}(?=[^`]*\Z)|~{3,}|\${2,}(?=[^$]*\Z))(.*)\Z", text)
        colons = re.match(r"^[ \t]{0,3}(:{3,})(?:([a-zA-Z][\w-]*)(\[[^\]]*\])?(\{[^}]*\})?)?[ \t]*\Z", text)
        item = bool(re.match(r"^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+", text))
        in_fence = bool(stack) and stack[-1]["kind"] == "fence"
        closing = None
        if not fence and colons and not colons[2]:
            from_ = next((n for n, b in enumerate(stack) if b["kind"] == "quote"), -1) if quoted else -1
            closing = next((n for n, b in enumerate(stack) if n > from_ and b["kind"] == "container" and b["n"] <= len(colons[1])), None)
        if closing is not None:
            code, mark = in_fence and closing == len(stack) - 1, True
            del stack[closing:]
            code = False
        elif in_fence and fence and not fence[2] and not fence[4].strip() and fence[3][0] == stack[-1]["mark"] and len(fence[3]) >= stack[-1]["n"]:
            stack.pop()
            code = mark = True
        elif in_fence:
            code, mark = True, False
        else:
            code = mark = False
            if quoted and not any(b["kind"] == "quote" for b in stack):
                stack.append({"kind": "quote"})
            if fence and (item or len(fence[1].replace("\t", "    ")) < 4 or listed):
                stack.append({"kind": "fence", "mark": fence[3][0], "n": len(fence[3])})
                code = mark = True
            elif not fence and colons and colons[2]:
                stack.append({"kind": "container", "n": len(colons[1])})
                mark = True
        if not fence and not colons:
            listed = True if item else False if re.match(r"^[^\s>]", text) and not before.strip() else listed
        out.append((code, mark))
        before = line
    return out


POOL = ["```", "~~~", "````", "   ```py", ":::", "::::", ":::note", "::::tip[x]{a=1}", "> q", "> ```", "> :::note", "> :::", "text", "", "", "# a", "# a", "# a 1", "# b-1", "a", "===", "---", "- item", "- ```", "    ```", "$$", ":::::", "> # a"]


def random_texts(n, seed):
    r = random.Random(seed)
    return ["\n".join(r.choice(POOL) for _ in range(r.randrange(1, 26))) for _ in range(n)]


def test_lines_equal_a_slow_reader(spark):
    bodies = random_texts(400, 1)
    found = {}
    for r in blocks.line_table(texts(spark, *bodies)).collect():
        found[r["doc"], r["line"]] = (r["code"], r["mark"])
    for n, body in enumerate(bodies):
        wanted = slow_lines(body)
        assert [found[n, i] for i in range(len(wanted))] == wanted, body


def slow_headings(body):
    lines, state, out = body.split("\n"), slow_lines(body), []
    strip = lambda x: re.sub(r"^(?: {0,3}> ?)+", "", x)
    other = re.compile(r"^( {4}|\t| {0,3}(#{1,6}(\s|\Z)|>|[-*+]\s|\d{1,9}[.)]\s|:::?|\||<|`{3}|~{3}|([-*_][ \t]*){3,}\Z))")
    kind = [0 if not strip(x).strip() or other.match(strip(x)) or re.match(r"^ {0,3}(=+|-+)[ \t]*\Z", strip(x)) or any(s) else 1 + (x != strip(x)) for x, s in zip(lines, state, strict=True)]
    for n, line in enumerate(lines):
        text = strip(line)
        atx = re.match(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\Z", text)
        under = re.match(r"^ {0,3}(=+|-+)[ \t]*\Z", text)
        if atx and not state[n][0]:
            out.append((len(atx[1]), atx[2] or ""))
        elif under and n and kind[n - 1] == 1 + (line != text):
            start = n - 1
            while start and kind[start - 1] == kind[n - 1]:
                start -= 1
            out.append((1 if "=" in line else 2, "\n".join(strip(x).strip() for x in lines[start:n])))
    taken, rows = set(), []
    for pos, (depth, text) in enumerate(out, 1):
        name = re.sub(r"[^\w\- ]", "", text.lower()).replace(" ", "-")
        slug, k = name, 0
        while slug in taken:
            k += 1
            slug = f"{name}-{k}"
        taken.add(slug)
        rows.append((pos, depth, slug, text))
    return rows


def test_headings_equal_a_slow_reader_and_have_names_of_their_own(spark):
    bodies = random_texts(400, 2) + ["# a\n# a\n# a 1\n# a 1\n# a-1-1\n# a 2\n# a", "\n".join(["# Part"] * 60 + ["# part 7", "# Part"]), None, ""]
    found = {}
    for r in markdown.headings(texts(spark, *bodies)).orderBy("doc", "pos").collect():
        found.setdefault(r["doc"], []).append((r["pos"], r["depth"], r["slug"], r["text"]))
    for n, body in enumerate(bodies):
        assert found.get(n, []) == slow_headings(body or ""), body
        assert len({h[2] for h in found.get(n, [])}) == len(found.get(n, []))


def test_nested_containers_and_quotes_as_admonitions(spark):
    bodies = [
        "::::note\nouter\n:::tip[In *x*]{a=1 b='2'}\ninner\n:::\nafter\n::::",
        ":::note\n:::tip\nx\n:::\nrest",  # equal marks: the outer one ends
        ":::::caution\n::::note\n:::tip\ndeep\n:::\n::::\n:::::",
        ":::warning\nnever closed\n\nto the end",
        "```\n:::note\nno\n:::\n```\n   ~~~\n:::tip\n   ~~~\n`:::note`",
        "> [!NOTE]\n> hello\n> there\nnot it\n\n>[!Tip]\n\n> [!OTHER]\n> x\n\n> plain [!NOTE]",
        ":::note\n> [!IMPORTANT]\n> quoted\n:::", "::warning[L]{k=v}\n:note[t]", None, "",
    ]
    found = sorted((r["doc"], r["type"], r["title"], r["text"], r["valid"]) for r in markdown.admonitions(texts(spark, *bodies)).collect())
    assert found == sorted([
        (0, "note", "NOTE", "outer\n:::tip[In *x*]{a=1 b='2'}\ninner\n:::\nafter", True), (0, "tip", "In *x*", "inner", True),
        (1, "note", "NOTE", ":::tip\nx", True), (1, "tip", "TIP", "x", True),
        (2, "caution", "CAUTION", "::::note\n:::tip\ndeep\n:::\n::::", True), (2, "note", "NOTE", ":::tip\ndeep\n:::", True), (2, "tip", "TIP", "deep", True),
        (3, "warning", "WARNING", "never closed\n\nto the end", True),
        (5, "note", "NOTE", "hello\nthere", True), (5, "tip", "TIP", "", False),
        (6, "note", "NOTE", "> [!IMPORTANT]\n> quoted", True), (6, "important", "IMPORTANT", "quoted", True),
        (7, "warning", "L", "", True), (7, "note", "t", "", True),
    ])
    rows = {(r["doc"], r["name"]): r for r in markdown.directives(texts(spark, *bodies)).collect()}
    assert rows[0, "tip"]["attributes"] == {"a": "1", "b": "2"} and rows[0, "tip"]["depth"] == 1 and rows[2, "tip"]["depth"] == 2 and rows[7, "warning"]["kind"] == "leaf"


def test_plain_and_flat_text(spark):
    body = (
        "# Head *one*\nSay $x_1 + y$ and `$code$ *s*` in [link](http://addr.example/path) **bold** <b>raw</b> \\*star\\*, it costs $5 and $6.\n\n$$\nformula\n$$\n\n- one\n- [x] two\n\n"
        "| a | b |\n|---|---|\n| c | d |\n\n![alt words](x.png)\n\n```py\ncode *here*\n\nmore $z$\n```\n:::warning[Label here]\nbody :abbr[T]{title=no}\n:::\n\nLow\n---\nlast [ref][r] <https://auto.example/>\n\n[r]: http://hidden.example\n> [!NOTE]\n> quoted"
    )
    df = texts(spark, body, None, "", "plain words only\non two lines\n\nand more")
    plain, flat = ({r["slug"]: r["t"] for r in df.select("slug", f(F.col("body")).alias("t")).collect()} for f in (markdown.plain_text, markdown.flat_text))
    assert plain[0] == "Head one\nSay  and $code$ *s* in link bold raw *star*, it costs $5 and $6.\none\ntwo\na b\nc d\ncode *here*\nmore $z$\nLabel here\nbody T\nLow\nlast ref https://auto.example/\nquoted"
    assert flat[0].startswith("Head oneSay x_1 + y and $code$ *s* in link bold <b>raw</b> *star*") and "formulaonetwo" in flat[0] and "alt wordscode *here*\n\nmore $z$Label herebody TLowlast ref" in flat[0]
    assert "addr" not in plain[0] + flat[0] and "hidden" not in plain[0] + flat[0]
    assert (plain[1], plain[2], flat[1], flat[2], flat[3]) == ("", "", "", "", "plain words only\non two linesand more")


def test_plain_and_flat_text_of_fences_next_to_each_other(spark):
    bodies = ["> ```\n> a *x*\n```\nb *y*\n\nc\n```\nd *z*", ":::note\n$$\nf *1*\n$$\n~~~\ng *2*\n~~~\n\t# *h*\n:::\n::leaf[*L*]", "> # q *r*\n> ===\n >\n>- s *t*\n    u *v*"]
    found = blocks.with_blocks(texts(spark, *bodies), "slug", "body")
    read = {r["doc"]: (r["p"], r["f"]) for r in found.select("doc", markdown.plain_of(F.col("lines"), F.col("blocks")).alias("p"), markdown.flat_of(F.col("lines"), F.col("blocks")).alias("f")).collect()}
    assert read == {
        0: ("a *x*\nb *y*\nc\nd z", "a *x*b *y*\n\ncd z"), 1: ("g *2*\n# h\n*L*", "f *1*g *2*# h*L*"), 2: ("q r\ns t\nu v", "q rs tu v"),
    }


def test_blocks_are_read_once_for_plain_text_and_words(spark):
    plan = site_queries.plain_text_of_nested(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_nested_texts_are_dealt_to_many_tasks(spark):
    rows = site_queries.plain_text_of_nested(spark, "/root/testdata/sf0.01").groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(rows) > 8 and max(r["count"] for r in rows) < 200 and sum(r["count"] for r in rows) == 1000


def test_let_takes_no_longer_for_parts_that_are_not_computed(spark):
    def seconds(parts):
        of = lambda x: F.when(x != "", x).otherwise(F.concat(*[F.regexp_replace(x, "a", str(n)) for n in range(parts)]))
        found = spark.range(0, 100_000, 1, 1).select(F.transform(F.array(F.col("id").cast("string")), lambda line: blocks.let(line, of)).alias("x"))
        took = []
        for _ in range(3):
            began = time.perf_counter()
            found.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(600) < 4 * seconds(1) + 0.5


PAGE = """<!DOCTYPE html><html><head><title>T &amp; <!--x--> U</title><style>p > a {}</style><script>var t = "</p>" > 3</script></head><body>
<!-- c > d --><nav>Menu</nav><div data-site-ignore><div>in <div>deeper</div></div>tail</div><p title="a > b">One &lt;two&gt; &#233;&#x1F600; &copy; &unknown; 3 < 4</p>
<div class="big search-panel"><p>panel<div>x</div></div><span class="katex"><span>k</span>l</span> <img data-ignore src=x>after <span class="katexish">kept</span>
<div id='search-panel'>never closed <p>all"""


def test_html_text_of_nested_pages(spark):
    rows = spark.createDataFrame([(PAGE,), (None,), ("",), ("no tags",), ("<p data-ignore>open <p>x</p></p> y",)], "h string")
    found = [r[0] for r in rows.select(html.html_text(F.col("h"))).collect()]
    assert found == ["T & U Menu One <two> é\U0001f600 © &unknown; 3 < 4 after kept", "", "", "no tags", "y"]
    assert rows.select(html.html_title(F.col("h"))).first()[0] == "T & <!--x--> U"


@pytest.mark.parametrize("given, wanted", [
    ("<p onclick='x()'>a<script>bad()</script><b>c</b></p>", "<p>a<b>c</b></p>"), ("<a href='javascript:x' title=t name=n>l</a>", '<a name="n">l</a>'),
    ("<A HREF=/x?a=1&amp;b=2 TARGET=_blank>l</A>", '<a href="/x?a=1&amp;b=2" target="_blank">l</a>'), ("<a href=' java&#115;cript:x'>l</a>", "<a>l</a>"),
    ("<img src=https://e.org/x.png onerror=y alt='a \"b\"'>", '<img src="https://e.org/x.png" alt="a &quot;b&quot;" />'), ("1 < 2 & 3 > 2 &amp; &x", "1 &lt; 2 &amp; 3 &gt; 2 &amp; &amp;x"),
    ("<iframe src=x>in</iframe><form><textarea>t <b>x</b></textarea><option>o</option>f</form>", "inf"), ("<!-- a > b --><!DOCTYPE html>z<br/>", "z<br />"),
    ("<style>p{}</style><STYLE>q", ""), ("<p title=\"a > b\">x</p>", "<p>x</p>"), (None, ""),
])
def test_sanitized(spark, given, wanted):
    df = spark.createDataFrame([(given,)], "h string")
    once = html.sanitized(F.col("h"))
    assert df.select(once).first()[0] == wanted and df.select(html.sanitized(once)).first()[0] == wanted
