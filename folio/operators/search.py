"""Full-text search: an inverted index as tables, and ranked results by BM25.

The index has a row per token and document, in each file in order of tokens, so that a query reads only the
pages of its words; a word that is still being typed is a range of tokens. Postings carry the places of
their words, which give each hit the heading that it stands under. A title's words weigh as much as
TITLE_WEIGHT of the body's and have no place.

A packed index has a row per token and range of document numbers instead, with gaps between numbers in
place of the numbers themselves, and for each row the greatest part of a score that is in it. The best of
a query are found from these without scoring the rest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.config import EXCERPT_WORDS, TITLE_WEIGHT
from folio.functions.blocks import let
from folio.functions.text import tokens
from folio.plans.order import positions
from folio.plans.storage import passing_tables, written

#: Parameters of BM25.
K1, B = 1.2, 0.75
#: Documents of a range of a packed index.
RANGE = 4096
#: Bits that a token's count in a document takes.
_TF_BITS = 32

_HEADINGS = "array<struct<anchor:string,text:string,depth:int,location:int>>"


@dataclass
class Index:
    """postings (token, doc, tf), docs (doc, url, title, content, length, headings) and places (token, doc, place): where the content has each token.

    docs has the texts, which postings and places follow from; these are what is written of them.
    """

    postings: DataFrame
    docs: DataFrame
    places: DataFrame

    def write(self, path: str, places: bool = True) -> None:
        """places: whether to write them; without, the index read back has none to find headings by.

        Documents come first. Their words are counted within each one's row, so that postings move once, and
        are dealt by a hash, which no sampling of all texts precedes.
        """
        self.docs.write.mode("errorifexists").parquet(f"{path}/docs")
        docs = self.docs.sparkSession.read.parquet(f"{path}/docs")
        rows = _entries(docs).repartition("token", "doc")
        if not docs.groupBy("doc").count().where("count > 1").isEmpty():
            rows = rows.groupBy("token", "doc").agg(F.sum("tf").alias("tf"))
        parts = {"postings": (rows, ("token", "doc")), **({"places": (_places(docs).repartition("token", "doc"), ("token", "doc", "place"))} if places else {})}
        for name, (df, order) in parts.items():
            df.sortWithinPartitions(*order).write.mode("errorifexists").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str, places: bool = True) -> Index:
        docs = spark.read.parquet(f"{path}/docs")
        none = docs.select(F.lit("").alias("token"), "doc", F.lit(0).alias("place")).where("false")
        return Index(spark.read.parquet(f"{path}/postings"), docs, spark.read.parquet(f"{path}/places") if places else none)


def content_words(content: Column) -> Column:
    """The words whose numbers, from 0, are places: runs without white space."""
    return F.regexp_extract_all(content, F.lit(r"\S+"), F.lit(0))


def _entries(docs: DataFrame) -> DataFrame:
    """(token, tf and what of doc, number and length there is) of documents with title and content, each row's from itself.

    Sorted, a row's tokens stand beside those that are alike; a title's are there as often as they weigh.
    """

    def counted(x: Column) -> Column:
        starts = F.filter(F.transform(x, lambda t, i: F.when((i == 0) | (F.get(x, i - 1) != t), i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(x, i).alias("token"), (F.coalesce(F.get(at, k + 1), F.size(x)) - i).cast("long").alias("tf"))))

    found = F.concat(F.flatten(F.array_repeat(tokens(F.col("title")), TITLE_WEIGHT)), tokens(F.col("content")))
    others = [c for c in docs.columns if c in ("doc", "number", "length")]
    return docs.select(*others, F.explode(let(F.sort_array(found), counted)).alias("e")).select("e.token", *others, "e.tf")


def _places(docs: DataFrame) -> DataFrame:
    words = docs.select("doc", F.posexplode(content_words(F.col("content"))).alias("place", "word"))
    return words.select(F.explode(tokens(F.col("word"))).alias("token"), "doc", "place")


def build_index(pages: DataFrame) -> Index:
    """Of pages (doc, url, title, content and, if there are any, headings: anchor, text, depth, location). Null texts are empty; documents without words are found by none.

    location: the number of content words before a heading.
    """
    empty = F.lit("")
    own = F.col("headings").cast(_HEADINGS) if "headings" in pages.columns else F.lit(None)
    texts = pages.select("doc", "url", F.coalesce("title", empty).alias("title"), F.coalesce("content", empty).alias("content"), F.coalesce(own, F.array().cast(_HEADINGS)).alias("headings"))
    postings = _entries(texts).groupBy("token", "doc").agg(F.sum("tf").alias("tf"))
    length = TITLE_WEIGHT * F.size(tokens(F.col("title"))) + F.size(tokens(F.col("content")))
    return Index(postings, texts.withColumn("length", length.cast("long")), _places(texts))


def query_tokens(query: str) -> list[str]:
    return sorted(set(re.findall(r"[^\W_]+", query.lower())))


def typed_tokens(query: str) -> tuple[list[str], str | None]:
    """The whole words of a query and, if it ends within a word, the beginning that this word has."""
    found = re.findall(r"[^\W_]+", query.lower())
    open_ = found.pop() if found and re.search(r"[^\W_]\Z", query) else None
    return sorted(set(found)), open_


def _wanted(postings: DataFrame, query: str, typed: bool) -> DataFrame:
    """postings of the query's words with `term`: the word, or for a beginning it and a star."""
    whole, start = typed_tokens(query) if typed else (query_tokens(query), None)
    found = postings.where(F.col("token").isin(*whole) if whole else F.lit(False)).withColumn("term", F.col("token"))
    if start:
        found = found.unionByName(postings.where(F.startswith("token", F.lit(start))).withColumn("term", F.lit(f"{start}*")))
    return found


def _is_hit(query: str, typed: bool):
    """Whether a content word has a token of the query. Most words do not even contain one, which is told without taking them apart."""
    whole, start = typed_tokens(query) if typed else (query_tokens(query), None)
    known = F.array(*[F.lit(t) for t in whole] or [F.lit("")])
    begins = lambda w: F.exists(tokens(w), lambda t: F.startswith(t, F.lit(start)))
    exact = lambda w: F.arrays_overlap(tokens(w), known) | begins(w) if start else F.arrays_overlap(tokens(w), known)

    def hit(w: Column) -> Column:
        there = let(F.lower(w), lambda x: reduce(Column.__or__, [F.contains(x, F.lit(t)) for t in [*whole, *([start] if start else [])]] or [F.lit(False)]))
        return F.when(there, exact(w)).otherwise(False)

    return hit


def _part(tf: Column, length: Column, mean: Column) -> Column:
    """What a term gives a document's score before its own weight."""
    return (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / mean))


def _idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1) + (n - df + 0.5) / (df + 0.5))


def _scored(index: Index, query: str, typed: bool) -> DataFrame:
    """(doc, score) of the documents with one of the query's words."""
    lengths = index.docs.where("length > 0").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    n, mean = (lengths.select(c).scalar() for c in ("n", "mean"))
    hits = _wanted(index.postings, query, typed).groupBy("term", "doc").agg(F.sum("tf").alias("tf"))
    per_term = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each word of the query
    joined = hits.join(F.broadcast(per_term), "term").join(index.docs.select("doc", "length"), "doc")
    part = _idf(n, F.col("df")) * _part(F.col("tf"), F.col("length"), mean)
    return joined.groupBy("doc").agg(F.sum(part).alias("score"))


def _order() -> list[Column]:
    return [F.desc(F.round("score", 9)), F.col("doc").asc()]


def search(index: Index, query: str, limit: int | None = None, typed: bool = False) -> DataFrame:
    """(doc, url, title, score, excerpt), best first, ties by doc; an empty query finds nothing. A document needs one of the words.

    Only postings of the query's words are read, summed per document, and joined with the documents. The
    two numbers of the whole collection are scalar subqueries. typed: a query that ends within a word finds
    all words that begin so; together they count as one.
    """
    scored = _scored(index, query, typed)
    ranked = scored if limit is None else scored.orderBy(*_order()).limit(limit)
    shown = ranked.join(index.docs.drop("length", "headings"), "doc").orderBy(*_order())  # texts come last, for what is shown
    return shown.select("doc", "url", "title", F.round("score", 6).alias("score"), marked_excerpt(F.col("content"), _is_hit(query, typed)).alias("excerpt"))


def marked_excerpt(content: Column, is_hit, length: int = EXCERPT_WORDS) -> Column:
    """`length` words around the first hit (from a third of that before it), hits in <mark>."""

    def around(words: Column) -> Column:
        first = F.array_position(F.transform(words, is_hit), F.lit(True))
        return let(F.greatest(F.lit(1), first.cast("int") - length // 3), lambda start: _marked(words, start, is_hit, length))

    return let(content_words(content), around)


def _marked(words: Column, start: Column, is_hit, length: int) -> Column:
    shown = F.transform(F.slice(words, start, F.lit(length)), lambda w: F.when(is_hit(w), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w))
    return F.array_join(shown, " ")


def sub_results(index: Index, query: str, limit: int | None = None, typed: bool = False, length: int = EXCERPT_WORDS) -> DataFrame:
    """(doc, url, title, score, anchor, heading, depth, locations, excerpt): a row for each heading of a found document under which words of the query stand.

    url has the heading's anchor. locations: the places of hits in the content, ascending; what stands before
    the first heading has a row with anchor ''. The excerpt is around the first of them. A document that
    has its hits in the title alone has a row without locations and the excerpt of its beginning. score is the
    whole document's; rows are ordered by it, then by document and place. limit: of documents.
    """
    scored = _scored(index, query, typed)
    ranked = scored if limit is None else scored.orderBy(*_order()).limit(limit)
    places = _wanted(index.places, query, typed).join(ranked, "doc", "left_semi").select("doc", "place").distinct()
    ends = F.expr("transform(headings, (h, i) -> struct(h.anchor as anchor, h.text as heading, h.depth as depth, h.location as first, coalesce(get(headings, i + 1).location, 2147483647) as last))")
    before = F.array(F.struct(F.lit("").alias("anchor"), F.lit(None).cast("string").alias("heading"), F.lit(0).alias("depth"), F.lit(0).alias("first"), F.coalesce(F.get("headings", F.lit(0))["location"], F.lit(2147483647)).alias("last")))
    parts = index.docs.join(ranked, "doc", "left_semi").select("doc", F.explode(F.concat(before, ends)).alias("p")).select("doc", "p.*")
    under = places.join(parts, "doc").where("first <= place and place < last").groupBy("doc", "anchor", "heading", "depth", "first").agg(F.sort_array(F.collect_set("place")).alias("locations"))
    found = ranked.join(under, "doc", "left").join(index.docs.drop("length", "headings"), "doc").withColumn("anchor", F.coalesce("anchor", F.lit("")))
    start = F.greatest(F.lit(1), F.coalesce(F.get("locations", F.lit(0)), F.lit(0)) + 1 - length // 3)
    shown = found.orderBy(*_order(), F.coalesce("first", F.lit(0)))
    return shown.select(
        "doc", F.concat("url", F.when(F.col("anchor") != "", F.concat(F.lit("#"), "anchor")).otherwise("")).alias("url"), "title", F.round("score", 6).alias("score"), "anchor", "heading",
        F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("locations", F.array().cast("array<int>")).alias("locations"), _marked(content_words(F.col("content")), start, _is_hit(query, typed), length).alias("excerpt"),
    )


# --- packed ----------------------------------------------------------------------------------


@dataclass
class PackedIndex:
    """blocks (token, range, n, best, gaps, tfs), written in order of tokens in each file, and docs as Index has them with `number`, by it.

    A block has the documents of a token whose numbers lie in one range of RANGE: the first number within the
    range and then gaps, with their tf. best: the greatest part of a score before the term's weight.
    """

    blocks: DataFrame
    docs: DataFrame

    def write(self, path: str) -> None:
        self.blocks.sortWithinPartitions("token", "range").write.mode("errorifexists").parquet(f"{path}/blocks")
        self.docs.write.mode("errorifexists").parquet(f"{path}/docs")

    @staticmethod
    def read(spark: SparkSession, path: str) -> PackedIndex:
        return PackedIndex(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/docs"))


def packed(index: Index, size: int = RANGE) -> PackedIndex:
    """The index with numbered documents, in blocks; its docs are of a written table in order of numbers, so that most of a block is put together where its documents lie."""
    docs = positions(index.docs, F.col("doc"), position="number").withColumn("number", F.col("number") - 1).drop("total")
    mean = docs.where("length > 0").agg(F.avg("length").alias("m")).select("m").scalar()
    at = F.shiftleft(F.col("number") % size, _TF_BITS) + F.col("tf")  # place and count as one number
    rows = _entries(docs.select("number", "length", "title", "content")).select("token", F.floor(F.col("number") / size).alias("range"), at.alias("e"), _part(F.col("tf"), F.col("length"), mean).alias("part"))
    found = rows.groupBy("token", "range").agg(F.count("*").cast("int").alias("n"), F.max("part").alias("best"), F.sort_array(F.collect_list("e")).alias("es"))  # `size` entries at most
    place = lambda e: F.shiftright(e, _TF_BITS).cast("int")
    gaps = F.transform("es", lambda e, i: F.when(i == 0, place(e)).otherwise(place(e) - place(F.get("es", i - 1))))
    blocks = found.select("token", "range", "n", "best", gaps.alias("gaps"), F.transform("es", lambda e: e.bitwiseAND(F.lit((1 << _TF_BITS) - 1)).cast("int")).alias("tfs"))
    return PackedIndex(blocks, docs.withColumn("size", F.lit(size)))


def _numbers(gaps: Column) -> Column:
    """The places within a range."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(gaps, start, lambda s, g: F.struct((s["at"] + g).alias("at"), F.array_append(s["out"], s["at"] + g).alias("out")), lambda s: s["out"])


def unpacked_postings(index: PackedIndex, size: int = RANGE) -> DataFrame:
    """(token, doc, tf) of all blocks: they meet the documents of their ranges as they are, before they are taken apart."""
    own = index.docs.groupBy(F.floor(F.col("number") / size).alias("range")).agg(F.sort_array(F.collect_list(F.struct("number", "doc")))["doc"].alias("docs"))  # `size` at most, without a gap
    rows = index.blocks.select("token", "range", "gaps", "tfs").join(own, "range").select("token", F.explode(F.arrays_zip(F.transform(_numbers(F.col("gaps")), lambda at: F.get("docs", at)).alias("doc"), F.col("tfs").alias("tf"))).alias("e"))
    return rows.select("token", "e.doc", "e.tf")


def unpacked(blocks: DataFrame, size: int = RANGE) -> DataFrame:
    """(token, number, tf) of blocks."""
    rows = blocks.select("token", "range", F.explode(F.arrays_zip(_numbers(F.col("gaps")).alias("at"), F.col("tfs").alias("tf"))).alias("e"))
    return rows.select("token", (F.col("range") * size + F.col("e.at")).alias("number"), F.col("e.tf").alias("tf"))


def best_of(index: PackedIndex, query: str, k: int, typed: bool = False, size: int = RANGE, first: int = 2) -> tuple[DataFrame, DataFrame]:
    """The k best of search() as (doc, url, title, score), and a row of how many ranges and blocks the query has and how many of them were read.

    For each range of documents the best parts of the query's terms add up to a bound of all scores in it.
    The `first` * k ranges of highest bounds are scored; the k-th score found there rules out every range
    whose bound is lower, and only the others are scored besides. Both results are written tables.
    """
    spark = index.blocks.sparkSession
    with passing_tables(spark) as keep:
        wanted = _wanted(index.blocks, query, typed)
        lengths = index.docs.where("length > 0").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
        n, mean = (lengths.select(c).scalar() for c in ("n", "mean"))
        # of a beginning's tokens a document can have several; it counts once for the term
        if typed and typed_tokens(query)[1]:
            rows = unpacked(wanted.where("endswith(term, '*')"), size).select("number").distinct()
            df = wanted.where("not endswith(term, '*')").groupBy("term").agg(F.sum("n").alias("df")).unionByName(rows.agg(F.count("*").alias("df")).select(F.lit(f"{typed_tokens(query)[1]}*").alias("term"), "df").where("df > 0"))
        else:
            df = wanted.groupBy("term").agg(F.sum("n").alias("df"))
        idf = written(df.select("term", _idf(n, F.col("df")).alias("idf")), "terms")
        # a part grows with tf and is concave in it: tokens of one term together have at most the sum of their parts
        bounds = wanted.select("term", "range", "best").join(F.broadcast(idf), "term").groupBy("range").agg(F.sum(F.col("idf") * F.col("best")).alias("bound"), F.count("*").alias("blocks"))
        bounds = written(bounds, "bounds")

        def scores(ranges: DataFrame) -> DataFrame:
            chosen = wanted.join(ranges.select("range"), "range", "left_semi")
            rows = chosen.select("term", F.col("range"), "gaps", "tfs").withColumnRenamed("term", "token")
            parts = unpacked(rows, size).withColumnRenamed("token", "term").groupBy("term", "number").agg(F.sum("tf").alias("tf")).join(F.broadcast(idf), "term").join(index.docs.select("number", "doc", "length"), "number")
            return parts.groupBy("number", "doc").agg(F.sum(F.col("idf") * _part(F.col("tf"), F.col("length"), mean)).alias("score")).orderBy(*_order()).limit(k)

        start = written(bounds.orderBy(F.desc("bound"), "range").limit(first * k), "start")
        found = written(scores(start), "found")
        kth = found.agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
        rest = bounds.join(start, "range", "left_anti")
        if kth["n"] == k:
            rest = rest.where(F.col("bound") >= F.lit(kth["s"] - 1e-8))  # what rounding may make equal is read too
        rest = written(rest, "rest")
        both = found.unionByName(scores(rest)) if not rest.isEmpty() else found
        best = both.orderBy(*_order()).limit(k).join(index.docs.select("number", "url", "title"), "number")
        sums = lambda df, what: df.agg(F.count("*").alias(f"ranges{what}"), F.coalesce(F.sum("blocks"), F.lit(0)).alias(f"blocks{what}"))
        read = sums(bounds, "").join(sums(start.unionByName(rest), "_read"))
        return keep(best.select("doc", "url", "title", F.round("score", 6).alias("score")), "best"), keep(read, "read")
