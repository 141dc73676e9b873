"""Source divergence audit: how far the word use of each source is from the others of its language.

Pass one counts exactly in how many documents of a language each term occurs; those in enough of them
are kept. Pass two goes over the texts with an Aho-Corasick automaton of the kept terms, each between
delimiters, so that a hit is a whole term, and sums occurrences by source. Only what occurs is written
(sparse postings). Terms are then dealt into blocks, in which every pair of sources gets its part of the
sum of differences, and every source its leading terms; the parts are added up and ranked.

Kept terms have ids in their order. An automaton takes SHARD of them; a vocabulary beyond that makes
several, each for a pass over the texts of its own, so that what a worker holds stays bounded.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.plans.order import positions

from .common import arrow_schema, map_arrow, passing_tables, written

#: Terms of an automaton, and counts that a task holds before it passes them on.
SHARD, HELD = 400_000, 500_000
#: Postings of a block: at least and at most; between them the square of the most sources a language has.
BLOCK_LEAST, BLOCK_MOST = 5_000, 2_000_000
#: Probabilities are in parts of SCALE; each count is raised by PRIOR.
SCALE, PRIOR = 1_000_000_000, 5

#: Bytes of UTF-8: letters and all beyond ASCII stay, A-Z in lower case; the rest is a delimiter.
_DELIMITED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x0A for b in range(256))


def delimited(text: str) -> bytes:
    """The text's terms in lower case (A-Z alone), in UTF-8, with line ends between them."""
    return text.encode("utf-8", "surrogatepass").translate(_DELIMITED)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _given(held: dict[tuple, Counter], ddl: str, rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """The sums of a task as batches of (*key, counted, n), and none of them held any more."""
    schema = arrow_schema(ddl)
    for key in list(held):
        counts = held.pop(key)
        what, n = list(counts), list(counts.values())
        for at in range(0, len(what), rows):
            part = what[at : at + rows]
            columns = [*([k] * len(part) for k in key), [w.decode("utf-8", "surrogatepass") if isinstance(w, bytes) else w for w in part], n[at : at + rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, df): in how many documents of a language each term occurs."""
    ddl = "lang string, term string, df long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held[(lang,)].update(set(delimited(text).split(b"\n")))
            if sum(map(len, held.values())) > HELD:
                yield from _given(held, ddl)
        yield from _given(held, ddl)

    return map_arrow(_read(docs).select("lang", "text"), work, ddl).where("term <> ''").groupBy("lang", "term").agg(F.sum("df").alias("df"))


_BUILT: tuple[str, dict[str, ahocorasick.Automaton]] = ("", {})


def _automata(name: str, terms: dict[str, tuple[list[str], list[int]]]) -> dict[str, ahocorasick.Automaton]:
    """One automaton for each language, kept in the worker until another shard is asked for."""
    global _BUILT
    if _BUILT[0] != name:
        _BUILT = ("", {})  # the former one goes before the next is built
        found = {}
        for lang, (words, ids) in terms.items():
            found[lang] = a = ahocorasick.Automaton()
            for word, i in zip(words, ids, strict=True):
                a.add_word(f"\n{word}\n", i)
            a.make_automaton()
        _BUILT = (name, found)
    return _BUILT[1]


def _occurrences(docs: DataFrame, shard: DataFrame) -> DataFrame:
    """(lang, source, id, n): partial sums of the occurrences of a shard's terms."""
    spark, name, ddl = docs.sparkSession, uuid.uuid4().hex, "lang string, source string, id long, n long"
    terms = {lang: (own["term"].tolist(), own["id"].tolist()) for lang, own in shard.toArrow().to_pandas().groupby("lang")}  # SHARD rows at most
    shared = spark.sparkContext.broadcast(terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, held = _automata(name, shared.value), defaultdict(Counter)
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                if lang in automata:
                    padded = f"\n{delimited(text).decode('utf-8', 'surrogatepass')}\n"
                    held[lang, source].update(map(itemgetter(1), automata[lang].iter(padded)))
            if sum(map(len, held.values())) > HELD:
                yield from _given(held, ddl)
        yield from _given(held, ddl)

    return map_arrow(_read(docs), work, ddl)


def vocabulary(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term, id) of the terms in at least so many documents of their language; ids from 0 in the order of language, then term."""
    kept = document_frequencies(docs).where(F.col("df") >= least).select("lang", "term")
    return positions(kept, F.col("lang"), F.col("term")).select("lang", "term", (F.col("position") - 1).alias("id"))


def postings(docs: DataFrame, kept: DataFrame, shard: int = SHARD) -> DataFrame:
    """(lang, source, id, n) with n > 0: how often each kept term occurs in each group; written."""
    empty = docs.sparkSession.createDataFrame([], "lang string, source string, id long, n long")
    total = kept.count()
    parts = [written(_occurrences(docs, kept.where(F.col("id").between(lo, lo + shard - 1))).groupBy("lang", "source", "id").agg(F.sum("n").alias("n")), "postings") for lo in range(0, total, shard)]
    for p in parts:
        empty = empty.unionByName(p) if p is not parts[0] else p
    return empty


def _parts(n: str, words: str, v: str):
    """1 + floor(SCALE * (n + PRIOR) / (words + PRIOR * v)) by long division in three steps, exact as long as a language has fewer than 9e15 occurrences."""
    below = f"greatest({words} + {PRIOR} * {v}, 1L)"
    rest, out = f"({n} + {PRIOR})", "1L"
    for step in (1_000_000, 1_000, 1):
        out += f" + {step}L * ({rest} * 1000L div {below})"
        rest = f"({rest} * 1000L % {below})"
    return F.expr(out)


def _compared(terms_each: int):
    """Of a block of terms: each pair of sources' part of the sum of differences, and each source's leading terms."""

    def work(key: tuple, own: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        lang, names = key[0], sorted(groups["source"])
        place = {s: n for n, s in enumerate(names)}
        p0 = groups.set_index("source")["p0"].loc[names].to_numpy("int64")
        own = own.assign(at=own["source"].map(place)).sort_values(["at", "id"])
        at, p, q = (own[c].to_numpy("int64") for c in ("at", "p", "q"))
        ids, term = np.unique(own["id"].to_numpy("int64"), return_inverse=True)
        starts = np.searchsorted(at, np.arange(len(names) + 1))
        there = np.flatnonzero(np.diff(starts))  # sources with terms here
        out: list[tuple] = []
        for a, name in enumerate(names):
            mine = slice(starts[a], starts[a + 1])
            dense = np.full(len(ids), p0[a], np.int64)
            dense[term[mine]] = p[mine]
            if a + 1 < len(names):
                x = np.sort(dense)
                sums = np.concatenate([[0], np.cumsum(x)])
                k = np.searchsorted(x, p0)  # if no term of the other source were here
                value = p0 * k - sums[k] + (sums[-1] - sums[k]) - p0 * (len(x) - k)
                if len(there):
                    value[there] += np.add.reduceat(np.abs(dense[term] - p) - np.abs(dense[term] - p0[at]), starts[there])
                out += [(lang, name, names[b], None, int(value[b])) for b in range(a + 1, len(names))]
            over = p[mine] - q[mine]
            best = np.lexsort((ids[term[mine]], -over))[:terms_each]
            out += [(lang, name, None, int(ids[term[mine]][i]), int(over[i])) for i in best if over[i] > 0]
        found = pd.DataFrame(out, columns=["lang", "source", "other", "id", "value"])
        return found.astype({"id": "Int64", "value": "int64"})

    return work


def audit(docs: DataFrame, least: int = 30, terms_each: int = 50, shard: int = SHARD) -> DataFrame:
    """lang, source, part, item, value, rank: how each source differs from the others of its language.

    Null text, lang and source count as empty; repeated rows count as often. Terms are runs of ASCII letters
    and characters beyond ASCII, A-Z in lower case; a language keeps those in at least `least` of its
    documents. A kept term's p in a group is 1 + floor(SCALE * (n + PRIOR) / (N + PRIOR * V)): n its
    occurrences, N those of all V kept terms. Part `pair`: item is another source, value the sum of
    |p - that source's p| over the kept terms (0 if there is none), all of them ranked. Part `term`: item is a
    kept term of the group whose p is above the language's, value the excess, the first terms_each of them.
    Greater values rank first, ties by the item's UTF-8. An empty table gives an empty result; other columns
    are left out. A pair of sources is a row, so that the result grows with the square of a language's sources.
    """
    with passing_tables(docs.sparkSession) as keep:
        kept = written(vocabulary(docs, least), "vocabulary")
        found = postings(docs, kept, shard)
        sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count("*").alias("terms"))
        v = kept.groupBy("lang").agg(F.count("*").alias("v"))
        groups = _read(docs).groupBy("lang", "source").agg(F.lit(1)).select("lang", "source").join(sizes, ["lang", "source"], "left").join(v, "lang", "left")
        groups = written(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("words", "terms", "v")]), "groups")
        groups = groups.withColumn("p0", F.when(F.col("v") > 0, _parts("0L", "words", "v")).otherwise(0))
        of_lang = found.groupBy("lang", "id").agg(F.sum("n").alias("n_lang")).join(groups.groupBy("lang").agg(F.sum("words").alias("words"), F.max("v").alias("v")), "lang")
        q = of_lang.select(F.col("lang").alias("l"), F.col("id").alias("i"), _parts("n_lang", "words", "v").alias("q"))
        rows = found.join(groups, ["lang", "source"]).withColumn("p", _parts("n", "words", "v")).join(q, (F.col("lang") == F.col("l")) & (F.col("id") == F.col("i"))).select("lang", "source", "id", "p", "q")
        most = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("terms").alias("terms")).agg(F.max("sources"), F.max("terms")).first()
        n_blocks = max(1, -(-(most[1] or 0) // min(BLOCK_MOST, max(BLOCK_LEAST, (most[0] or 0) ** 2))))
        dealt = groups.select("lang", "source", "p0", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
        keys = ["lang", "block"]
        blocks = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).groupBy(*keys).cogroup(dealt.groupBy(*keys))
        parts = written(blocks.applyInPandas(_compared(terms_each), "lang string, source string, other string, id long, value long"), "parts")
        sums = parts.where("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
        both = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
        pairs = sums.select("lang", both.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
        first = lambda df, by: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), by)).cast("int"))
        terms = first(parts.where("id is not null").select("lang", "source", "id", "value"), "id").where(F.col("rank") <= terms_each)
        named = terms.join(kept.select("id", F.col("term").alias("item")), "id").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
        return keep(first(pairs, "item").unionByName(named), "audit")


ORACLE = r"""
with d as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
w as (select doc, lang, source, unnest(words) as term from d),
k as (select lang, term from w group by 1, 2 having count(distinct doc) >= 30),
v as (select lang, count(*) as v from k group by 1),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w join k using (lang, term) group by 1, 2, 3),
gn as (select lang, source, cast(coalesce(sum(n), 0) as hugeint) as total from g left join c using (lang, source) group by 1, 2),
ln as (select lang, cast(sum(n) as hugeint) as total from c group by 1),
p as (select gn.lang, gn.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (gn.total + 5 * v.v) as p
      from gn join k using (lang) join v using (lang) left join c on c.lang = gn.lang and c.source = gn.source and c.term = k.term),
q as (select lang, term, 1 + (1000000000::hugeint * (cast(sum(n) as hugeint) + 5)) // (any_value(ln.total) + 5 * any_value(v.v)) as q from c join v using (lang) join ln using (lang) group by 1, 2),
s as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select p.lang, p.source, p.term as item, p.p - q.q as value from p join q using (lang, term) where p.n > 0 and p.p > q.q),
r as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
      union all select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from terms) where rank <= 50)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from r
"""
