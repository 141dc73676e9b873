"""Repeated passages across documents by sparse suffix arrays.

Of a document's suffixes (each begins at a word) only those at minimiser positions are retained: in
any SLIDE neighbouring positions, the one whose 10 words hash least. The choice depends on content
alone, so copies of a passage retain the same places in it.

Retained suffixes are sorted by the hash of their first CORE words over ranges of the whole table,
ties by document, and each document's entry is compared with the entries next to it: an equal
neighbour is another document's suffix that begins alike. Suffixes without one are done. Each of the
others is extended to the left, word by word, up to SLIDE - 1 words, and these longer suffixes are
sorted and compared by their first LEAST words in the same way: equal neighbours prove a repeat of
LEAST words. Every one of them is extended in full, inside a run too: a document copied whole is one run,
and a third that quotes its middle begins and ends inside it.

Any passage of LEAST words that two documents share is found: it has SLIDE positions from which CORE
words lie within it, and one of them is retained in both. Ranges are cut by hash and document, so that
a passage in a third of all documents is spread over tasks; where a cut parts neighbours, the ends of
the ranges (two entries for each) are compared afterwards. The order among unequal suffixes is of no
use here, so that hashes stand in for their words and no text is shuffled for sorting. A first
comparison may pass too many, by 64 bits; the second decides, by 128 bits of two hashes with word hashes
of their own.

A text that another document has word for word is a repeat as a whole. Of the documents that have the
same text one is extended for all, so that a group of copies makes the rows of one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, arrow_schema, map_arrow, map_batches, passing_tables, written

#: Words in a repeat, in the part compared first, and in a minimiser's own hash.
LEAST, SEED_WORDS = 50, 10
SLIDE = 21
CORE = LEAST - SLIDE + 1
#: Rows of a batch that a worker gives back at most.
GIVEN = 65_536
#: Odd bases of the two hashes.
_BASE, _BASE_2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(text: str | None, seed: int = 0) -> np.ndarray:
    words = (text or "").encode().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))


def window_hashes(words: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """A mixed hash of every `width` consecutive words: differences of prefix sums, times the base's inverse powers."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(len(words), base), dtype=np.uint64)])
    x = (sums[width:] - sums[:-width]) * _powers(n, pow(base, -1, 1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over every `width` neighbours, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def retained(words: np.ndarray) -> np.ndarray:
    """Minimiser positions from which CORE words follow; all equal minima of a slide are retained."""
    values = window_hashes(words, SEED_WORDS)[: len(words) - CORE + 1] if len(words) >= LEAST else np.zeros(0, np.uint64)
    if len(values) < SLIDE:
        return np.zeros(0, np.int64)
    least = _sliding(values, SLIDE, np.minimum)
    pad = np.zeros(SLIDE - 1, np.uint64)
    return np.flatnonzero(values == _sliding(np.concatenate([pad, least, pad]), SLIDE, np.maximum))


def suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, at): the retained suffixes of docs (doc_id, text) and the hash of their first CORE words."""

    def work(rows: dict) -> dict:
        ids, hashes, places = [], [], []
        for i, t in zip(rows["doc_id"], rows["text"], strict=True):
            words = word_hashes(t)
            at = retained(words)
            ids.append(np.full(len(at), i, np.int64))
            hashes.append(window_hashes(words, CORE)[at])
            places.append(at)
        return {"doc_id": np.concatenate(ids), "h": np.concatenate(hashes).view(np.int64), "at": np.concatenate(places).astype(np.int32)}

    return map_batches(docs, work, "doc_id long, h long, at int", 256)


#: Marks of a sorted range's first and last entries.
FIRST, LAST = 1, 2
_COMPARED = "doc_id long, h long, g long, at int, part int, near boolean, edge int"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range (doc_id, h, g, at) sorted by h, g and doc_id: the entries with an equal neighbour (near), and its first and last entries (edge).

    An entry is all rows of one h, g and document; its neighbours are the entries before and after it.
    """
    schema, part = arrow_schema(_COMPARED), TaskContext.get().partitionId()

    def rows(columns: list, near: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        kept = np.flatnonzero(near | (edge > 0))
        found = [*(c[kept] for c in columns), np.full(len(kept), part), near[kept], edge[kept]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema, strict=True)], schema=schema)

    held, near, edge = [], False, FIRST  # the entry that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy() for c in batch.columns])
        if all(new[-1] == old[0] for new, old in zip(held[-1][:3], held[0], strict=False)):
            continue
        doc, h, g, at = map(np.concatenate, zip(*held, strict=True))
        starts = np.concatenate([[0], np.flatnonzero((np.diff(h) != 0) | (np.diff(g) != 0) | (np.diff(doc) != 0)) + 1])
        alike = (h[starts[1:]] == h[starts[:-1]]) & (g[starts[1:]] == g[starts[:-1]])
        nears = np.append(alike, False) | np.append(near, alike)
        sizes, last = np.diff(starts), starts[-1]
        edges = np.zeros(last, np.int32)
        edges[: sizes[0]] = edge
        yield rows([doc[:last], h[:last], g[:last], at[:last]], np.repeat(nears[:-1], sizes), edges)
        held, near, edge = [[doc[last:], h[last:], g[last:], at[last:]]], bool(nears[-1]), 0
    if held:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        n = len(columns[0])
        yield rows(columns, np.full(n, near), np.full(n, edge | LAST, np.int32))


def in_other_documents(rows: DataFrame) -> DataFrame:
    """(doc_id, at) of the rows (doc_id, h, g, at; g may be missing) whose h and g another document has too, by sorting and comparing neighbours."""
    order = ["h", "g", "doc_id"]
    rows = rows if "g" in rows.columns else rows.withColumn("g", F.lit(0).cast("long"))
    ranges = rows.select("doc_id", "h", "g", "at").repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(map_arrow(ranges, _compared, _COMPARED), "neighbours")
    edges = found.where("edge > 0").withColumn("key", F.struct("h", "g"))
    end = lambda mark: F.min(F.when(F.col("edge").bitwiseAND(F.lit(mark)) != 0, F.col("key")))
    ends = edges.groupBy("part").agg(end(FIRST).alias("key"), end(LAST).alias("last"))
    parted = ends.withColumn("before", F.lag("last").over(Window.orderBy("part"))).where("key = before").select("key").distinct()
    return found.where("near").select("doc_id", "at").union(edges.where("not near").join(parted, "key", "left_semi").select("doc_id", "at"))


def _runs(at: np.ndarray, gap: int) -> list[np.ndarray]:
    return np.split(at, np.flatnonzero(np.diff(at) > gap) + 1)


def extended_starts(at: np.ndarray, n_words: int) -> np.ndarray:
    """Where to compare LEAST words: at every retained suffix and all its left extensions.

    A window counts if both documents list it, and what is one run's end in one of them may lie inside a run of the other.
    """
    found = np.unique(at[:, None] - np.arange(SLIDE))
    return found[(found >= 0) & (found + LEAST <= n_words)]


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, least, words) of the documents whose only text another document has too; least: the first document that has that text alone."""
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    own = docs.groupBy("doc_id", F.md5("text").alias("digest")).agg(F.max(words).alias("words"))
    alone = own.groupBy("doc_id").agg(F.count("*").alias("texts"), F.max("digest").alias("digest"), F.max("words").alias("words"))
    shared = own.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"))
    single = alone.where("texts = 1").join(shared, F.col("digest") == F.col("d")).select("doc_id", "digest", "words")
    first = single.groupBy(F.col("digest").alias("d")).agg(F.min("doc_id").alias("least"))
    return single.join(first, F.col("digest") == F.col("d")).select("doc_id", "least", "words")


def repeats(docs: DataFrame) -> DataFrame:
    """One row per document with a repeated passage: doc_id, n_spans, repeated_words, spans.

    spans: start:end in words (white-space separated), end exclusive, comma-joined: the union of the
    LEAST-word windows found in another document, decided by 128 bits of hashes. Passages that repeat within
    one document only do not count; rows that repeat a doc_id are one document, and rows with a null doc_id
    take no part. Null, empty and short texts have no spans. An empty table gives an empty result.
    """
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with passing_tables(docs.sparkSession) as keep:
        return keep(_repeats(docs), "repeats")


def _repeats(docs: DataFrame) -> DataFrame:
    same = written(copies(docs).where(F.col("words") >= LEAST), "copies")
    candidates = in_other_documents(written(suffixes(docs), "suffixes"))
    places = candidates.groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("at"))
    places = places.join(same.where("doc_id <> least").select("doc_id"), "doc_id", "left_anti")
    ddl = "doc_id long, h long, g long, at int"
    schema = arrow_schema(ddl)

    def extend(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                rows = batch.slice(lo, 16).to_pydict()
                ids, hashes, others, starts = [], [], [], []
                for i, t, at in zip(rows["doc_id"], rows["text"], rows["at"], strict=True):
                    words = word_hashes(t)
                    at = np.array(at)
                    s = extended_starts(at[at < len(words)], len(words))
                    ids.append(np.full(len(s), i, np.int64))
                    hashes.append(window_hashes(words, LEAST)[s])
                    others.append(window_hashes(word_hashes(t, 1), LEAST, _BASE_2)[s])
                    starts.append(s)
                cols = (np.concatenate(ids), np.concatenate(hashes).view(np.int64), np.concatenate(others).view(np.int64), np.concatenate(starts).astype(np.int32))
                for at in range(0, len(cols[0]), GIVEN):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + GIVEN], f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    longer = map_arrow(docs.join(places, "doc_id").select("doc_id", "text", "at"), extend, ddl)
    proven = in_other_documents(written(longer, "extended")).join(same.select("doc_id"), "doc_id", "left_anti")

    def merge(rows: dict) -> dict:
        spans = []
        for at in rows["at"]:
            spans.append([(int(r[0]), int(r[-1]) + LEAST) for r in _runs(np.array(at), LEAST)])
        return {
            "doc_id": rows["doc_id"],
            "n_spans": [len(s) for s in spans],
            "repeated_words": [sum(e - b for b, e in s) for s in spans],
            "spans": [",".join(f"{b}:{e}" for b, e in s) for s in spans],
        }

    grouped = proven.groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("at"))
    whole = same.select("doc_id", F.lit(1).alias("n_spans"), F.col("words").alias("repeated_words"), F.concat(F.lit("0:"), F.col("words").cast("string")).alias("spans"))
    return map_batches(grouped, merge, "doc_id long, n_spans int, repeated_words long, spans string").unionByName(whole)
