"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words: hashes take the words at its ones and ignore those at
its zeros, so that a hit survives substituted words there. SEEDS is a family of which one mask at least
hits in every overlap that counts, wherever its substitutions are.

Benchmark hashes are a table. Documents keep those of their hashes that a Bloom filter of it lets
through, with their places, and these join it by hash; documents without one are done after one pass and
never shuffled. Both places give a hit's diagonal, and a pair is compared along the diagonals of its hits.

A hash that many places of items share (a common phrase) makes no row for each document and item. Its
places meet in blocks instead, each with the words around it, and a whole block of items is compared
with one of documents at once; only what overlaps there goes on. That loses nothing: an overlap has a part
of at most LONGEST words that is an overlap too, and that part bears a hit.

The filter has a fixed greatest size: a benchmark beyond it makes more rows to join, not other results.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, passing_tables, written

#: Masks that bear every pattern of substitutions of an overlap of LEAST_WORDS equal words and LEAST_SHARE.
SEEDS = ("11010111", "101000100111", "111010010001")
#: An overlap has so many equal words (the whole item if it is shorter), and this share of its length (4 of 5).
LEAST_WORDS, LEAST_SHARE = 13, (4, 5)
#: Bits of the Bloom filter for each benchmark hash, how many it sets for one, and its least and greatest size as a power of 2 (16 MB).
#: Up to two million hashes it lets one in two million others through.
FILTER_BITS, FILTER_SLOTS, FILTER_LEAST, FILTER_MOST = 64, 6, 16, 27
#: Words of an overlap that has no shorter one within. One with 26 equal words can be cut into two with 13 each,
#: and one of these has LEAST_SHARE again; so 25 equal words and 6 others are the most.
LONGEST = 31
#: Places of items up to which a hash is joined row by row, and places in a block beyond that.
FEW, PLACES = 8, 1024

_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a worker remembers.
REMEMBERED = 300_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_KNOWN = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word: runs of \\w in lower case."""
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """One hash for each window of the mask's span."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    for at in (i for i, c in enumerate(mask) if c == "1"):
        out *= _ODD  # words are hashes already, so that their sum by powers is mixed once
        out += words[at : at + n]
    out ^= out >> np.uint64(32)
    out *= _ODD
    out ^= out >> np.uint64(29)
    return out


def masks_of(item_words: int) -> tuple[str, ...]:
    """SEEDS, but an item shorter than LEAST_WORDS is taken whole."""
    return SEEDS if item_words >= LEAST_WORDS else ("1" * item_words,) if item_words else ()


def segments(same: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, end, equal words) of overlaps along a diagonal: the longest, of those the first, then again on either side of it.

    same: whether its words are equal. An overlap begins and ends with equal words, has `least` of them,
    and LEAST_SHARE of its length.
    """
    at, out = np.flatnonzero(same), []
    of, per = LEAST_SHARE
    open_runs = [(0, len(at))]
    while open_runs:
        lo, hi = open_runs.pop()
        if hi - lo < least:
            continue
        m, nth = at[lo:hi], np.arange(hi - lo)
        lowest = np.minimum.accumulate(per * nth - of * m)
        first = np.searchsorted(-lowest, -(per * (nth + 1) - of * (m + 1)))  # the farthest start that each end may have
        length = np.where(nth - first + 1 >= least, m - m[np.minimum(first, nth)] + 1, 0)
        j = int(np.argmax(length))
        if length[j]:
            i = int(first[j])
            out.append((int(m[i]), int(m[j]) + 1, j - i + 1))
            open_runs += [(lo, lo + i), (lo + j + 1, hi)]
    return sorted(out)


def overlaps(doc: np.ndarray, item: np.ndarray, diagonals: list[int]) -> list[tuple[int, int, int, int]]:
    """(doc_word, item_word, length, matched) of the places where two texts (word hashes) overlap, on these diagonals (place in the document less place in the item).

    Of overlaps that share words of the document, on different diagonals, the one with most equal words
    is given, then the first in the document, then in the item.
    """
    found, least = [], min(LEAST_WORDS, len(item))
    for d in diagonals:
        p, q = max(d, 0), max(-d, 0)
        n = min(len(doc) - p, len(item) - q)
        found += [(-m, p + s, q + s, e - s) for s, e, m in segments(doc[p : p + n] == item[q : q + n], least)]
    places, out = np.zeros(len(doc), bool), []
    for m, p, q, n in sorted(found):
        if not places[p : p + n].any():
            places[p : p + n] = True
            out.append((p, q, n, -m))
    return sorted(out)


#: Words before and after the start of a hit that an overlap of LONGEST words around it can have.
BEFORE, AFTER = LONGEST - min(map(len, SEEDS)), LONGEST


def around(words: np.ndarray, places: np.ndarray, beyond: int) -> np.ndarray:
    """The words around each place, a row each; `beyond` stands where the text has none."""
    padded = np.concatenate([np.full(BEFORE, beyond, np.uint64), words, np.full(AFTER, beyond, np.uint64)])
    return padded[np.asarray(places, np.int64)[:, None] + np.arange(BEFORE + AFTER)]


def promising(doc: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Which rows of `items` overlap with the row `doc` (words around places) by LEAST_WORDS, LEAST_SHARE and LONGEST words or fewer."""
    same = doc == items
    at = np.flatnonzero(same.sum(axis=1) >= LEAST_WORDS)
    counts = np.zeros((len(at), same.shape[1] + 1), np.int16)
    np.cumsum(same[at], axis=1, out=counts[:, 1:])
    found, (of, per) = np.zeros(len(at), bool), LEAST_SHARE
    for length in range(LEAST_WORDS, LONGEST + 1):
        least = max(LEAST_WORDS, -(-length * of // per))
        found |= (counts[:, length:] - counts[:, :-length] >= least).any(axis=1)
    return at[found]


# --- tables ----------------------------------------------------------------------------------


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, item_words, hs, ps, short): each item's word hashes, its seed hashes with their places, and its length if taken whole, else 0."""
    rows = benchmark.where("item_id is not null and text is not null").selectExpr("cast(item_id as long) item_id", "text").distinct()

    def work(batch: dict) -> dict:
        words = [word_hashes(t) for t in batch["text"]]
        seeds = [[seed_hashes(w, m) for m in masks_of(len(w))] for w in words]
        hs = [np.concatenate(x).view(np.int64) if x else [] for x in seeds]
        ps = [np.concatenate([np.arange(len(h)) for h in x]) if x else [] for x in seeds]
        short = [len(w) if len(w) < LEAST_WORDS else 0 for w in words]
        return {"item": batch["item"], "item_id": batch["item_id"], "item_words": [w.tobytes() for w in words], "hs": hs, "ps": ps, "short": short}

    ddl = "item long, item_id long, item_words binary, hs array<long>, ps array<int>, short int"
    return written(map_batches(rows.withColumn("item", F.xxhash64("item_id", "text")), work, ddl, 256), "items")


def _places(df: DataFrame, key: str, *more: str) -> DataFrame:
    """(key, h, p): a row for each seed hash of a text."""
    return df.select(key, *more, F.explode(F.arrays_zip("hs", "ps")).alias("s")).select(key, *more, F.col("s.hs").alias("h"), F.col("s.ps").alias("p"))


def _windows(texts: DataFrame, places: DataFrame, key: str, words: str, beyond: int) -> DataFrame:
    """(h, key, p, window): the words around each of the places (key, h, p) of the texts (key, words)."""
    own = places.groupBy(key).agg(F.collect_list("h").alias("hs"), F.collect_list("p").alias("ps"))  # a text's places at most
    rows = own.join(texts.select(key, words), key).select(F.col(key).alias("key"), "hs", "ps", F.col(words).alias("words"))

    def work(batch: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("h", "key", "p", "window")}
        for i, hs, ps, text in zip(*(batch[c] for c in ("key", "hs", "ps", "words")), strict=True):
            for c, v in zip(out, (hs, [i] * len(hs), ps, [w.tobytes() for w in around(np.frombuffer(text, "<u8"), ps, beyond)]), strict=True):
                out[c] += v
        return out

    return map_batches(rows, work, "h long, key long, p int, window binary", 64).withColumnRenamed("key", key)


def _met_in_blocks(scanned: DataFrame, hits: DataFrame, items: DataFrame, busy: DataFrame) -> DataFrame:
    """(doc, item, d) of hits (doc, h, p) with the busy places (item, h, q) whose surroundings overlap: blocks of documents by blocks of items."""
    counts = hits.groupBy("h").agg(F.count("*").alias("n_docs")).join(busy.groupBy("h").agg(F.count("*").alias("n_items")), "h")
    blocks = written(counts.select("h", F.ceil(F.col("n_docs") / PLACES).cast("int").alias("a_n"), F.ceil(F.col("n_items") / PLACES).cast("int").alias("b_n")), "busy")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = hits.join(blocks.select("h"), "h", "left_semi")
    left = _windows(scanned, own, "doc", "doc_words", 0).join(blocks, "h").withColumn("a", F.pmod(F.xxhash64("doc", "p"), F.col("a_n")).cast("int")).withColumn("b", upto("b_n"))
    right = _windows(items, busy.withColumnRenamed("q", "p"), "item", "item_words", 1).join(blocks, "h").withColumn("b", F.pmod(F.xxhash64("item", "p"), F.col("b_n")).cast("int")).withColumn("a", upto("a_n"))

    def meet(docs: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(docs) and len(those):
            table = np.frombuffer(b"".join(those["window"]), "<u8").reshape(len(those), -1)
            ids, places = those["item"].to_numpy(), those["p"].to_numpy()
            for window, own in docs.groupby("window", sort=False):  # equal surroundings are compared once
                at = promising(np.frombuffer(window, "<u8"), table)
                for doc, p in zip(own["doc"], own["p"], strict=True) if len(at) else ():
                    out += zip([doc] * len(at), ids[at], p - places[at], strict=True)
        return pd.DataFrame(out, columns=["doc", "item", "d"]).astype("int64").drop_duplicates()

    keys = ["h", "a", "b"]
    met = left.select(*keys, "doc", "p", "window").groupBy(*keys).cogroup(right.select(*keys, "item", "p", "window").groupBy(*keys))
    return met.applyInPandas(meet, "doc long, item long, d long")


def _filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter (64-bit words, its size as a power of 2) of seeds (h), by double hashing with a hash's halves. It has at most 2 ** (FILTER_MOST - 6) words."""
    n = seeds.count()
    bits = min(FILTER_MOST, max(FILTER_LEAST, (FILTER_BITS * n).bit_length()))
    first, step = F.shiftrightunsigned("h", 32), F.col("h").bitwiseAND(F.lit((1 << 32) - 1)).bitwiseOR(F.lit(1))
    slots = F.array(*[(first + step * n).bitwiseAND(F.lit((1 << bits) - 1)) for n in range(FILTER_SLOTS)])
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    found = seeds.select(F.explode(slots).alias("slot")).groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return table, bits


def _passing(h: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Where the hashes are that the filter lets through."""
    at = np.arange(len(h))
    for n in range(FILTER_SLOTS):
        slot = h >> np.uint64(32)
        if n:
            slot += np.uint64(n) * ((h & np.uint64((1 << 32) - 1)) | np.uint64(1))
        slot &= np.uint64((1 << bits) - 1)
        kept = np.flatnonzero(table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
        at, h = at[kept], h[kept]
    return at


def _scanned(docs: DataFrame, seeds: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(doc, doc_id, digest, doc_words, hs, ps) of the documents with a seed hash that the filter of `seeds` lets through: their words' hashes, and those seeds with their places; written."""
    table, bits = _filter(seeds.select("h").distinct())
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"), "text")

    def scan(batch: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("doc", "doc_id", "digest", "doc_words", "hs", "ps")}
        words = [word_hashes(t) for t in batch["text"]]
        seeds = [seed_hashes(w, m) for w in words for m in masks]
        together, begins = np.concatenate(seeds), np.cumsum([0, *map(len, seeds)])
        hits = _passing(together, shared.value, bits)
        places = hits - begins[np.searchsorted(begins, hits, "right") - 1]
        ends = np.searchsorted(hits, begins[:: len(masks)])
        for i in np.flatnonzero(np.diff(ends)):
            own = slice(ends[i], ends[i + 1])
            for c, v in zip(out, (batch["doc"][i], batch["doc_id"][i], batch["digest"][i], words[i].tobytes(), together[hits[own]].view(np.int64), places[own]), strict=True):
                out[c].append(v)
        return out

    return written(map_batches(rows.where("text is not null"), scan, "doc long, doc_id long, digest string, doc_words binary, hs array<long>, ps array<int>", 128), "scanned")


def _overlapping(docs: DataFrame, benchmark: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """`columns` of (doc_id, digest, item_id, doc_word, item_word, length, matched) of all rows of docs (doc_id, text), without repeats if only the digest (the text's MD5) is asked for; written."""
    with passing_tables(docs.sparkSession) as keep:
        items = _items(benchmark)
        seeds = _places(items, "item", "short").withColumnRenamed("p", "q")
        many = seeds.groupBy("h").agg((F.count("*") > FEW).alias("many"))
        seeds = written(seeds.join(many, "h").select("item", "h", "q", (F.col("many") & (F.col("short") == 0)).alias("busy")), "seeds")
        masks = (*SEEDS, *("1" * r["short"] for r in items.where("short > 0").select("short").distinct().collect()))  # of LEAST_WORDS - 1 lengths at most
        scanned = _scanned(docs, seeds, masks)
        hits = _places(scanned, "doc")
        met = hits.join(seeds.where("not busy"), "h").select("doc", "item", (F.col("p") - F.col("q")).cast("long").alias("d"))
        busy = seeds.where("busy").select("item", "h", "q")
        if not busy.isEmpty():
            met = met.unionByName(_met_in_blocks(scanned, hits, items, busy))
        pairs = met.groupBy("doc", "item").agg(F.sort_array(F.collect_set("d")).alias("ds"))  # of two texts' places at most
        both = pairs.join(scanned.drop("hs", "ps"), "doc").join(items.select("item", "item_id", "item_words"), "item")

        def verify(batch: dict) -> dict:
            found = []
            for doc_id, digest, item_id, a, b, ds in zip(*(batch[c] for c in ("doc_id", "digest", "item_id", "doc_words", "item_words", "ds")), strict=True):
                found += [(doc_id, digest, item_id, *o) for o in overlaps(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), ds)]
            return dict(zip(("doc_id", "digest", "item_id", "doc_word", "item_word", "length", "matched"), map(list, zip(*found, strict=True)) if found else [[]] * 7, strict=True))

        found = map_batches(both, verify, "doc_id long, digest string, item_id long, doc_word int, item_word int, length int, matched int", 64).select(*columns)
        return keep(found.distinct() if columns == ["digest"] else found, name)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each place where a document and a benchmark item overlap: doc_id, item_id, doc_word, item_word, length, matched.

    An overlap is an alignment without gaps of `length` words that begins and ends with equal words, with
    LEAST_SHARE of them equal and at least LEAST_WORDS (for shorter items: the whole item); see overlaps()
    for places that touch. Words are runs of \\\\w in lower case. Null and empty texts or items overlap with
    nothing; rows that repeat a doc_id give rows each, items that repeat an item_id with other texts too,
    with the same text once. An empty benchmark or table gives an empty result. Other columns are left out.
    """
    return _overlapping(docs, benchmark, "overlaps", ["doc_id", "item_id", "doc_word", "item_word", "length", "matched"])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text overlaps with no benchmark item, in the columns of docs; rows with a null doc_id are judged too."""
    found = _overlapping(docs, benchmark, "leaks", ["digest"]).withColumnRenamed("digest", "__digest")
    return docs.join(found, F.md5(docs["text"]) == found["__digest"], "left_anti")
