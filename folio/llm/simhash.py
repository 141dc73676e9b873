"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's bits are m ring-ordered segments. If two fingerprints differ in at most t bits, some
chain of consecutive segments has, at each of its lengths l, at most l * t / m differing bits in all
(the pigeonring principle). Pairs that share a key are put to that test before the full Hamming
distance is taken, whatever the number of rows that share the key: rows are dealt into blocks, each
block meets each, and a task compares two blocks in memory.

Two uses. `link_components` links 64-bit fingerprints at 2 or fewer differing bits; keys are a segment
with parts of the next one, which the principle itself gives, so that no pair is missed.
`near_duplicates` finds whole texts whose shingle sets have a Jaccard similarity of 0.8 or more; there a
segment is too seldom equal to be a key, so that keys are the least shingle hashes of a text, a pair's
512-bit fingerprints are tested, and what is left is decided on the texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_schema, map_arrow, map_batches, passing_tables, written
from .suffix_repeats import window_hashes

SEED = 42
#: Rows in a block of a group, or weight: a set of SET_WEIGHT hashes or fewer weighs as one row, a larger one in proportion.
BLOCK, SET_WEIGHT = 1024, 512
_LANES = np.uint64(0x0101010101010101)


def bit_counts(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each group of values (uint64, split at starts): how many have each of the 64 bits set.

    Eight lanes are summed per 64-bit addition, over at most 255 values at once.
    """
    ends = np.append(starts[1:], len(values))
    pieces = [np.arange(s, e, 255) for s, e in zip(starts, ends, strict=True)]
    first = np.concatenate(pieces)
    group_at = np.cumsum([0, *(len(p) for p in pieces[:-1])])
    counts = np.empty((len(starts), 64), np.int64)
    for shift in range(8):
        lanes = np.add.reduceat((values >> np.uint64(shift)) & _LANES, first).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts[:, shift::8] = np.add.reduceat(lanes.astype(np.int64), group_at, axis=0)
    return counts


def _majority(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    ends = np.append(starts[1:], len(values))
    bits = 2 * bit_counts(values, starts) > (ends - starts)[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def shingles(text: str, width: int) -> list[bytes]:
    """Space-joined runs of `width` words of the text with A-Z in lower case; a shorter text is one shingle."""
    words = text.encode().lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False)))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): a 64-bit SimHash as long, of XXH64 (seed 42) over shingles; no words: 0."""

    def work(rows: dict) -> dict:
        hashes = [np.fromiter(map(xxhash.xxh64_intdigest, s, repeat(SEED)), np.uint64, len(s)) for s in (shingles(t or "", width) for t in rows["t"])]
        fps = np.zeros(len(hashes), np.uint64)
        full = [i for i, h in enumerate(hashes) if len(h)]
        if full:
            starts = np.cumsum([0, *(len(hashes[i]) for i in full[:-1])])
            fps[full] = _majority(np.concatenate([hashes[i] for i in full]), starts)
        return {id_col: rows["i"], "fp": fps.view(np.int64)}

    return map_batches(docs.selectExpr(f"cast({id_col} as long) i", f"{text_col} t"), work, f"{id_col} long, fp long", 256)


# --- pigeonring ------------------------------------------------------------------------------


def chain_holds(parts: np.ndarray, distance: int) -> np.ndarray:
    """parts (pairs, m): differing bits by segment. Whether some chain stays within the proportional budget at each length below m."""
    m = parts.shape[1]
    total, alive = np.zeros_like(parts), np.ones(parts.shape, bool)
    for length in range(1, m):
        total += np.roll(parts, 1 - length, axis=1)
        alive &= m * total <= length * distance
    return alive.any(axis=1)


def alike(a: np.ndarray, b: np.ndarray, distance: int, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): which rows of a and b (words of fingerprints) are within that distance.

    masks (m, words): the segments in ring order. Pairs without a segment within its own budget go
    first, then those without a chain; the others' whole distance is taken.
    """
    m, rows = len(masks), max(1, (1 << 17) // max(1, len(b)))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo in range(0, len(a), rows):
        diff = a[lo : lo + rows, None, :] ^ b[None, :, :]
        parts = np.stack([np.bitwise_count(diff[:, :, used] & mask[used]).sum(2, dtype=np.int16) for mask in masks for used in [np.flatnonzero(mask)]], 2)
        i, j = np.nonzero(m * parts.min(2) <= distance)
        parts = parts[i, j]
        kept = np.flatnonzero(chain_holds(parts, distance))
        kept = kept[parts[kept].sum(1) <= distance]
        found.append((i[kept] + lo, j[kept]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs (i, j) of n rows suffice to connect what all of them connect."""
    root, kept = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        if (x := find(x)) != (y := find(y)):
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, np.int64)


def links_within_groups(members: DataFrame, keys: list[str], decide: Callable[[list[bytes], list[bytes]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b), a < b, distinct: links between rows of one group and of different c, enough to connect all that `decide` links.

    members: keys, id, c, data, and weight (of a row; see BLOCK). decide gets the data of two lists of rows
    and gives the positions of linked ones. A group is dealt into blocks, and each block meets each, in tasks
    of their own; blocks of the group's heaviest c, whose rows need no links among themselves, meet only
    those of the others. A task gives a spanning forest of its links.
    """
    apart = members.groupBy(*keys, "c").agg(F.sum("weight").alias("w")).groupBy(*keys)
    apart = apart.agg(F.sum("w").alias("all"), F.max(F.struct("w", "c")).alias("top"), F.count("*").alias("n_parts")).where("n_parts > 1")
    large = F.col("top.w") > BLOCK
    sizes = apart.select(*keys, F.when(large, F.col("top.c")).alias("major"), F.ceil(F.when(large, F.col("top.w")).otherwise(0) / BLOCK).cast("long").alias("n_major"),
                         F.ceil((F.col("all") - F.when(large, F.col("top.w")).otherwise(0)) / BLOCK).cast("long").alias("n_minor"))
    dealt = members.join(written(sizes, "apart"), keys)
    in_major = F.coalesce(F.col("c") == F.col("major"), F.lit(False))
    block = F.when(in_major, F.pmod(F.xxhash64("id"), F.greatest(F.col("n_major"), F.lit(1)))).otherwise(F.col("n_major") + F.pmod(F.xxhash64("id"), F.greatest(F.col("n_minor"), F.lit(1))))
    others = F.sequence(F.when(in_major, F.col("n_major")).otherwise(F.lit(0).cast("long")), F.col("n_major") + F.col("n_minor") - 1)
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(others))
    met = dealt.groupBy(*keys, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).agg(F.collect_list(F.struct("id", "c", "block", "data")).alias("r"))
    met = met.select("x", "y", *[F.col("r")[f].alias(f) for f in ("id", "c", "block", "data")])

    def work(rows: dict) -> dict:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y, i, c, block, data in zip(*(rows[f] for f in ("x", "y", "id", "c", "block", "data")), strict=True):
            i, c, block = (np.array(v, np.int64) for v in (i, c, block))
            own, met_by = (np.flatnonzero(block == x), np.flatnonzero(block == y)) if x < y else (np.arange(len(i)),) * 2
            p, q = decide([data[k] for k in own], [data[k] for k in met_by])
            p, q = own[p], met_by[q]
            kept = (c[p] != c[q]) & ((i[p] < i[q]) | (x < y))
            p, q = p[kept], q[kept]
            kept = _forest(p, q, len(i))
            a.append(np.minimum(i[p], i[q])[kept])
            b.append(np.maximum(i[p], i[q])[kept])
        return {"a": np.concatenate(a), "b": np.concatenate(b)}

    return map_batches(met, work, "a long, b long", 64).where("a < b").distinct()


def within(distance: int, masks: np.ndarray) -> Callable[[list[bytes], list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Links fingerprints (little-endian words) by alike()."""
    words = lambda x: np.frombuffer(b"".join(x), "<u8").reshape(-1, masks.shape[1])
    return lambda a, b: alike(words(a), words(b), distance, masks)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the least node that each node of edges (a, b) reaches.

    Large-star and small-star rounds, each written to the shared folder, until the edges are stars.
    """
    edges = written(edges.select("a", "b"), name)
    while True:
        with passing_tables(edges.sparkSession) as keep:
            both = edges.union(edges.select(F.col("b"), F.col("a")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
            large = both.join(least, "a").where("b > a").select(F.col("m").alias("x"), F.col("b").alias("y")).where("x < y").distinct()
            down = written(large.select(F.col("y").alias("a"), F.col("x").alias("b")), name)  # each node with its smaller neighbours
            least = down.groupBy("a").agg(F.min("b").alias("m"))
            small = down.join(least, "a").select("m", F.col("b").alias("y")).where("m < y").union(least.select("m", F.col("a")))
            new = keep(small.toDF("a", "b").distinct(), name)
        # done when nobody has two smaller neighbours and no root is itself a leaf
        leaves = new.groupBy("b").agg(F.count("*").alias("n"))
        if leaves.where("n > 1").isEmpty() and new.join(leaves.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            roots = new.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            return roots.union(new.select("b", "a"))
        edges = new


# --- fingerprints at distance 2 or less ------------------------------------------------------

DISTANCE = 2
#: The ring's segments of a 64-bit fingerprint as (lowest bit, width).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Rows of one key, on average, that keys are chosen for.
GROUP = 4


def _mask(low: int, width: int) -> int:
    return ((1 << width) - 1) << low


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def ring_keys(count: int = 0) -> list[int]:
    """Key masks that bring every pair at distance 2 together.

    A chain's first segment is equal and the first two differ in one bit at most, so that all parts of the
    second but one are equal too: a key is a segment with the next one less a part. The number of parts
    is the least by which `count` fingerprints have GROUP rows of a key on average, if they are spread evenly.
    """
    bits = lambda parts: 43 - math.ceil(21 / parts)
    parts = next((p for p in range(2, 21) if count >> bits(p) <= GROUP), 21)
    out = []
    for i, first in enumerate(SEGMENTS):
        low, width = SEGMENTS[(i + 1) % 3]
        cuts = [low + width * k // parts for k in range(parts + 1)]
        out += [_mask(*first) | (_mask(low, width) & ~_mask(s, e - s)) for s, e in zip(cuts, cuts[1:], strict=False)]
    return out


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) over the distinct values `fp` that connect all pairs at Hamming distance 2 or less."""
    masks = ring_keys(fps.count())
    keys = F.array(*[F.struct(F.lit(n).cast("byte").alias("n"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for n, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.n", "k.v")
    groups = written(keyed.groupBy("n", "v").agg(F.count("*").alias("size")).where("size > 1").select("n", "v"), "groups")  # joined as a table, so that a key of many rows can be split
    members = keyed.join(groups, ["n", "v"]).select("n", "v", F.col("fp").alias("id"), F.col("fp").alias("c"), _little_endian("fp").alias("data"), F.lit(1.0).alias("weight"))
    return links_within_groups(written(members, "members"), ["n", "v"], within(DISTANCE, np.array([[_mask(*s)] for s in SEGMENTS], np.uint64)))


def _little_endian(name: str):
    """A long column's eight bytes, the lowest first."""
    hexed = F.lpad(F.hex(name), 16, "0")
    return F.unhex(F.concat(*[F.substring(hexed, k, 2) for k in range(15, 0, -2)]))


def link_components(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, fingerprint (16 hex digits) and component_id, the least id it reaches by links.

    Fingerprints link at 2 or fewer differing bits. Null and empty texts have fingerprint zero and link
    like others. A null id gets its component, but is never one's least id unless the component has no
    other. Repeated rows stay and share a component. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    with passing_tables(docs.sparkSession) as keep:
        classes = written(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
        found = components(links(classes.select("fp")))
        known = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
        least = known.groupBy("c").agg(F.min("least").alias("component_id"))
        known = keep(known.join(least, "c").select(F.col("fp").alias("f"), "component_id"), "known")
    return fps.join(known, fps["fp"] == F.col("f")).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies of whole texts at a Jaccard similarity --------------------------------------

#: 64-bit words of a long fingerprint, each a segment of the ring.
WORDS = 8
#: Standard deviations by which the distance allowed exceeds the mean at the least similarity: about one pair in a million is above.
DEVIATIONS = 4.75
#: The chance that two texts of the least similarity share no key.
MISSED = 1e-9
#: Least hashes of each text that are counted; those of more than LATE_FROM texts come last among keys, LATE_HELD of them at most.
COUNTED, LATE_FROM, LATE_HELD = 32, 32, 100_000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The set of the hashes of shingles(), ascending, from one XXH64 a word."""
    words = (text or "").encode().lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    return np.unique(window_hashes(h, min(width, len(h)))) if len(h) else h


def allowed_distance(similarity: float, bits: int = 64 * WORDS) -> int:
    """Differing bits of long fingerprints up to which sets may be that similar.

    A bit differs with probability angle / pi; the angle of sets of that Jaccard similarity is widest for
    sets of equal size, whose cosine is 2 * similarity / (1 + similarity).
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))


def _words(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Long fingerprints (sets, WORDS) of the sets of hashes that begin at starts."""
    out = np.empty((len(starts), WORDS), np.uint64)
    for k in range(WORDS):
        x = (h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = _majority(x ^ (x >> np.uint64(32)), starts)
    return out


def late_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Hashes that are among the COUNTED least of more than LATE_FROM texts of docs (text), ascending; the most frequent LATE_HELD.

    They only set an order of keys. All texts count; the bound is on what reaches the driver.
    """
    work = lambda rows: {"h": np.concatenate([shingle_hashes(t, width)[:COUNTED] for t in rows["text"]]).view(np.int64)}
    counts = map_batches(docs.select("text"), work, "h long", 256).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > LATE_FROM)
    return np.sort(np.array([r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(LATE_HELD).collect()], np.int64).view(np.uint64))


def key_count(n: int, late: int, similarity: float) -> int:
    """How many of a set's n hashes, late ones last, are keys, so that similar sets share one.

    Of the hashes of either set that are not late, at most a share (1 - similarity) * n / (n - late) is in
    one set alone, and hashes stand in random order: that the first k are all such has at most that share's
    k-th power as its chance. Where late ones leave too few, one of the first n - ceil(similarity * n) + 1 is
    shared in any order.
    """
    certain = n - math.ceil(similarity * n - 1e-9) + 1
    share = (1 - similarity) * n / (n - late) if late < n else 1.0
    return certain if share >= 1 else min(certain, math.ceil(math.log(MISSED) / math.log(share)))


def sketches(docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """(id, d0, d1, fp, keys) of each row of docs (id, text): a digest of its set of shingles, its long fingerprint, its keys. No words: no keys."""
    late = late_shingles(docs, width)
    ddl = "id long, d0 long, d1 long, fp binary, keys array<long>"

    def work(rows: dict) -> dict:
        sets = [shingle_hashes(t, width) for t in rows["text"]]
        digests = np.frombuffer(b"".join(xxhash.xxh128_digest(h.tobytes()) for h in sets), "<i8").reshape(-1, 2)
        fps, full = np.zeros((len(sets), WORDS), np.uint64), [i for i, h in enumerate(sets) if len(h)]
        if full:
            fps[full] = _words(np.concatenate([sets[i] for i in full]), np.cumsum([0, *(len(sets[i]) for i in full[:-1])]))
        keys = []
        for h in sets:
            later = np.isin(h, late, assume_unique=True) if len(late) else np.zeros(len(h), bool)
            k = key_count(len(h), int(later.sum()), similarity) if len(h) else 0
            keys.append(np.concatenate([h[~later], h[later]])[:k].view(np.int64))
        return {"id": rows["id"], "d0": digests[:, 0], "d1": digests[:, 1], "fp": [x.tobytes() for x in fps], "keys": keys}

    return map_batches(docs.select("id", "text"), work, ddl, 256)


def _near_pivots(members: DataFrame, distance: int) -> DataFrame:
    """(a, b), a < b, distinct: each member with the pivot of its key, a member chosen by hash, if within that distance."""
    pivots = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "id").alias("x"), "id", "fp")).alias("p"))
    pivots = written(pivots.select("key", F.col("p.id").alias("pivot"), F.col("p.fp").alias("pivot_fp")), "pivots")
    met = members.join(pivots, "key").where("id <> pivot").select("id", "pivot", "fp", "pivot_fp")
    schema = arrow_schema("a long, b long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, p = (batch.column(k).to_numpy() for k in (0, 1))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u8").reshape(-1, WORDS) for k in (2, 3))
            parts = np.bitwise_count(x ^ y).astype(np.int16)
            near = chain_holds(parts, distance) & (parts.sum(1) <= distance)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, p)[near]), pa.array(np.maximum(i, p)[near])], schema=schema)

    return map_arrow(met, work, "a long, b long").distinct()


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.select("id", "text").join(written(ids, "involved"), "id")


def _decided(docs: DataFrame, pairs: DataFrame, similarity: float, width: int) -> DataFrame:
    """(a, b) of the pairs (a, b) whose whole texts have that similarity."""
    involved = written(_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "texts")
    both = pairs.join(involved.toDF("a", "ta"), "a").join(involved.toDF("b", "tb"), "b")

    def work(rows: dict) -> dict:
        alike = []
        for a, b in zip(rows["ta"], rows["tb"], strict=True):
            x, y = set(shingles(a or "", width)), set(shingles(b or "", width))
            alike.append(len(x & y) >= similarity * max(1, len(x | y)))
        return {c: [v for v, kept in zip(rows[c], alike, strict=True) if kept] for c in ("a", "b")}

    return map_batches(both, work, "a long, b long", 64)


def similar_sets(similarity: float) -> Callable[[list[bytes], list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Links sets of hashes (ascending, as bytes) of that Jaccard similarity: an index of one side's hashes counts what each set of the other shares."""

    def decide(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(x, "<u8") for x in b]
        sizes = np.array([len(x) for x in sets])
        hashes = np.concatenate(sets)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], np.repeat(np.arange(len(b), dtype=np.int32), sizes)[order]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for n, x in enumerate(a):
            own = np.frombuffer(x, "<u8")
            low, high = (np.searchsorted(hashes, own, side) for side in ("left", "right"))
            each = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
            shared = np.bincount(owner[at], minlength=len(b))
            q = np.flatnonzero(shared >= similarity * np.maximum(1, len(own) + sizes - shared))
            found.append((np.full(len(q), n), q))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return decide


def _linked_in_families(docs: DataFrame, families: DataFrame, similarity: float, width: int) -> DataFrame:
    """(a, b): links of that similarity between rows (id, family, c) of one family and of different c."""
    ddl = "id long, family long, c long, data binary, weight double"

    def work(rows: dict) -> dict:
        sets = [shingle_hashes(t, width) for t in rows["text"]]
        return {f: rows[f] for f in ("id", "family", "c")} | {"data": [h.tobytes() for h in sets], "weight": [max(1.0, len(h) / SET_WEIGHT) for h in sets]}

    sets = written(map_batches(_texts(docs, families).select("id", "text", "family", "c"), work, ddl, 256), "sets")
    return links_within_groups(sets, ["family"], similar_sets(similarity))


def similar_links(docs: DataFrame, found: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """Links (a, b), a < b, that connect all rows of docs (id, text) with keys in `found` (sketches()) and that Jaccard similarity.

    Two such rows share a key but for a chance of MISSED, and their fingerprints are within
    allowed_distance() but for about one pair in a million at the least similarity itself, hardly any above.
    Each row meets the pivots of its keys first, so that a large group of copies takes some pairs of texts
    for each row. Rows of a key that these links leave apart then all meet each other by their fingerprints;
    those within the distance are a family, whose sets of shingles (64-bit hashes) meet in the same way.
    Only a family of many rows that are neither copies nor far apart takes work in the square of its size.
    """
    with passing_tables(docs.sparkSession) as keep:
        linked, families = _near_families(docs, found, similarity, width, keep)
    return linked.union(_linked_in_families(docs, families, similarity, width))


def _near_families(docs: DataFrame, found: DataFrame, similarity: float, width: int, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(a, b) of rows linked by their keys' pivots, and (id, family, c) of the rows that these leave to be compared."""
    distance = allowed_distance(similarity)
    entries = found.select("id", F.explode("keys").alias("key"))
    groups = written(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"), "groups")
    slim = written(entries.join(groups, "key"), "slim")
    members = written(slim.join(found.select("id", "fp"), "id"), "members")
    linked = keep(_decided(docs, written(_near_pivots(members, distance), "first"), similarity, width), "linked")
    known = written(components(linked, "linked"), "known").toDF("id", "component")
    live = members.join(known, "id", "left").select("key", "id", F.col("fp").alias("data"), F.coalesce("component", "id").alias("c"), F.lit(1.0).alias("weight"))
    near = links_within_groups(written(live, "live"), ["key"], within(distance, np.diag(np.full(WORDS, ~np.uint64(0)))))
    families = written(components(near, "families"), "families").toDF("id", "family")
    families = families.join(known, "id", "left").select("id", "family", F.coalesce("component", "id").alias("c"))
    return linked, keep(families, "families")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """(id) of docs (id, text) that go: all but the least id of each group of copies.

    Texts with equal sets of shingles are copies (so are all texts without words, null among them); others
    are linked by similar_links(). Null ids take no part; ids are not to repeat. An empty table gives an
    empty result.
    """
    docs = docs.where("id is not null")
    found = written(sketches(docs, similarity, width), "sketches")
    classes = written(found.groupBy("d0", "d1").agg(F.min("id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("id"))
    copies = found.select("id").join(reps, "id", "left_anti")
    links = similar_links(docs, written(found.join(reps, "id", "left_semi"), "reps"), similarity, width)
    return copies.union(components(links, "near").where("node <> component").select("node"))


def without_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """docs (doc_id, text, ...) with one row of each group of copies, the one of least doc_id, in the columns of docs.

    Of rows that repeat a doc_id the one of least text counts, null last, and can stay. Rows with a null
    doc_id all stay. Empty and null texts are copies of each other. An empty table gives an empty result.
    """
    again = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    one = docs.join(again, "doc_id", "left_semi").withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)
    once = docs.join(again, "doc_id", "left_anti").select(*docs.columns).union(one)
    with passing_tables(docs.sparkSession) as keep:
        dropped = near_duplicates(once.select(F.col("doc_id").cast("long").alias("id"), "text"), similarity, width)
        dropped = keep(dropped.select(F.col("id").alias("doc_id")), "dropped")
    return once.join(dropped, "doc_id", "left_anti").select(*docs.columns)
