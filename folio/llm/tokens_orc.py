"""Token ids in ORC files.

ORC stores the ids of a stripe with its integer run-length encoding, keeps a row index for every
ROW_STRIDE documents and a Bloom filter on doc_id, and readers take stripes in parallel and skip
those whose statistics or filters exclude the ids asked for. Documents are dealt by ranges of doc_id
and written in that order, so that the statistics are narrow; tokens are made after that shuffle,
while writing, so that only texts are moved.

Where a vocabulary's own splitting never joins text across white space and ignores case (BY_WORDS),
tokenizing splits at ASCII white space first and remembers the ids of words, which changes no id; with
any other vocabulary whole texts go to the library.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_schema, map_arrow, shared_dir

VOCABULARY, END_ID = "word_bpe_49k.json", 2
ROW_STRIDE, STRIPE_BYTES, BLOOM_FPP = 1_000, 16 << 20, 0.01
#: Words remembered in either generation by a Python worker, and those that one library call encodes.
REMEMBERED, TOGETHER = 400_000, 512

#: Columns of the files.
TABLE = "doc_id long, part int, nth long, start long, n long, ids array<int>"

# A full stop or comma between a letter or digit and white space is a piece of its own in any case.
_MARK = re.compile(rb"[.,](?=[\x20\x09-\x0D]|\Z)(?:(?<=[a-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")
# Words of small letters alone (a-z, ß-ÿ) are one piece to the vocabulary; its last token alone ends a word.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


# The parts of a tokenizers file by which texts may be encoded word by word, with the marks and letters above.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}


class TextTokenizer:
    """Ids of whole texts by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.inner.encode_batch_fast([t], add_special_tokens=False)[0].ids, "<u4").tobytes() for t in texts]


class WordTokenizer:
    """Ids (little-endian unsigned 32-bit) of whole texts, equal to the tokenizers library's own.

    New words go to the library together: words of letters joined by spaces, whose ids are parted after
    each token that ends a word, others joined by a special token. Of remembered words the generation
    last used stays.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        special = self.inner.get_added_tokens_decoder()
        self.parting, self.specials = max(special), tuple(t.content.encode() for t in special.values())
        self.parting_text = special[self.parting].content
        vocabulary = self.inner.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[n for t, n in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def pieces(self, text: str) -> list[bytes]:
        raw = text.encode()
        if any(x in raw for x in self.specials):
            return raw.split()
        low = raw.lower()
        return (_MARK.sub(rb" \g<0>", low) if not any(x in low for x in self.specials) else raw).split()

    def _learn(self, words: list[bytes]) -> None:
        if len(self.known) + len(words) > self.remembered:
            self.known, self.older = {}, self.known
        plain, rest = [], []
        for w in words:
            (plain if _LETTERS.fullmatch(w) else rest).append(w)
        for lo in range(0, len(plain), TOGETHER):
            some = plain[lo : lo + TOGETHER]
            ids = self._ids(b" ".join(some).decode())
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            self._keep(some, ids, np.concatenate([[0], ends[:-1]]), ends)
        for lo in range(0, len(rest), TOGETHER):
            some = rest[lo : lo + TOGETHER]
            ids = self._ids(self.parting_text.join(w.decode() for w in some))
            ends = np.flatnonzero(ids == self.parting)
            if len(ends) == len(some) - 1:
                self._keep(some, ids, np.concatenate([[0], ends + 1]), np.append(ends, len(ids)))
            else:  # a special token among the words
                self.known |= {w: self._ids(w.decode()).tobytes() for w in some}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.inner.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _keep(self, words: list[bytes], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        spans = map(slice, (4 * starts).tolist(), (4 * ends).tolist())
        self.known.update(zip(words, map(ids.tobytes().__getitem__, spans), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces(t) for t in texts]
        words, known = set().union(*split), self.known
        missing = words.difference(known)
        again = {w: x for w in missing if (x := self.older.get(w)) is not None}
        new = list(missing.difference(again))
        if len(known) + len(missing) > self.remembered:
            again |= {w: known[w] for w in words if w in known}
        self._learn(new)
        self.known |= again
        return [b"".join(map(self.known.__getitem__, ws)) for ws in split]


_OPEN: dict[tuple[str, int], TextTokenizer | WordTokenizer] = {}


def by_words(path: str) -> bool:
    """Whether WordTokenizer gives the library's own ids for the file: its parts are BY_WORDS, it marks ends of words, and it has special tokens alone."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    special = all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in parts["added_tokens"])
    suffix = parts["model"].get("end_of_word_suffix") == "</w>" and not parts["model"].get("ignore_merges")
    return bool(parts["added_tokens"]) and special and suffix and all(parts.get(k) == v for k, v in BY_WORDS.items())


def open_tokenizer(path: str, remembered: int = REMEMBERED) -> TextTokenizer | WordTokenizer:
    """One per Python worker, which Spark uses for many tasks."""
    key = (path, remembered)
    if key not in _OPEN:
        _OPEN[key] = WordTokenizer(path, remembered) if by_words(path) else TextTokenizer(path)
    return _OPEN[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, remembered: int = REMEMBERED) -> None:
    """Writes docs (doc_id, text) as ORC: doc_id, part, nth, start, n, ids (n of them).

    vocabulary: a file that each executor can open; the default is looked up there. part: the task's number, ascending with doc_id; nth and start: documents and ids before it in the
    part. Equal doc_ids are in order of their texts' hashes; null ids come first.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("x")]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("x", F.xxhash64("text"))
    ddl = TABLE
    schema = arrow_schema(ddl)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, nth, start = open_tokenizer(vocabulary or default_vocabulary(), remembered), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                piece = batch.slice(lo, 512)
                raw = [r + end for r in tokenizer.encode(piece.column(1).to_pylist())]
                sizes = np.array([len(r) // 4 for r in raw], np.int64)
                before = np.concatenate([[0], np.cumsum(sizes)])
                ids = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.full(len(raw), part), pa.int32()), pa.array(np.arange(nth, nth + len(raw)), pa.int64()), pa.array(start + before[:-1], pa.int64()), pa.array(sizes), ids],
                    schema=schema,
                )
                nth, start = nth + len(raw), start + int(before[-1])

    sorted_docs = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    (
        map_arrow(sorted_docs, encode, ddl)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .option("orc.row.index.stride", str(ROW_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .orc(folder)
    )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The files' rows; a filter on doc_id prunes files, stripes and row groups by their metadata."""
    return spark.read.schema(TABLE).orc(folder)


def token_table(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read from the files.

    A part's offset is the sum of the parts before it: the window sees one row per part.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(flat[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "start", "n_tokens", "ids_crc32"],
            )

    rows = map_arrow(read_tokens(spark, folder).select("doc_id", "part", "start", "ids"), digest, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    sizes = read_tokens(spark, folder).groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, F.col("part") == F.col("p")).select("doc_id", (F.col("offset") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, vocabulary: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Writes every whole text of docs as ORC in the shared folder and returns token_table() of the files.

    Null and empty texts have the end id alone. Repeated rows are documents each. An empty table gives
    an empty result. Other columns are left out. vocabulary: a tokenizers file that each executor can open.
    remembered: words whose ids a worker keeps at hand, twice over; it sets memory and speed, never results.
    """
    folder = shared_dir(docs.sparkSession, "tokens")
    write_tokens(docs, folder, vocabulary, remembered=remembered)
    return token_table(docs.sparkSession, folder)
