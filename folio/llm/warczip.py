"""WARC records in ZIP packages, read by ranges.

Each writing task packs its rows into ZIP archives whose members are stored, not deflated:
`archive/data.warc.gz` (one gzip member per record, as WARC files have it) and `indexes/index.cdx`
(one line per record: offset and length in the first). A reader parses the ZIP's central directory
(ZIP64 too), finds both members' places, reads the index, and then reads single records by range;
nothing is unpacked.

Archives are named by partition and attempt, and a manifest table, written by Spark's own commit
protocol, lists those of the attempts that succeeded. Files go through pyarrow.fs, so a folder may
be on any store that it knows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Payloads below this size are never revisits.
LEAST_REVISIT = 100
#: Records in one archive, and index lines in one reading task's block.
ARCHIVE_RECORDS, BLOCK_RECORDS = 50_000, 500
#: Archives whose directories one task parses, and records that one task fetches, on average. Rows of
#: the index are small and their records are not, so the number of tasks is set here, not by bytes.
TASK_ARCHIVES, TASK_RECORDS = 4, 4_000
#: Ranges of one block that lie closer than this are fetched by one read of at most READ_BYTES.
READ_BYTES = 8 << 20

# --- writing ---------------------------------------------------------------------------------


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP head alone, with the full payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archive(uri: str, rows: Iterable[tuple]) -> int:
    """rows: (page_id, url, html, digest, refers_to, revisit). Streams; only index lines are held. Returns the records."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    index, at = [], 0
    with store.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
        with package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
            for page_id, url, html, digest, refers_to, revisit in rows:
                packed = _gzip(warc_record(page_id, url, (html or "").encode(), digest, refers_to, revisit))
                member.write(packed)
                index.append(json.dumps({"id": page_id, "offset": at, "length": len(packed)}))
                at += len(packed)
        package.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
    return len(index)


def write_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html, digest, refers_to, revisit); returns the manifest (uri, records)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        names = (f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.wacz" for n in range(1 << 30))
        rows = (r for b in batches for r in b.astype({"page_id": "object", "refers_to": "object"}).itertuples(index=False, name=None))
        rows = ((None if pd.isna(i) else int(i), u, h, d, None if pd.isna(t) else int(t), bool(v)) for i, u, h, d, t, v in rows)
        for first in rows:
            uri = next(names)
            yield pd.DataFrame({"uri": [uri], "records": [write_archive(uri, _some(first, rows, ARCHIVE_RECORDS))]})

    return written(pages.select("page_id", "url", "html", "digest", "refers_to", "revisit").mapInPandas(pack, "uri string, records long"), "manifest")


def _some(first: tuple, rest: Iterator[tuple], most: int) -> Iterator[tuple]:
    yield first
    for n, row in enumerate(rest, 2):
        yield row
        if n >= most:
            return


# --- reading ---------------------------------------------------------------------------------


def central_directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (local header's offset, length, method) from the archive's end; ZIP64 records where present."""
    tail_at = max(0, size - 65_557)
    tail = _range(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory")
    entries, length, offset = struct.unpack_from("<HII", tail, end + 10)
    locator = tail_at + end - 20
    if locator >= 0 and (raw := _range(file, locator, 20))[:4] == b"PK\6\7":
        record = _range(file, struct.unpack_from("<Q", raw, 8)[0], 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("bad ZIP64 end of central directory")
        entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    raw, at, found = _range(file, offset, length), 0, {}
    for _ in range(entries):
        if raw[at : at + 4] != b"PK\1\2":
            raise ValueError("bad central directory entry")
        method, packed, plain, n_name, n_extra, n_note, start = struct.unpack_from("<10xH8xIIHHH8xI", raw, at)
        name = raw[at + 46 : at + 46 + n_name].decode()
        extra, p = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while p + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, p)
            if kind == 1:  # 8-byte values, in this order, of those that the entry marks as too large
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, p + 4))
                plain, packed, start = (next(wide) if x == 0xFFFFFFFF else x for x in (plain, packed, start))
            p += 4 + n
        found[name] = (start, packed, method)
        at += 46 + n_name + n_extra + n_note
    return found


def stored_member(file, entry: tuple[int, int, int]) -> tuple[int, int]:
    """(offset, length) of a stored member's bytes in the archive."""
    start, length, method = entry
    if method:
        raise ValueError("the member is not stored")
    head = _range(file, start, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError("bad local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return start + 30 + n_name + n_extra, length


def _range(file, at: int, length: int) -> bytes:
    data = file.read_at(length, at)
    if len(data) != length:
        raise ValueError(f"the archive ends within {length} bytes at {at}")
    return data


def read_index(manifest: DataFrame) -> DataFrame:
    """(uri, block, offset, length) of every record: absolute ranges, taken from the archives' own directories."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for uri in (u for b in batches for u in b["uri"]):
            store, path = fs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as file:
                members = central_directory(file, file.size())
                data_at, _ = stored_member(file, members[DATA])
                index_at, index_length = stored_member(file, members[INDEX])
                lines = [json.loads(x) for x in _range(file, index_at, index_length).decode().splitlines()]
            for n in range(0, len(lines), BLOCK_RECORDS):
                some = lines[n : n + BLOCK_RECORDS]
                yield pd.DataFrame({"uri": uri, "block": n // BLOCK_RECORDS, "offset": [data_at + x["offset"] for x in some], "length": [x["length"] for x in some]})

    tasks = -(-manifest.count() // TASK_ARCHIVES) or 1
    return manifest.select("uri").repartition(tasks, "uri").mapInPandas(scan, "uri string, block long, offset long, length long")


def parse_record(packed: bytes) -> dict:
    """The fields of one gzipped record; a response's digest is taken anew and must agree with its header."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: payload and digest differ")
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    return {
        "page_id": int(page) if page else None,
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields["WARC-Refers-To"][len("<urn:page:") : -1]) if revisit else None,
        "payload": None if revisit else payload.decode(),
    }


def read_records(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives, read by range; payload (text, null for revisits) on request."""
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload string" * payloads

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, ranges in batch.groupby("uri", sort=False):
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as file:
                    for some in _together(list(zip(ranges["offset"], ranges["length"], strict=True))):
                        base = some[0][0]
                        raw = _range(file, base, some[-1][0] + some[-1][1] - base)
                        found = pd.DataFrame([parse_record(raw[o - base : o - base + n]) for o, n in some], columns=columns)
                        yield found.astype({"page_id": "Int64", "refers_to": "Int64"})

    tasks = -(-(manifest.agg(F.sum("records")).first()[0] or 0) // TASK_RECORDS) or 1
    index = read_index(manifest).repartition(tasks, "uri", "block").sortWithinPartitions("uri", "offset")
    return index.mapInPandas(fetch, ddl)


def _together(ranges: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Runs of adjacent ranges of at most READ_BYTES (or one record)."""
    some: list[tuple[int, int]] = []
    for o, n in ranges:
        if some and (o != some[-1][0] + some[-1][1] or o + n - some[0][0] > READ_BYTES):
            yield some
            some = []
        some.append((o, n))
    if some:
        yield some


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to, revisit: of equal payloads of LEAST_REVISIT bytes or more, the least page_id is kept.

    Only digests and ids are shuffled for that, and only groups of two or more come back to the pages.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    large = pages.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "copied")  # joined as a table, so that a digest of many pages can be split
    revisits = large.join(first, "digest").where("page_id is distinct from refers_to and refers_to is not null").distinct()
    revisits = revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    found = pages.join(revisits, pages["page_id"].eqNullSafe(F.col("p")) & (pages["digest"] == F.col("d")), "left")
    return found.select("page_id", "url", "html", "digest", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))


def archive_and_read(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC packages to the shared folder and reads them back.

    Null html: an empty payload. A null page_id stays null and is never the record that others revisit.
    Rows that repeat the smallest page_id with the same payload are all responses. An empty table gives
    no archives and an empty result. Other columns are left out.
    """
    folder = shared_dir(pages.sparkSession, "warc")
    return read_records(write_pages(with_revisits(pages), folder), payloads)


ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, cast(octet_length(payload) as bigint) as payload_bytes, sha256(payload) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""
