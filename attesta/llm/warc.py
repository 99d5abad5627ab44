"""WARC archives: records written with an index, and read back by coalesced byte ranges.

`write` puts a gzip member per record into archives in the shared folder and returns the index: file, offset, length, URL, digest
and type of every record, written as a table before anything is read. `read` takes any selection of index rows, sorts it
by file and offset, joins ranges that are close into one read of bounded size, and parses the records. An archive's name is
new for each attempt of a task; archives of attempts that didn't end are not in the index.

Of pages with equal payloads (html in UTF-8; null: empty) of `least` bytes or more the one with the largest page_id is a
response record, the others are revisits that name it; all shorter ones are responses. A null page_id is below all others.
Repeated rows of the largest id are all responses. A null URL is left out of the record. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, open_file

FILE_BYTES = 128 << 20
GAP = 64 << 10
READ = 8 << 20
#: The record format's version and the revisit profile of identical payloads.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """(the record, the payload's digest)."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def _one_line(url: str) -> str:
    return "".join(c if c.isprintable() else "%" + c.encode().hex().upper() for c in url)


def parse(data: bytes) -> dict:
    """The fields of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    return {"fields": fields, "payload": payload, "size": size}


def _page(name: str | None) -> int | None:
    inside = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inside) if inside else None


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        at = 0
        for batch in _small(batches):
            rows = []
            for page, url, html, top in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "top")), strict=True):
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = open_file(name, "wb")
                revisit = top is not None and top != page
                data, digest = record(page, url, (html or "").encode(), top, revisit)
                member = gzip.compress(data, 5, mtime=0)
                out.write(member)
                rows.append((page, name, at, len(member), url, digest, "revisit" if revisit else "response"))
                at += len(member)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return run


#: A table of repeated payloads of so many rows at most is sent to the pages; a larger one is joined by digest.
BROADCAST_ROWS = 200_000


def write(pages: DataFrame, scratch: Scratch, least: int = 0, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Writes the archives and the index; returns the index.

    Payloads are read twice, to find the repeated ones and to write, and are shuffled only where the repeated ones are more than
    `limit`; then a common payload's rows can be split, for what they join is a written table.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"__d": F.sha1(F.col("html").cast("binary")), "__n": F.octet_length("html")})
    same = rows.where(F.col("__n") >= least).groupBy("__d", "__n").agg(F.max("page_id").alias("top"), F.count("*").alias("m")).where("m > 1").drop("m")
    same = scratch.save(same, "same")
    if same.limit(limit + 1).count() <= limit:
        same = F.broadcast(same)
    marked = rows.join(same, ["__d", "__n"], "left").select("page_id", "url", "html", "top")
    return scratch.save(marked.mapInArrow(_write(scratch.path("archives")), INDEX), "index")


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, which bounds the payloads held at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows sorted by file and offset to records, by reads of joined ranges."""
    for batch in _small(batches):
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "digest")), strict=True))
        out, i = [], 0
        while i < len(rows):
            j, file, start = i, rows[i][0], rows[i][1]
            end = start
            while j < len(rows) and rows[j][0] == file and rows[j][1] - end <= GAP and (j == i or rows[j][1] + rows[j][2] - start <= READ):
                end = max(end, rows[j][1] + rows[j][2])
                j += 1
            with open_file(file, "rb") as f:
                f.seek(start)
                data = f.read(end - start)
            for _, offset, length, digest in rows[i:j]:
                got = parse(gzip.decompress(data[offset - start : offset - start + length]))
                fields = got["fields"]
                revisit = fields["WARC-Type"] == "revisit"
                found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if found != digest or not revisit and sha1_base32(got["payload"]) != digest:
                    raise ValueError(f"{file} at {offset}: the payload's digest is {found}, the index has {digest}")
                out.append((_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), got["size"], found, fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), None if revisit else got["payload"]))
            i = j
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)


def _without_payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _read(batches):
        yield batch.select(RECORD_COLUMNS)


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD_COLUMNS = [x.split()[0] for x in RECORD.split(", ")]


def read(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the index rows given: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Payloads are read and checked in any case; without `payload` they stay where they were read.
    """
    rows = index.select("file", "offset", "length", "digest", F.expr(f"offset div {4 * READ}").alias("part"))
    dealt = rows.repartition("file", "part").sortWithinPartitions("file", "offset").drop("part")
    return dealt.mapInArrow(_read, f"{RECORD}, payload binary") if payload else dealt.mapInArrow(_without_payload, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back."""
    scratch = Scratch(spark, "warc")
    return read(write(pages, scratch, least), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
