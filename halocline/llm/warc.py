"""WARC archives, index first: written with an index of offsets, read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_bits, maybe_among, new_path, short_batches, tidied, written

ARCHIVE_BYTES = 256 << 20
#: Ranges closer than this are read in one piece; pieces stay below the second bound unless one record is larger.
GAP_BYTES = 64 << 10
PIECE_BYTES = 8 << 20
INDEX = "archive string, offset long, length long, url string, payload_digest string, record_id string, record_type string"
RECORDS = "record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member of its own. A revisit has the HTTP head of its response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> dict:
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    bare = lambda name: fields[name].strip("<>") if name in fields else None
    found = {"record_id": bare("WARC-Record-ID"), "record_type": fields["WARC-Type"], "url": fields.get("WARC-Target-URI"), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": n, "refers_to": bare("WARC-Refers-To"), "payload": payload if fields["WARC-Type"] == "response" else None}
    if found["payload"] is not None and (len(payload) != n or digest_of(payload) != found["payload_digest"]):
        raise ValueError(f"record {found['record_id']} does not match its digest")
    return found


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """records (record_id, url, payload binary, refers_to) -> the index of what was written below path.

    Each task writes archives of its own, with new names, and hands out one index row per record; the rows are
    stored as a table, so only archives of tasks that ended well are ever referred to.
    """
    short_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(path)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for record_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                digest = digest_of(payload)
                data = record_bytes(record_id, url, payload, digest, refers_to, date)
                out.write(data)
                for column, value in zip(rows, (name, at, len(data), url, digest, record_id, "revisit" if refers_to else "response"), strict=True):
                    column.append(value)
                at += len(data)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return written(records.select("record_id", "url", "payload", "refers_to").mapInArrow(tidied(run), INDEX), "warc-index")


def read_records(selected: DataFrame, path: str) -> DataFrame:
    """The records of the selected index rows. Rows are range-sorted by archive and offset; near ranges are read at once."""
    short_batches(selected.sparkSession)

    def pieces(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        archive, ranges = "", []
        for name, offset, length in rows:
            end = ranges[-1][0] + ranges[-1][1] if ranges else 0
            if ranges and (name != archive or offset - end > GAP_BYTES or offset + length - ranges[0][0] > PIECE_BYTES):
                yield archive, ranges
                ranges = []
            archive = name
            ranges.append((offset, length))
        if ranges:
            yield archive, ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(path)
        opened, source = "", None
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for name, ranges in pieces(rows):
            if name != opened:
                source, opened = store.open_input_file(f"{root}/{name}"), name
            begin = ranges[0][0]
            data = source.read_at(ranges[-1][0] + ranges[-1][1] - begin, begin)
            found = [parse_record(data[o - begin : o - begin + n]) for o, n in ranges]
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORDS.split(", "))]))

    n = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = selected.select("archive", "offset", "length").repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ranged.mapInArrow(tidied(run), RECORDS)


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> tuple[DataFrame, str]:
    """Writes a record per row of pages (page_id, url, html) and returns (index, path).

    Of rows with equal payloads (by SHA-256) of at least least_bytes bytes those with the smallest page_id are responses, the
    others are revisits of it; smaller payloads are all responses. Very long pages are held a few times over while they are packed. Ties can't arise. Null html is an empty payload. Null page ids are larger than all others. A null url is left
    out of the record. Rows that repeat an id are written each. An empty table writes no archive.
    Other columns are not read, whatever their names.
    """
    path = path or new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"_sha256": F.sha2("payload", 256), "_bytes": F.octet_length("payload")})
    firsts = rows.where(F.col("_bytes") >= least_bytes).groupBy("_sha256").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.where("n > 1 and first_id is not null").drop("n"), "first-pages")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    # only pages whose payload others may have are shuffled
    may, free = maybe_among(rows, F.col("_sha256"), key_bits(firsts, "_sha256"))
    several = may.join(firsts.withColumnRenamed("_sha256", "_key").hint("shuffle_hash"), "_key", "left").select("_own.*", "first_id")
    known = free.withColumn("first_id", F.lit(None).cast("long")).unionByName(several)
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return write_archives(known.select(urn("page_id").alias("record_id"), "url", "payload", F.when(revisit, urn("first_id")).alias("refers_to")), path), path
