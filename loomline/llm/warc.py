"""Web archives: written with an index, read back by coalesced byte ranges.

Writing is the only pass over the pages: each task appends records, one gzip member
each, to archives of its own in a shared folder and returns an index row per record:
archive, offset, length, url, digest. The index is written as a table; archives it does
not name (of a task that was lost and ran again) are never read. Reading starts from
any selection of index rows, sorted by archive and offset; neighbouring ranges become
one read of at most `READ_BYTES`, and each record is checked against its digest.

Equal payloads of `least_bytes` or more are stored once: the record of the largest
page_id is a response, the others are revisits that name it. Only digests that occur
more than once are joined back to the pages, so a payload of a third of all pages is
one row on that side and Spark may split the other.

A null html is an empty payload; a null url has no target header. A null page_id is
less than any other and is omitted from the record. Rows that share the largest
page_id of a payload are all responses. An empty table gives no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote
from uuid import uuid4

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from loomline.staging import scratch_path, stage

DATE = "2000-01-01T00:00:00Z"
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
INDEX = ("archive string, offset long, length long, page_id long, url string, digest string, "
         "payload_bytes long, record_type string, refers_to long")
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, "
          "record_type string, refers_to long, payload binary")


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, which every executor reaches by its own client."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def block(headers: list[tuple[str, object]]) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers if value is not None)
    return lines.encode("utf-8")


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int,
           refers_to: int | None) -> bytes:
    """One record as a gzip member; without a payload it is a revisit."""
    http = b"HTTP/1.1 200 OK\r\n" + block([
        ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)]) + b"\r\n"
    body = http + (payload or b"")
    revisit = payload is None
    head = b"WARC/1.1\r\n" + block([
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid4()}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
         if revisit else None),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("X-Page-Id", page_id),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(body)),
    ]) + b"\r\n"
    return gzip.compress(head + body + b"\r\n\r\n", compresslevel=4, mtime=0)


def whole(value: object) -> int | None:
    return None if value is None or value != value else int(value)


def writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        stream, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, kind, refers_to, size, sha in zip(
                        batch["page_id"], batch["url"], batch["html"], batch["record_type"],
                        batch["refers_to"], batch["payload_bytes"], batch["sha"]):
                    if stream is None or offset >= archive_bytes:
                        if stream is not None:
                            stream.close()
                        name, offset = f"{uuid4().hex}.warc.gz", 0
                        stream = system.open_output_stream(f"{base}/{name}", compression=None)
                    digest = base64.b32encode(bytes.fromhex(sha)).decode("ascii")
                    payload = None if kind == "revisit" else (html or "").encode("utf-8")
                    data = record(whole(page_id), url, payload, digest, int(size), whole(refers_to))
                    stream.write(data)
                    rows.append((name, offset, len(data), whole(page_id), url, digest, int(size),
                                 kind, whole(refers_to)))
                    offset += len(data)
                frame = pd.DataFrame(rows, columns=[part.split()[0] for part in INDEX.split(", ")])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if stream is not None:
                stream.close()
    return write


def marked(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with digest, size, record_type and refers_to; revisits lose their html."""
    payload = F.coalesce("html", F.lit(""))
    sized = pages.select("page_id", "url", "html",
                         F.octet_length(payload).cast("long").alias("payload_bytes"),
                         F.sha1(payload.cast("binary")).alias("sha"))
    repeated = stage(
        sized.where(F.col("payload_bytes") >= least_bytes).groupBy("sha")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first_id"))
        .where("n > 1 AND first_id IS NOT NULL").select(F.col("sha").alias("same"), "first_id"),
        "repeated-payloads",
    )
    known = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    revisit: Column = F.coalesce(known, F.lit(False))
    return sized.join(repeated, F.col("sha") == F.col("same"), "left").select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "payload_bytes", "sha",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page below `folder`; returns the written index."""
    rows = marked(pages.select("page_id", "url", "html"), least_bytes)
    return stage(rows.mapInPandas(writer(folder, archive_bytes), INDEX), "warc-index")


def coalesced(ranges: list[tuple[int, int]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) as reads (start, end, members) over small gaps."""
    reads: list[tuple[int, int, list[tuple[int, int]]]] = []
    for offset, length in ranges:
        if reads:
            start, end, members = reads[-1]
            if offset - end <= GAP_BYTES and offset + length - start <= READ_BYTES:
                reads[-1] = (start, max(end, offset + length), [*members, (offset, length)])
                continue
        reads.append((offset, offset + length, [(offset, length)]))
    return reads


def parsed(data: bytes) -> tuple:
    """(page_id, url, size, digest, type, refers_to, payload) of one gzip member, verified."""
    raw = zlib.decompress(data, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")[1:]
    fields = dict(line.split(": ", 1) for line in lines)
    body = rest[:int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_digest(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    page = fields.get("X-Page-Id")
    refers = fields.get("WARC-Refers-To")
    return (None if page is None else int(page), fields.get("WARC-Target-URI"), size, digest, kind,
            None if refers is None else int(refers.strip("<>").rpartition(":")[2]),
            payload if kind == "response" else None)


def reader(folder: str, with_payload: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = opened(folder)
        columns = [part.split()[0] for part in RECORD.split(", ")]
        for batch in batches:
            for name, group in batch.groupby("archive", sort=False):
                ranges = sorted(zip(group["offset"].astype(int), group["length"].astype(int)))
                with system.open_input_file(f"{base}/{name}") as source:
                    for start, end, members in coalesced(ranges):
                        source.seek(start)
                        data = source.read(end - start)
                        rows = [parsed(data[at - start:at - start + n]) for at, n in members]
                        if not with_payload:
                            rows = [(*row[:-1], None) for row in rows]
                        frame = pd.DataFrame(rows, columns=columns)
                        yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
    return read


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of selected index rows; with_payload=False checks and drops payloads."""
    ranges = index.select("archive", "offset", "length")
    size = ranges.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-size // READ_BYTES))  # by what is read, not by the size of its index
    ordered = ranges.repartitionByRange(tasks, "archive", "offset")
    return ordered.sortWithinPartitions("archive", "offset").mapInPandas(
        reader(folder, with_payload), RECORD)


def warc_report(pages: DataFrame) -> DataFrame:
    folder = scratch_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    return read_records(index, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
