"""WARC archives: written with an index of byte ranges, read back by coalesced ranges.

Every record is a gzip member of its own (``.warc.gz``). Tasks write archive files straight
to a folder that all executors see and return the index: file, offset, length, URL, digest
and type of each record. A file's name is new for each attempt, so what a lost attempt has
written is in no index. The index is stored as Parquet before anything is read.

Reading takes rows of the index, sorts them by file and offset, joins neighbouring ranges
(gaps up to ``GAP``, at most ``SPAN`` bytes a read) and cuts the records out of each read.

Of records with equal payloads of at least ``LEAST`` bytes, the one with the largest
page_id is a response, the others are revisits: they hold the HTTP header of the payload,
its digest and the id of the record they refer to, not the payload.

Defined results: a null html is an empty payload; a null url is written without a target.
Rows that repeat a page_id and share its largest value are responses each. A record with a
null page_id refers to the group's response, or is a response where the group has no id.
An empty table gives no archive and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import materialize, new_path, tidy

LEAST = 1000
#: Digests of repeated payloads that are sent to every task at most.
FEW_GROUPS = 300_000
GAP, SPAN = 64 << 10, 8 << 20
FILE_BYTES = 512 << 20
_NAMESPACE = uuid.UUID("6c5e9d2e-7b0b-4f3a-9a52-0d6f4b8f1c77")
INDEX = "file string, offset bigint, length bigint, page_id bigint, url string, digest string, record_type string"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder's URI; plain paths are local."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record, before compression."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    else:
        body += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields of a record and of its HTTP message (names in lower case), and the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(_fields(head))
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(_fields(http)), payload


def _fields(head: bytes) -> Iterator[tuple[str, str]]:
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        yield name.strip().lower(), value.strip()


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to (null: a response) of each page."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    # digests and sizes alone are grouped; pages are shuffled only if the digests that repeat are too many to send to every task
    slim = rows.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= LEAST)
    groups = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").select("digest", "refers_to")
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    groups = materialize(groups, "warc-groups")
    few = groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    rows = rows.join(F.broadcast(groups) if few else groups, "digest", "left")
    same = F.col("page_id").eqNullSafe(F.col("refers_to"))
    return rows.select("page_id", "url", "html", "digest", F.when(~same, F.col("refers_to")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages' archive to ``folder`` and returns its stored index."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = name = None
        at = 0
        try:
            for batch in batches:
                out = []
                for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    page_id, url, html, digest, refers_to = row
                    packed = member(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to, refers_to is not None, date))
                    if held is None or at >= FILE_BYTES:
                        if held is not None:
                            held.close()
                        where, base = store(folder)
                        where.create_dir(base, recursive=True)
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        held = where.open_output_stream(f"{base}/{name}", compression=None)  # the members are compressed already
                    held.write(packed)
                    out.append((name, at, len(packed), page_id, url, digest, "response" if refers_to is None else "revisit"))
                    at += len(packed)
                if out:
                    f, o, n, p, u, d, t = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(o, pa.int64()), pa.array(n, pa.int64()), pa.array(p, pa.int64()), pa.array(u, pa.string()), pa.array(d, pa.string()), pa.array(t, pa.string())], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if held is not None:
                held.close()

    return materialize(planned(pages).mapInArrow(archive, INDEX), "warc-index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, length, records) of each read; ``rows`` are (offset, length) in order."""
    held: list[tuple[int, int]] = []
    start = end = 0
    for offset, length in rows:
        if held and (offset > end + gap or offset + length - start > span):
            yield start, end - start, held
            held = []
        if not held:
            start = offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield start, end - start, held


RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string"


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` selects. A revisit has no payload of its own; its length and digest are those of the full payload."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = store(folder)
        name = held = None
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            first = 0
            while first < len(files):
                last = first
                while last < len(files) and files[last] == files[first]:
                    last += 1
                if files[first] != name:
                    if held is not None:
                        held.close()
                    name = files[first]
                    held = where.open_input_file(f"{base}/{name}")
                for start, size, records in ranges(list(zip(offsets[first:last], lengths[first:last]))):
                    data = held.read_at(size, start)
                    rows = []
                    for offset, length in records:
                        fields, http, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                        page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                        if fields["warc-type"] == "response":
                            size_, digest, kept = len(payload), hashlib.sha1(payload).hexdigest(), payload
                        else:
                            size_, digest, kept = int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), None
                        rows.append((None if page is None else int(page), fields.get("warc-target-uri"), fields["warc-type"], None if refers is None else int(refers), kept, size_, digest))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()))], names=[x.split()[0] for x in RECORD.split(", ")])
                first = last
        if held is not None:
            held.close()

    # a range of the sorted index to each task: neighbours in a file are read together
    sorted_ = index.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return sorted_.mapInArrow(fetch, RECORD)


@tidy("warc-records")
def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row per page, from the archive: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = new_path(spark, "warc")
    index = write(pages, folder)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
