"""Web archives: transactions of request, response and metadata records, written and assembled.

Writing. Each page becomes a transaction of three records, each a gzip member: the capture
(``response``, or ``revisit`` without payload), a ``request`` and a ``metadata`` record, both with
WARC-Concurrent-To the capture. Of pages with one payload of at least ``least`` bytes, that with the
largest page_id is the response and the others revisit it (WARC-Refers-To); rows that tie for the
largest are all responses. Copies of a payload are counted by digest before the pages are joined to
the count, so a payload on a third of all pages is one row of the count, and the join's large side
can be split.

Reading. Tasks parse the archives that the manifest names; the three kinds of records are joined on
(archive, concurrent-to) into one nested row per capture, and revisits are joined to the captures they
refer to. Archives are under a size bound, and lie in the shared folder under names of their own.

Null html: an empty payload. Null url: an empty target. Null page_id: smallest of all, stays null.
Repeated rows are each written: where an archive already has the id, the id gets a number. Empty
table: no archives and no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagscope.llm.arrays import small_batches
from lagscope.llm.files import make_folder, read_whole, write_new
from lagscope.session import store, working_dir

LEAST = 1000
ARCHIVE_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "archive string, kind string, record_id string, concurrent_to string, refers_to string, target string, fields map<string,string>, payload binary, payload_bytes long, payload_digest string"


def record_id(page_id: int | None, copy: int = 0) -> str:
    """The record id of a page's capture."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' + (f':{copy}' if copy else ''))}>"


def _member(headers: list[tuple[str, str]], block: bytes, level: int = 1) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + press.flush()


def transaction(own: str, page_id: int | None, url: str, payload: bytes, keeper: int | None, revisit: bool) -> bytes:
    """The three records of a page."""
    target = " ".join(url.split())  # a header is one line
    common = [("WARC-Target-URI", target), ("WARC-Date", DATE)]
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(keeper))] if revisit else [("WARC-Type", "response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    capture = _member([*kind, ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")], http if revisit else http + payload)
    other = lambda name: ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name + own)}>")
    request = _member([("WARC-Type", "request"), other("request"), ("WARC-Concurrent-To", own), *common, ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\n\r\n")
    fields = f"page-id: {'' if page_id is None else page_id}\r\n".encode()
    metadata = _member([("WARC-Type", "metadata"), other("metadata"), ("WARC-Concurrent-To", own), *common, ("Content-Type", "application/warc-fields")], fields)
    return capture + request + metadata


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages; the manifest names the archives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        used: set[str] = set()
        size = 0
        for batch in small_batches(batches, column="html"):
            for page_id, url, html, keeper, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                copy, own = 0, record_id(page_id)
                while own in used:
                    copy += 1
                    own = record_id(page_id, copy)
                used.add(own)
                held.append(transaction(own, page_id, url or "", (html or "").encode(), keeper, revisit))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"archive": [write_new(folder, ".warc.gz", b"".join(held))]})
                    held, used, size = [], set(), 0
        if held:
            yield pa.RecordBatch.from_pydict({"archive": [write_new(folder, ".warc.gz", b"".join(held))]})

    make_folder(folder)
    rows = pages.selectExpr("cast(page_id as long) as page_id", "url", "html", "sha1(cast(coalesce(html, '') as binary)) as _digest", f"octet_length(coalesce(html, '')) >= {least} as _large")
    shared = rows.where("_large").groupBy("_digest").agg(F.max("page_id").alias("_keeper"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    revisit = F.col("_large") & F.col("_keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keeper"))
    decided = rows.join(shared, "_digest", "left").select("page_id", "url", "html", "_keeper", F.coalesce(revisit, F.lit(False)).alias("_revisit"))
    return decided.mapInArrow(run, "archive string")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as source:
        data = source.read()
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        headers = {}
        for line in data[at:end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.lower()] = value.strip()
        start = end + 4
        at = start + int(headers["content-length"])
        yield headers, data[start:at]
        at += 4


def read_records(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives; ``payloads`` leaves the bytes in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                out: dict[str, list] = {name: [] for name in ("archive", "kind", "record_id", "concurrent_to", "refers_to", "target", "fields", "payload", "payload_bytes", "payload_digest")}
                for headers, block in parse(read_whole(folder, archive)):
                    kind, payload, size, digest, fields = headers["warc-type"], None, None, None, {}
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    elif kind == "revisit":
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    elif kind == "metadata":
                        fields = {k: v.strip() for k, _, v in (line.partition(":") for line in block.decode().split("\r\n") if line)}
                    row = (archive, kind, headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers["warc-target-uri"], list(fields.items()), payload if payloads else None, size, digest)
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
                kinds = [pa.string()] * 6 + [pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(spread, "archive").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, capture, request, metadata, and what a revisit refers to."""

    def nested(*names: str) -> Column:
        return F.struct(*names)

    capture = records.where("kind in ('response', 'revisit')").select(
        "archive", F.col("record_id").alias("_id"), nested("kind", "record_id", "refers_to", "target", "payload", "payload_bytes", "payload_digest").alias("capture")
    )
    request = records.where("kind = 'request'").select("archive", F.col("concurrent_to").alias("_id"), nested("record_id", "target").alias("request"))
    metadata = records.where("kind = 'metadata'").select("archive", F.col("concurrent_to").alias("_id"), nested("record_id", "fields").alias("metadata"))
    whole = capture.join(request, ["archive", "_id"], "left").join(metadata, ["archive", "_id"], "left")
    return whole.select(F.expr("cast(nullif(metadata.fields['page-id'], '') as long)").alias("page_id"), "archive", "capture", "request", "metadata")


def captures(pages: DataFrame, folder: str | None = None, payloads: bool = True) -> DataFrame:
    """Write all pages as archives, read them back and assemble the transactions."""
    folder = folder or working_dir(pages.sparkSession, "warc-archives")
    return assemble(read_records(store(write_archives(pages, folder), "warc-manifest"), folder, payloads))


def report(transactions: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each transaction."""
    rows = transactions.select("page_id", "capture.kind", "capture.record_id", "capture.refers_to", "capture.payload_bytes", "capture.payload_digest")
    targets = rows.where("kind = 'response'").groupBy("record_id").agg(F.max("page_id").alias("_page"), F.max("payload_bytes").alias("_bytes"))
    joined = rows.join(targets.withColumnRenamed("record_id", "_target"), F.col("refers_to") == F.col("_target"), "left")
    return joined.select(
        "page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), F.col("_page").alias("refers_to")
    )
