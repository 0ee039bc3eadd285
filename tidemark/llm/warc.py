"""WARC archives: a record per page, one gzip member per record, and a sequential reader.

The writer goes through Spark's own text sink, so archives land on any file system Spark writes
to, whole files only, and a lost task is run again. That sink ends each value with a separator,
which is set to an empty gzip member: it adds no bytes to the inflated stream, and gzip readers
pass over it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.rows import ROW, cut, numbered
from tidemark.operators.lineage import shared_folder

LEAST = 1000  # smaller payloads are never written as revisits
READ = 1 << 16  # compressed bytes given to the decompressor at once
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _gzip(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


EMPTY_MEMBER = _gzip(b"")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page_id: int | None) -> str:
    """Record name of a page."""
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, revisits: bool,
           refers_to: int | None) -> bytes:
    """One WARC record: HTTP headers and payload; a revisit has the headers alone."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisits else http + payload
    target = "".join(c for c in url or "" if c > " ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}",
            f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {target}"] if target else []
    if revisits:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {page_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``_row, page_id, url, html, leader, leader_id``: the row that each row's payload is kept in.

    Of equal payloads of at least ``LEAST`` bytes the one with the largest page id leads, the
    first by row number among equal ids; a null id is the smallest. Only the digest, the length
    and the ids are grouped, partly in the map tasks.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = numbered(
        pages, F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.col(html).cast("string").alias("html"), F.sha1(payload).alias("digest"),
        F.length(payload).alias("bytes"))
    rank = F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", (-F.col(ROW)).alias("back"))
    leaders = cut(rows.where(F.col("bytes") >= LEAST).groupBy("digest", "bytes").agg(
        F.max(rank).alias("top"), F.count("*").alias("n")).where("n > 1").select(
            "digest", "bytes", (-F.col("top.back")).alias("leader"), F.col("top.page_id").alias("leader_id")))
    return rows.join(leaders, ["digest", "bytes"], "left").select(
        ROW, "page_id", "url", "html", "leader", "leader_id")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, ids, urls, pages, leaders, leader_ids = (batch.column(k) for k in range(6))
        out, size = [], 0
        for k in range(batch.num_rows):
            row, leader = rows[k].as_py(), leaders[k].as_py()
            revisits = leader is not None and leader != row
            data = record(ids[k].as_py(), urls[k].as_py(), (pages[k].as_py() or "").encode(),
                          revisits, leader_ids[k].as_py() if revisits else None)
            out.append(_gzip(data))
            size += len(out[-1])
            if size > READ * 64:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url",
                   html: str = "html", records: int = 5_000) -> None:
    """Write archives of about ``records`` records or fewer below ``path``, a file for each task."""
    members = planned(pages, page_id, url, html).mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", records).text(path)


class BrokenRecord(ValueError):
    """An archive that ends early, frames wrongly or fails a digest."""


def inflate(data: memoryview) -> Iterator[bytes]:
    """Inflated bytes of each non-empty gzip member, one member at a time, read in pieces."""
    at, size = 0, len(data)
    while at < size:
        stream, parts = zlib.decompressobj(31), []
        while not stream.eof:
            if at >= size:
                raise BrokenRecord("the archive ends inside a member")
            piece = data[at: at + READ]
            try:
                parts.append(stream.decompress(piece))
            except zlib.error as problem:
                raise BrokenRecord(str(problem)) from problem
            at += len(piece)
        at -= len(stream.unused_data)
        member = b"".join(parts)
        if member:
            yield member


def parse(member: bytes) -> dict:
    """Headers and facts of one record; lengths and digests are verified."""
    head, found, rest = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/1."):
        raise BrokenRecord("no record header")
    named = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
    length = int(named["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BrokenRecord("the block does not have its stated length")
    block = rest[:length]
    if named["warc-block-digest"] != _sha1(block):
        raise BrokenRecord("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisits = named["warc-type"] == "revisit"
    if not revisits and (len(payload) != stated or named["warc-payload-digest"] != _sha1(payload)):
        raise BrokenRecord("payload digest")
    return {
        "page": named["warc-record-id"], "url": named.get("warc-target-uri"),
        "type": named["warc-type"], "bytes": stated, "refers": named.get("warc-refers-to"),
        "digest": base64.b32decode(named["warc-payload-digest"].removeprefix("sha1:")).hex(),
        "payload": None if revisits else payload,
    }


RECORDS = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
           "refers_to bigint, payload binary")


def _number(name: str | None) -> int | None:
    digits = (name or "")[len("<urn:page:"): -1]
    return int(digits) if digits else None


def _records(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for member in inflate(memoryview(content.as_buffer())):
                r = parse(member)
                rows.append((_number(r["page"]), r["url"], r["bytes"], r["digest"], r["type"],
                             _number(r["refers"]), r["payload"] if with_payload else None))
                size += len(member) if with_payload else 1000
                if size > READ * 64:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload``, a row per record.

    Each archive is read front to back by one task. A broken frame, an early end or a wrong
    digest fails the read. Payloads of revisits are null; their size and digest are those of the
    full payload.
    """
    # a task takes one archive, or small ones up to spark.sql.files.maxPartitionBytes
    one = spark.read.format("binaryFile").load(path).select("content")
    return one.mapInArrow(lambda it: _records(it, with_payload), RECORDS)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read their records back.

    A null page is an empty payload; empty and small payloads are always responses. Repeated rows
    revisit one of them; a null id comes back null. A table without rows gives no archive and
    no rows; other columns are not read.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, page_id, url, html)
    return read_archives(spark, path, with_payload=False)
