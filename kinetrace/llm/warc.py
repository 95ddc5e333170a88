"""Writing WARC archives and reading them back with a sequential reader.

An archive is a row of gzip members, one for each record. The reader inflates as bytes arrive, takes one
member at a time, frames the record by its Content-Length and verifies the block and payload digests.
Archive segments of a few MB travel as binary rows of a table in the shared folder, so no task needs
another machine's files; the same bytes one after another are a valid ``.warc.gz``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm.common import is_set, joined_evenly, key_bitmap, table, text_of, written

#: An archive segment ends with the record that takes it past so many bytes.
SEGMENT_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 16


class WarcError(ValueError):
    """An archive that is cut short, framed wrongly or does not match its digests."""


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    """The page of a record id that this writer made; null for other ids."""
    name = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(name) if re.fullmatch(r"-?[0-9]{1,19}", name) and urn != name else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, level: int = 6) -> bytes:
    """One gzip member. A revisit keeps the HTTP header with the payload's length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if revisit:
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1_32(payload)}", f"WARC-Block-Digest: sha1:{sha1_32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon:
            raise WarcError(f"header line without a colon: {line[:60]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def _parsed(data: bytes) -> Record:
    head, found, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not found or not first.startswith(b"WARC/1."):
        raise WarcError("no record header at the start of a member")
    headers = _headers(lines)
    try:
        length = int(headers["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no usable Content-Length") from e
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise WarcError("the block does not end where Content-Length says")
    if headers.get("warc-block-digest", f"sha1:{sha1_32(block)}") != f"sha1:{sha1_32(block)}":
        raise WarcError("block digest differs")
    if "warc-type" not in headers:
        raise WarcError("no WARC-Type")
    http, payload = {}, block
    if headers.get("content-type", "").replace(" ", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = _headers(head.split(b"\r\n")[1:])
    told = headers.get("warc-payload-digest", "")
    if headers["warc-type"] != "revisit" and told.startswith("sha1:") and told != f"sha1:{sha1_32(payload)}":
        raise WarcError("payload digest differs")
    return Record(headers, http, payload)


def records(chunks: Iterable[bytes]) -> Iterator[Record]:
    """The records of an archive in order; holds one record and one chunk at a time."""
    inflate, held = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            try:
                held.append(inflate.decompress(chunk))
            except zlib.error as e:
                raise WarcError(f"damaged gzip member: {e}") from e
            if not inflate.eof:
                break
            chunk = inflate.unused_data
            yield _parsed(b"".join(held))
            inflate, held = zlib.decompressobj(31), []
    if held:
        raise WarcError("the archive ends inside a record")


def read_file(path: str) -> Iterator[Record]:
    """The records of a ``.warc.gz`` file, read in small pieces."""
    with open(path, "rb") as f:
        yield from records(iter(lambda: f.read(_READ), b""))


def write_segments(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, level: int = 6) -> DataFrame:
    """(segment binary): the archives of all rows.

    Of rows with equal payloads of ``min_bytes`` or more the one with the smallest id (nulls last) is the
    response and the others are revisits of it; rows that repeat that very id are responses too. A null
    payload is empty, a null url leaves the target out. An empty table gives no segment. A payload that very
    many pages share is dealt over many tasks.
    """
    html = text_of(html_col)
    sha = F.concat(F.when(F.octet_length(html) < min_bytes, "small ").otherwise(""), F.sha1(html.cast("binary")))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), sha.alias("sha"))
    shared = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(shared, "payloads")
    bits, bitmaps = key_bitmap(shared.select(F.xxhash64("sha").alias("k")), "k")
    at = F.pmod(F.xxhash64("sha"), F.lit(bits)) + 1
    rows = rows.withColumn("at", at).join(F.broadcast(bitmaps), F.bitmap_bucket_number("at") == F.col("bucket"), "left").withColumn("maybe", is_set(F.col("bits"), F.col("at")))
    # only pages whose digest may be shared travel; the join is exact
    maybe = joined_evenly(rows.where("maybe").select("page_id", "url", "html", "sha"), shared, "sha", "n", ["page_id", "url"], "left")
    repeat = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    alone = rows.where("NOT maybe").select("page_id", "url", "html", F.lit(None).cast(pages.schema[id_col].dataType).alias("first"), F.lit(False).alias("revisit"))
    rows = alone.unionByName(maybe.select("page_id", "url", "html", "first", repeat.alias("revisit")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for page_id, url, text, first, revisit in zip(*batch.columns, strict=True):
                held.append(record_bytes(page_id.as_py(), url.as_py(), text.as_py().encode(), first.as_py(), revisit.as_py(), level))
                size += len(held[-1])
                if size >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pydict({"segment": [b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"segment": [b"".join(held)]})

    return rows.mapInArrow(run, "segment binary")


def read_segments(segments: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of each record.

    Records of any type are read (warcinfo, request, metadata and so on): page_id is null where the id is not
    one of this writer's; payload_bytes is what the HTTP header says and else the payload's length; a digest
    that the record does not give is computed from its payload.
    """
    return _read(segments, payloads=True)


def _digest(r: Record) -> str:
    told = r.headers.get("warc-payload-digest", "")
    return told.removeprefix("sha1:") if told.startswith("sha1:") else sha1_32(r.payload)


def _length(r: Record) -> int:
    told = r.http.get("content-length", "")
    return int(told) if told.isdecimal() else len(r.payload)


def _read(segments: DataFrame, payloads: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), *([("payload", pa.binary())] * payloads), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for data in batch.column(0):
                view = memoryview(data.as_buffer())
                out: list[tuple] = []
                for r in records(bytes(view[i : i + _READ]) for i in range(0, len(view), _READ)):
                    revisit = r.headers["warc-type"] == "revisit"
                    out.append((page_of(r.headers.get("warc-record-id")), r.headers.get("warc-target-uri"), *([None if revisit else r.payload] * payloads), _length(r), _digest(r), r.headers["warc-type"], page_of(r.headers.get("warc-refers-to")) if revisit else None))
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*out), kinds)], schema=kinds)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*out), kinds)], schema=kinds)

    return segments.mapInArrow(run, f"page_id long, url string, {'payload binary, ' * payloads}payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ``.warc.gz`` files under a path that Spark can read; a file is one row, so under 2 GB."""
    return read_segments(spark.read.format("binaryFile").load(path).select(F.col("content").alias("segment")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = written(write_segments(table(spark, sf_dir, "pages")), "warc")
    return _read(segments, payloads=False).drop("url")


ORACLE = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform(range(0, 4), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(((('0x' || substr(h, CAST(i * 5 + 1 AS INT), 5))::BIGINT >> CAST(15 - 5 * k AS INT)) & 31) AS INT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM g
"""
