"""WARC archives: writing with segments and chunked payloads, reading with reassembly.

Writing: equal payloads are stored once, as the response of the largest id;
the others become revisit records. A response's block is an HTTP message whose
payload has chunked transfer framing; a block longer than a segment goes on in
continuation records that name their origin and segment number, and the last
one tells the total length.

Reading: archives are parsed record by record; segments are grouped by origin
identifier, ordered by number, checked against the total length and joined;
the chunked framing is decoded and the payload checked against its digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, shared_dir, short_batches

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
#: Records in one archive file: with segments of bounded length this bounds the file.
FILE_RECORDS = 4_096
#: Shared payloads (a digest, an id and an address each) that are broadcast at most.
BROADCAST_ROWS = 100_000
#: Bytes of payload for which a task writes archives.
ARCHIVE_BYTES = 16_000_000
PARTS = "origin string, number int, total long, kind string, page_id long, refers_to long, digest string, block binary"
PAGE = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The payload of a message body in chunked transfer framing; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size")
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        parts.append(framed[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record with one line end less than it needs: the text writer adds that."""
    head = b"".join(f"{name}: {value}\r\n".encode() for name, value in fields if value is not None)
    return b"".join([VERSION, b"\r\n", head, b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r"])


def records(page_id, url, payload: bytes, is_response: bool, refers_to, of: str, name: str, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page. of: the address of the response that a revisit refers to; name: a record identifier that no other page has."""
    digest = base32_sha1(payload)
    uri, of = ("".join(c for c in x or "urn:none" if c.isprintable()) for x in (url, of))
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("Page-Id", page_id), ("WARC-Payload-Digest", f"sha1:{digest}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if not is_response:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), *common, profile, ("WARC-Refers-To-Target-URI", of), ("WARC-Refers-To-Date", DATE), ("Refers-To-Page-Id", refers_to), ("Content-Type", "application/http;msgtype=response")], block)
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    kind = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *common, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment_bytes:
        yield record(kind, block)
        return
    starts = range(0, len(block), segment_bytes)
    yield record([*kind, ("WARC-Segment-Number", 1)], block[:segment_bytes])
    for number, start in enumerate(starts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if number == len(starts) else []
        own = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}/{number}").urn
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", number), *last], block[start : start + segment_bytes])


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record of an uncompressed archive."""
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        if end < 0 or not archive.startswith(b"WARC/", at):
            raise ValueError("no record where one should begin")
        lines = archive[at:end].decode().split("\r\n")[1:]
        fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        start, length = end + 4, int(fields["content-length"])
        block = archive[start : start + length]
        if len(block) != length:
            raise ValueError("a record is shorter than its length")
        yield fields, block
        at = start + length
        if archive[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end with two empty lines")
        at += 4


def write(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write the pages (page_id, url, html) as compressed archives into a folder that Spark reaches.

    Null html is the empty payload. Of equal payloads the record with the
    largest id is the response; rows that share that id are all responses, as
    are all rows of a payload whose ids are all null. No rows write no record.
    """
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html")).withColumn("sha", F.sha1("html"))
    whole = given.groupBy("sha").agg(F.max("page_id").alias("largest"), F.max_by("url", "page_id").alias("of"), F.count("*").alias("rows"))
    shared = cut(whole.where(F.col("rows") > 1).select("sha", "largest", "of"))
    # up to a bound the payloads stay where they are, however many pages share one; beyond it they meet in a shuffle
    few = shared.count() <= BROADCAST_ROWS
    told = given.join(F.broadcast(shared) if few else shared, "sha", "left").select("page_id", "url", "html", F.coalesce("of", F.lit("urn:none")).alias("of"), (F.col("largest").isNull() | F.coalesce(F.col("page_id") == F.col("largest"), F.lit(False))).alias("is_response"), F.col("largest").alias("refers_to"))
    run_name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, row = TaskContext.get().partitionId(), 0
        for b in batches:
            out: list[bytes] = []
            for page_id, url, html, of, is_response, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name = uuid.uuid5(uuid.NAMESPACE_URL, f"{run_name}/{task}/{row}").urn
                row += 1
                out += records(page_id, url, html, is_response, refers_to, of, name, segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # archives of a worthwhile size, so that a large cluster's many tasks do not leave as many small files
    files = max(1, -(-(given.agg(F.sum(F.octet_length("html"))).first()[0] or 0) // ARCHIVE_BYTES))
    written = short_batches(told).coalesce(files).mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    written.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url-free metadata and payload of every page in the archives of a folder.

    Columns: page_id, record_type, refers_to, payload_digest, payload_bytes and
    payload (null for revisits). Broken archives, segments that do not add up
    to their total length and payloads that differ from their digest raise.
    """

    def rows(content: bytes, segmented: bool) -> Iterator[tuple]:
        archive = zlib.decompress(content, 31) if content[:2] == b"\x1f\x8b" else content
        for fields, block in parsed(archive):
            number = fields.get("warc-segment-number")
            if (number is not None) == segmented:
                whole, page, refers = (int(x) if x else None for x in map(fields.get, ("warc-segment-total-length", "page-id", "refers-to-page-id")))
                origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                yield origin, int(number or 0), whole, fields["warc-type"], page, refers, fields.get("warc-payload-digest", "sha1:").partition(":")[2], block

    def segments_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed in b.column(0):
                yield from batched(rows(packed.as_py(), True), PARTS)

    def plain_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed in b.column(0):
                yield from batched((opened(page, kind, refers, digest, block) for _, _, _, kind, page, refers, digest, block in rows(packed.as_py(), False)), PAGE)

    def whole_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from batched((opened(*x) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)), PAGE)

    files = short_batches(spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)).select("content")
    whole = reassembled(files.mapInArrow(segments_of, PARTS)).select("page_id", "kind", "refers_to", "digest", "block")
    return files.mapInArrow(plain_of, PAGE).unionByName(whole.mapInArrow(whole_of, PAGE))


def opened(page_id, kind: str, refers_to, digest: str, block: bytes) -> tuple:
    """A page's row from a whole record."""
    head, _, body = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        size = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        return page_id, kind, refers_to, digest, size, None
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if base32_sha1(payload) != digest:
        raise ValueError("a payload differs from its digest")
    return page_id, kind, refers_to, digest, len(payload), payload


def batched(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded size from rows."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    types = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k] for k in kinds]
    while part := list(islice(rows, 256)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], list(names))


def reassembled(segments: DataFrame) -> DataFrame:
    """Whole records from their segments: grouped by origin, in order of number, checked against the total length."""
    ordered = F.sort_array(F.collect_list(F.struct("number", "block")))
    own = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    grouped = segments.groupBy("origin").agg(own("kind"), own("page_id"), own("refers_to"), own("digest"), F.max("total").alias("total"), ordered.alias("parts"))
    joined = grouped.withColumn("block", F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["block"])))
    numbered = F.transform("parts", lambda x: x["number"]) == F.sequence(F.lit(1), F.size("parts"))
    good = numbered & (F.octet_length("block") == F.col("total"))
    return joined.withColumn("block", F.when(F.coalesce(good, F.lit(False)), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments do not add up: "), F.col("origin"))).cast("binary")))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    return read(spark, folder)
