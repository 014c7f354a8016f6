"""WARC archives compressed with Zstandard, one frame a record, written and read back.

An archive starts with a skippable frame that holds the dictionary its records were compressed with. The
reader loads it, decodes one frame per record, and checks headers, lengths and digests. Archives are bounded
blobs: rows (archive, content) of a table on any store that Spark writes, or files read by ``binaryFile``.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_side

#: Fixed values of the formats: the skippable frame that carries a dictionary, the Zstandard frame's first bytes.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

READ_SCHEMA = (
    "page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, "
    "refers_to long, payload string"
)


def _urn(page_id: int | None, digest: str) -> str:
    name = digest if page_id is None else str(page_id)
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + name)}>"


def _clean(value: str | None) -> str:
    return "" if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """One uncompressed WARC record. A revisit has the HTTP head of its page and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"") if refers_to is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_archive(records: list[bytes], dictionary_bytes: int = 16384, sample_bytes: int = 1 << 20) -> bytes:
    """Compresses records with a dictionary trained on the archive's own leading records.

    The sample is bounded by ``sample_bytes``; too few or too uniform records give an archive with an empty
    dictionary frame.
    """
    sample, size = [], 0
    for r in records:
        if size >= sample_bytes:
            break
        sample.append(r[: 1 << 16])
        size += len(sample[-1])
    trained = None
    if len(sample) >= 16:
        try:
            trained = zstandard.train_dictionary(dictionary_bytes, sample)
        except zstandard.ZstdError:
            trained = None
    raw = trained.as_bytes() if trained else b""
    packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE_MAGIC, len(raw)), raw, *map(packer.compress, records)])


def read_records(blob: bytes) -> Iterator[bytes]:
    """The records of one archive, one a frame. Raises ValueError where the archive is damaged."""
    if len(blob) < 8:
        raise ValueError("archive too short for its dictionary frame")
    magic, size = struct.unpack_from("<II", blob)
    if magic != SKIPPABLE_MAGIC or 8 + size > len(blob):
        raise ValueError("no leading dictionary frame")
    raw = blob[8 : 8 + size]
    if raw[:4] == FRAME_MAGIC:  # a dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest = memoryview(blob)[8 + size :]
    while len(rest):
        if bytes(rest[:4]) != FRAME_MAGIC:
            raise ValueError("no frame where a record should start")
        one = reader.decompressobj()
        data = one.decompress(rest)
        if not one.eof:
            raise ValueError("truncated frame")
        yield data
        rest = rest[len(rest) - len(one.unused_data) :]


def parse_record(data: bytes) -> dict:
    """Checks and takes apart one record: version, headers, block length and end, digests, HTTP length."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block's length is not Content-Length")
    block = rest[:length]
    if hashlib.sha1(block).hexdigest() != fields["warc-block-digest"].removeprefix("sha1:"):
        raise ValueError("block digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    sizes = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not gap or not sizes:
        raise ValueError("no HTTP head")
    size, digest, kind = int(sizes[0]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload length or digest")
    if kind == "revisit" and (payload or "x-refers-to-page-id" not in fields):
        raise ValueError("a revisit has a payload or no origin")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("x-page-id"),
        "record_type": kind,
        "target_uri": fields.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": number("x-refers-to-page-id"),
        "payload": payload.decode("utf-8") if kind == "response" else None,
    }


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages(page_id, url, html) with payload_bytes, payload_digest and refers_to (null for a response).

    Of pages with equal payloads of at least ``least`` bytes, the largest page_id is the response. Payloads are
    compared by SHA-1 and length on rows without texts: a payload that very many pages share is pre-aggregated,
    and only its digest meets the other copies. The decision returns to its page by page_id and digest: revisits that take
    little memory are broadcast, so that no html is moved. A null html is an empty payload; a page without page_id is a response of
    its own; rows with the same page_id and payload are alike, and share their fate; an empty table gives no records.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    read = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    read = read.withColumn("payload_bytes", F.length(payload).cast("long")).withColumn("payload_digest", F.sha1(payload))
    small = read.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    small = small.select("page_id", "payload_bytes", "payload_digest")
    origin = small.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n"))
    origin = origin.where("_n > 1").drop("_n")
    revisits = small.join(origin, ["payload_digest", "payload_bytes"]).where("page_id <> refers_to")
    revisits = small_side(materialize(revisits.select("page_id", "payload_digest", "refers_to").distinct()))
    return read.join(revisits, ["page_id", "payload_digest"], "left")


def write_archives(planned: DataFrame, archive_bytes: int = 8 << 20) -> DataFrame:
    """Rows (archive, content): every task rolls a new archive at ``archive_bytes`` of records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0

        def blob() -> pa.RecordBatch:
            content = build_archive(records)
            return pa.record_batch([pa.array([hashlib.sha1(content).hexdigest()]), pa.array([content], pa.binary())], ["archive", "content"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page, url, html, bytes_, digest, refers = row
                records.append(encode_record(page, url, (html or "").encode(), bytes_, digest, refers))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield blob()
                    records, size = [], 0
        if records:
            yield blob()

    html = F.when(F.col("refers_to").isNull(), F.col("html")).alias("html")
    rows = planned.select("page_id", "url", html, "payload_bytes", "payload_digest", "refers_to")
    return rows.mapInArrow(write, "archive string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of rows with a ``content`` blob (a table of archives, or Spark's ``binaryFile``)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in kinds]
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for record in read_records(content.as_py()):
                    rows.append(parse_record(record))
                    size += len(record)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds).select(names)

    kinds = pa.schema(
        [("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()),
         ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())]
    )
    return archives.select("content").mapInArrow(read, READ_SCHEMA)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``*.warc.zst`` files."""
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path))


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes all pages to archives in the shared scratch folder and reads every record back. Nulls, repeats and an empty
    table are as in ``plan_records``; very long payloads make archives of their own."""
    return read_archives(materialize(write_archives(plan_records(pages, least))))
