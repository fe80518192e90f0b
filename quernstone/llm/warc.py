"""A WARC writer whose archives carry their own Zstandard dictionary, and the reader of its archives.

An archive starts with a skippable frame that holds the dictionary, as the WARC-Zstandard convention asks; each
record is one frame compressed with it. A task begins a new archive, with the dictionary in front, when the one at hand
has reached ``ARCHIVE_BYTES``, so archives and what a task holds are bounded whatever the size of a partition. Spark
writes the archives to the shared folder itself: an archive is a row, and a file takes one row. Its text writer ends
every row with a line feed, which is the single content byte of a last skippable frame; readers skip it.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.labelled import smallest
from quernstone.session import scratch_dir, written

REVISIT_FROM = 1000  # bytes
SAMPLE_PARTS = 1500  # parts of records that train the dictionary
SAMPLE_CHARS = 4096
BATCH_BYTES = 16 << 20  # payloads that one batch of records read back holds
ARCHIVE_BYTES = 32 << 20  # compressed; the record that reaches it is the archive's last
DICTIONARY = 64 << 10
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE_FRAME = 0x184D2A50
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_TAIL = struct.pack("<II", SKIPPABLE_FRAME, 1)


def record_id(page_id: int | None) -> str:
    """The id of a page's record; a page without an id has a name of its own."""
    return "<urn:page:>" if page_id is None else f"<urn:page:{page_id}>"


def page_of(record: str) -> int | None:
    number = record[len("<urn:page:") : -1]
    return int(number) if number else None


def head(kind: str, page_id: int | None, url: str | None, size: int, digest: str, refers: int | None, block: int) -> bytes:
    """The header of a record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers is not None:
        lines += [f"WARC-Refers-To: {record_id(refers)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {block}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def planned(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, payload_bytes, payload_digest, record_type and refers_to.

    Of payloads that are equal and have at least REVISIT_FROM bytes the largest page_id is the response. A null html
    is an empty payload. A page with a null id is always a response and nothing refers to it.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    # SHA-1 alone is known to collide: payloads are equal if their lengths and SHA-256 are as well
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha1("payload"), "same": F.sha2("payload", 256)})
    key = ["same", "payload_digest", "payload_bytes"]
    small = rows.where(F.col("payload_bytes") < REVISIT_FROM).withColumn("refers_to", F.lit(None).cast("long"))
    large = rows.where(F.col("payload_bytes") >= REVISIT_FROM)
    several = large.groupBy(*key).agg(F.max("page_id").alias("last"), F.min("page_id").alias("first")).where("first < last").drop("first")
    large = large.join(written(several, "last"), key, "left")
    large = large.withColumn("refers_to", F.when(F.col("page_id") < F.col("last"), F.col("last"))).drop("last")
    return large.unionByName(small).drop("same")


def trained(pages: DataFrame) -> bytes:
    """A dictionary from at most SAMPLE_PARTS parts of records, chosen by a hash.

    Whole payloads are cut into parts of SAMPLE_CHARS characters, and every part of every payload may be chosen. Where
    the trainer has too little to go by, the last DICTIONARY bytes of the parts themselves are the dictionary; without
    any part it is a bare record header. So every archive is compressed with a dictionary.
    """
    parts = F.sequence(F.lit(0), F.floor((F.length("html") - 1) / SAMPLE_CHARS))
    rows = pages.where("page_id is not null and length(html) > 0").select("page_id", F.explode(parts).alias("part"))
    few = smallest(rows.select(F.struct("page_id", "part").alias("id")), SAMPLE_PARTS, 9)
    few = few.select(F.col("id.page_id").alias("of"), F.col("id.part").alias("part")).distinct()
    some = pages.join(F.broadcast(few), pages.page_id == few.of).select("of", "part", F.substr("html", F.col("part") * SAMPLE_CHARS + 1, F.lit(SAMPLE_CHARS)).alias("piece"))
    rows = some.groupBy("of", "part").agg(F.min("piece").alias("piece")).orderBy("of", "part").collect()
    pieces = [(head("response", r.of, "http://example.com/", 1, "0" * 40, None, 1) + http_head(1) if r.part == 0 else b"") + r.piece.encode() for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short parts
        plain = head("response", 0, "http://example.com/", 1, "0" * 40, None, 1) + http_head(1)
        return b"".join([*pieces, plain])[-DICTIONARY:]


def archives(rows: DataFrame, dictionary: bytes, path: str, limit: int = ARCHIVE_BYTES) -> None:
    """Write ``rows`` of :func:`planned` as WARC archives of about ``limit`` bytes under ``path``."""
    shared = rows.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        raw = shared.value
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw))
        first = struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw
        out, size = [first], 0

        def archive():
            return pa.RecordBatch.from_arrays([pa.array([b"".join([*out, _TAIL])], pa.binary())], names=["archive"])

        for batch in batches:
            for page_id, url, payload, n, digest, refers in zip(*[batch.column(c) for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")], strict=True):
                page_id, url, payload, n, digest, refers = (v.as_py() for v in (page_id, url, payload, n, digest, refers))
                block = http_head(n) + (payload if refers is None else b"")
                kind = "response" if refers is None else "revisit"
                record = head(kind, page_id, url, n, digest, refers, len(block)) + block + b"\r\n\r\n"
                out.append(packer.compress(record))
                size += len(out[-1])
                if size >= limit:
                    yield archive()
                    out, size = [first], 0
        if size:
            yield archive()

    rows = rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    made = rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to").mapInArrow(run, "archive binary")
    # the bytes pass through a string column as they are: the text writer is Spark's only sink for raw bytes
    made.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of the records under ``path``.

    Sizes and digests of responses are taken from the payload itself, those of revisits from their headers.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                records, size = [], 0
                for record in _records(content.as_buffer()):
                    records.append(record)
                    size += len(record[-1] or b"")
                    if size >= BATCH_BYTES or len(records) >= 10_000:
                        yield _batch(records)
                        records, size = [], 0
                if records:
                    yield _batch(records)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _batch(records: list[tuple]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*records, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _records(raw):
    view = memoryview(raw)
    magic, size = struct.unpack_from("<II", view)
    if magic != DICTIONARY_FRAME:
        raise ValueError("an archive without a dictionary frame")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size])))
    at = 8 + size
    while at < len(view):
        if struct.unpack_from("<I", view, at)[0] & 0xFFFFFFF0 == SKIPPABLE_FRAME:
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            continue
        frame = unpacker.decompressobj()
        pieces, step = [], 1 << 16
        while not frame.eof:
            part = view[at : at + step]
            pieces.append(frame.decompress(part))
            at += len(part)
        at -= len(frame.unused_data)
        record = b"".join(pieces)
        top, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
        http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
        page_id = page_of(fields["WARC-Record-ID"])
        if fields["WARC-Type"] == "revisit":
            size = int(http.rpartition(b"Content-Length: ")[2])
            yield page_id, size, fields["WARC-Payload-Digest"][5:], "revisit", page_of(fields["WARC-Refers-To"]), None
        else:
            yield page_id, len(payload), hashlib.sha1(payload).hexdigest(), "response", None, payload


def op9(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, and rows that repeat are records of their own. A payload of whatever length is one
    record; the archive that holds it is as large. Extra columns are not read; an empty table makes no archive.
    """
    spark = pages.sparkSession
    path = f"{scratch_dir(spark)}/warc-{np.random.default_rng().integers(1 << 62):x}"
    archives(planned(pages), trained(pages), path)
    return read_archives(spark, path).drop("payload")


OP9_SQL = """
SELECT page_id, octet_length(p) AS payload_bytes, sha1(p) AS payload_digest,
       CASE WHEN octet_length(p) >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(p) >= 1000 AND page_id < last THEN last END AS refers_to
FROM (SELECT page_id, encode(coalesce(html, '')) AS p, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
"""
