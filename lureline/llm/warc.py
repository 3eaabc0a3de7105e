"""WARC archives, each with its own Zstandard dictionary, written and read through Spark.

An archive is a ``.warc.zst`` stream: a leading skippable frame that holds a dictionary trained on the
records of this archive, then one frame per record, so that any record can be read from its offset.
Spark's text writer puts the frames on the shared file system with its commit protocol; a lost executor
costs the attempt of one task. The writer's line separator is an empty skippable frame, which every
Zstandard reader passes over.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm.common import join_on, map_arrow, narrow, table
from lureline.shared import new_path

SHORT = 1000                  # payloads below this many bytes are always stored
ARCHIVE_BYTES = 8 << 20       # payload bytes after which an archive is closed
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20        # of an archive's records that its dictionary is trained on, spread over all of them
SAMPLE_RECORD_BYTES = 128 << 10  # of one such record; the trainer weighs records alike, however long; archives hold all of it
# Fixed values of the file formats.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
CRLF = b"\r\n"
DATE = "1970-01-01T00:00:00Z"  # the table holds no capture time

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, payload: bytes,
           refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds the response head only, which tells the payload's length."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n").encode()
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
             f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF + CRLF + block + CRLF + CRLF


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Dictionary of the archive's records, or none where they are too few or too alike to train on."""
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    samples = [r[:SAMPLE_RECORD_BYTES] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes]) -> tuple[bytes, bytes]:
    """The leading dictionary frame (an empty frame if there is none) and the records' frames."""
    dictionary = train(records)
    first = EMPTY_FRAME
    if dictionary is not None:
        raw = dictionary.as_bytes()
        first = struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
    packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
    return first, b"".join(map(packer.compress, records))


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows for each archive, its first frame and the others; the writer makes a file of two rows."""
    def closed(records):
        return pa.RecordBatch.from_arrays([pa.array(archive(records), pa.binary())], ["frames"])

    records, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            page_id, url, payload, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
            kind = "response" if refers_to is None else "revisit"
            records.append(record(kind, page_id, url, digest, len(payload), payload, refers_to))
            size += len(records[-1])
            if size >= ARCHIVE_BYTES:
                yield closed(records)
                records, size = [], 0
    if records:
        yield closed(records)


def write(df: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url",
          payload_column: str = "html", short: int = SHORT) -> None:
    """A record for each row of ``df`` in archives below ``path``.

    Of rows with equal payloads of ``short`` bytes or more, those with the largest id are responses and
    the others revisit it; null ids never are the largest, and are all responses if no row of the group
    has an id. A null payload is empty. Repeated rows give repeated records, an empty table no archive.
    Groups are found on digests that combine before the shuffle; payloads move once, by id.
    """
    pages = narrow(df, page_id=id_column, url=url_column, payload=payload_column)
    pages = pages.withColumn("payload", F.coalesce("payload", F.lit("")).cast("binary"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    long = pages.where(F.octet_length("payload") >= short).select(
        "page_id", F.col("digest").alias("_digest"), F.xxhash64("payload").alias("_check"))
    groups = long.groupBy("_digest", "_check").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n"))
    groups = groups.where("_n > 1 AND refers_to IS NOT NULL")
    revisits = long.join(groups, ["_digest", "_check"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = revisits.select("page_id", F.col("_digest").alias("digest"), "refers_to").distinct()
    rows = join_on(pages, revisits, ["page_id", "digest"], "left")
    rows = rows.select("page_id", "url", "payload", "digest", "refers_to")
    frames = map_arrow(rows, _archives, "frames binary").select(F.col("frames").cast("string").alias("value"))
    frames.write.option("lineSep", EMPTY_FRAME.decode("ascii")).option("maxRecordsPerFile", 2).text(path)


def unpacked(content: bytes) -> bytes:
    """All records of an archive, with the dictionary of its leading frame."""
    magic, size = struct.unpack_from("<II", content)
    dictionary = zstandard.ZstdCompressionDict(content[8:8 + size]) if magic == DICTIONARY_MAGIC else None
    with zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(content, read_across_frames=True) as reader:
        return reader.read()


_ID = re.compile(rb"<urn:page:(-?\d+)>")


def parsed(data: bytes) -> Iterator[tuple]:
    """page_id, url, record_type, payload_bytes, declared digest, refers_to and payload (null for revisits)."""
    at = 0
    while at < len(data):
        end = data.index(CRLF + CRLF, at)
        fields = dict(line.split(b": ", 1) for line in data[at:end].split(CRLF)[1:])
        start = end + 4
        stop = start + int(fields[b"Content-Length"])
        body = data.index(CRLF + CRLF, start, stop) + 4
        http = dict(line.split(b": ", 1) for line in data[start:body - 4].split(CRLF)[1:])
        kind = fields[b"WARC-Type"].decode()
        own, other = _ID.search(fields[b"WARC-Record-ID"]), _ID.search(fields.get(b"WARC-Refers-To", b""))
        yield (int(own[1]) if own else None, fields[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in fields else None,
               kind, int(http[b"Content-Length"]), fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode(),
               int(other[1]) if other else None, data[body:stop] if kind == "response" else None)
        at = stop + 4


RECORDS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload", T.BinaryType())])
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows = list(parsed(unpacked(content.as_py())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS)], RECORDS.names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``; a revisit's payload is that of the record it refers to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return map_arrow(files.select("content"), _read, RECORDS)


def op6_warc_dictionary(spark, sf_dir):
    """Response digests are computed again from the payloads that were read back."""
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    stored = F.col("record_type") == "response"
    return read(spark, path).select(
        "page_id", F.when(stored, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("bigint").alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to")


QUERIES = {"op6_warc_dictionary": op6_warc_dictionary}
SQL = {"op6_warc_dictionary": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
 g AS (SELECT h, max(page_id) AS last FROM p WHERE strlen(h) >= {SHORT} GROUP BY h)
SELECT p.page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
 CASE WHEN last IS NULL OR last IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN last IS NULL OR last IS NOT DISTINCT FROM page_id THEN NULL ELSE last END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h"""}
