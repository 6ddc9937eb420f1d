"""Operator 9: WARC archives with revisit records, read back by boundary-chain verification.

Writing: records are text rows that Spark's text writer ends with the record separator, so archives are
real uncompressed WARC files in the shared folder. Of equal payloads of some size, one record is the
response and the others are revisits that keep only the HTTP header.

Reading: each archive's task notes every position of the record magic, payloads included, as a candidate,
with the offset at which its block's length says that the next record begins. Pointer jumping from the
file's start keeps the candidates on the chain of records; magic inside payloads is not on it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import checkpointed, new_folder

MAGIC = b"WARC/1.0\r\n"
SEPARATOR = "\r\n\r\n"
#: Fixed, so that an archive depends on its pages alone.
DATE = "2024-01-01T00:00:00Z"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean, file string, record_offset long"


def with_revisits(pages: DataFrame, *, min_payload: int = 1000, max_broadcast_rows: int = 500_000) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest``, and ``target``: the page that the record revisits, or null.

    Digests that occur again, of 50 bytes each, are broadcast if they are counted to be at most ``max_broadcast_rows``, so
    that payloads need not be shuffled; beyond that a shuffled join gives the same rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= min_payload)
    # Read from the checkpoint, this side is a plain scan, so the join can split a hot digest.
    groups = checkpointed(large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("same"), "last"))
    if groups.count() <= max_broadcast_rows:
        groups = F.broadcast(groups)
    joined = rows.join(groups, F.col("digest") == F.col("same"), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("target"))


def write(pages: DataFrame, folder: str, *, min_payload: int = 1000, records_per_file: int = 20_000) -> None:
    """Writes a record per page (``page_id``, ``url``, ``html``; other columns are ignored) to archives in ``folder``.

    Null html is an empty payload; a null url has no target header; repeated page ids get a record
    each, all but one of equal payloads of a page id being told apart only by their place; an empty table gives no records.
    """
    rows = with_revisits(pages, min_payload=min_payload)
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    revisit = F.col("target").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", "[\\x00-\\x20]", "%20")), F.lit("")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("target")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"),
    )
    rows.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", records_per_file).text(folder)


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[dict[bytes, bytes], int, int]]]:
    """All positions of the magic whose header can be read, the offsets at which their records say that the next one begins, and header, begin and end of each block."""
    starts, nexts, parts = [], [], []
    for m in re.finditer(re.escape(MAGIC), data):
        end = data.find(b"\r\n\r\n", m.start())
        if end < 0:
            continue
        fields = {}
        for line in data[m.end() : end].split(b"\r\n"):
            name, colon, value = line.partition(b":")
            if colon:
                fields[name.strip().lower()] = value.strip()
        length = fields.get(b"content-length", b"")
        if not length.isdigit():
            continue
        begin = end + 4
        starts.append(m.start())
        nexts.append(begin + int(length) + len(SEPARATOR))
        parts.append((fields, begin, begin + int(length)))
    return np.array(starts, np.int64), np.array(nexts, np.int64), parts


def chain(starts: np.ndarray, nexts: np.ndarray, size: int) -> np.ndarray:
    """Which candidates are reached from offset 0, by pointer jumping; the file's end is the last successor."""
    n = len(starts)
    place = np.searchsorted(starts, nexts)
    found = (place < n) & (starts[np.minimum(place, max(n - 1, 0))] == nexts) if n else np.zeros(0, bool)
    jump = np.append(np.where(found, place, n), n)
    reached = np.zeros(n + 1, bool)
    reached[0] = bool(n) and starts[0] == 0
    for _ in range(max(1, n.bit_length() + 1)):
        reached[jump[reached]] = True
        jump = jump[jump]
    return reached[:n] & (nexts <= size)


def _number(urn: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", urn or b"")
    return int(found[1]) if found else None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives in ``folder``, with its full payload's size and SHA-1.

    ``intact``: the stored payload has the stated digest (revisits store none, and are taken at their word). A torn last record is left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                starts, nexts, parts = candidates(data)
                rows = []
                for k in np.flatnonzero(chain(starts, nexts, len(data))):
                    fields, begin, end = parts[k]
                    kind = fields.get(b"warc-type", b"").decode()
                    stated = fields.get(b"warc-payload-digest", b"").decode().partition(":")[2]
                    gap = data.find(b"\r\n\r\n", begin, end)
                    if kind == "response":
                        payload = data[gap + 4 : end] if gap >= 0 else data[begin:end]
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    else:
                        told = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", data[begin : gap + 2] if gap >= 0 else b"")
                        size, digest = int(told[1]) if told else None, stated
                    rows.append((_number(fields.get(b"warc-record-id")), size, digest, kind, _number(fields.get(b"warc-refers-to")), digest == stated, path, int(starts[k])))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", "file", "record_offset"]
                columns = list(zip(*rows, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(folder)
    return files.select("path", "content").mapInArrow(run, READ_SCHEMA)


def round_trip(pages: DataFrame, **options: int) -> DataFrame:
    """Writes ``pages`` to archives in the session's shared folder and reads their records back."""
    folder = new_folder(pages.sparkSession, "warc")
    write(pages, folder, **options)
    return read(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS d FROM p),
g AS (SELECT d, max(page_id) AS last FROM s WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, s.d AS payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to, true AS intact
FROM s LEFT JOIN g ON s.d = g.d AND s.n >= 1000
"""
