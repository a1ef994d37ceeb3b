"""WARC writing with revisit resolution, and reading the archives back.

Headers (id, payload digest, length) are shuffled by digest, without payloads: the smallest id of a digest is the
original, and the other records join it as revisits, which are written from their headers alone. Payloads move once,
by id, to meet the list of originals, so that a payload which a third of all pages share stays spread.
Archives are WARC/1.1 with a gzip member for each record, so a record can be read by itself: the index
(a row for each record: file, offset, length) is the only list of what was written, and a repeated task
leaves at most a file that no index names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.common import cut, id_of, scratch, shown_id, text_of

#: RFC 4648 base32 alphabet, and the profile of a revisit.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records and bytes after which an archive is closed.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 1024, 64 << 20


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds original to (id, uri, sha1, bytes): the smallest id with the same digest, null for a response that stands alone.

    Payloads of fewer than ``least_bytes`` bytes have no original, so they are never revisits.
    """
    firsts = headers.filter(F.col("bytes") >= least_bytes).groupBy("sha1").agg(F.min("id").alias("original"))
    return headers.join(firsts, "sha1", "left")


def record(date: str, id: int, uri: str, sha1: str, size: int, original: int | None, payload: bytes) -> bytes:
    """One record: header block, empty line, block, two line ends."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri.replace(chr(13), '').replace(chr(10), '')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        *([f"WARC-Refers-To: <urn:page:{original}>", f"WARC-Profile: {REVISIT}"] if original is not None else []),
        "Content-Type: text/html",
        f"Content-Length: {len(payload)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


_INDEX = "id long, file string, offset long, length long"


def _written(folder: str, date: str):
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        rows: list[tuple] = []
        members: list[bytes] = []

        def archive() -> pa.RecordBatch:
            nonlocal rows, members
            name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, []
            with fs.open_output_stream(f"{path}/{name}", compression=None) as sink:
                for i, m in zip(rows, members, strict=True):
                    sink.write(m)
                    out.append((i, f"{folder}/{name}", at, len(m)))
                    at += len(m)
            rows, members = [], []
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["id", "file", "offset", "length"])

        size = 0
        for batch in batches:
            for id, *head, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(id)
                members.append(gzip.compress(record(date, id, *head, (payload or "").encode()), 6, mtime=0))
                size += len(members[-1])
                if len(rows) == ARCHIVE_RECORDS or size > ARCHIVE_BYTES:
                    yield archive()
                    size = 0
        if rows:
            yield archive()

    return written


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of (page_id, url, html) into archives below ``path``; returns their index, a table there.

    A null html is empty, a null url too; a null page_id sorts last. Rows that repeat the page_id of an
    original with its payload are all written as responses.
    """
    spark = pages.sparkSession
    payload = text_of("html")
    rows = pages.select(id_of("page_id").alias("id"), text_of("url").alias("uri"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"))
    told = resolve(rows, least_bytes)
    revisits = told.filter("original <> id").select("id", "uri", "sha1", "bytes", "original", F.lit(None).cast("string").alias("payload"))
    later = told.filter("original <> id").select("id", "sha1").distinct()
    whole = pages.select(id_of("page_id").alias("id"), text_of("url").alias("uri"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"), payload.alias("payload"))
    responses = whole.join(later, ["id", "sha1"], "left_anti").withColumn("original", F.lit(None).cast("long"))
    columns = ["id", "uri", "sha1", "bytes", "original", "payload"]
    index = responses.select(*columns).unionByName(revisits.select(*columns)).mapInArrow(_written(f"{path}/archives", date), _INDEX)
    index.write.parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark, path: str) -> DataFrame:
    """id, file, offset, length of every record below ``path``."""
    return spark.read.schema(_INDEX).parquet(f"{path}/index")


_SCHEMA = pa.schema(
    [("id", pa.int64()), ("type", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("refers", pa.int64()), ("payload", pa.string()), ("whole", pa.bool_())]
)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records by their index rows; digest and bytes of a response are those of the payload that was read."""
    held, name = None, None
    for batch in batches:
        rows: dict[str, list] = {f.name: [] for f in _SCHEMA}
        size = 0
        for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
            if file != name:
                fs, path = pa.fs.FileSystem.from_uri(file)
                held, name = fs.open_input_file(path), file
            held.seek(offset)
            data = gzip.decompress(held.read(length))
            end = data.index(b"\r\n\r\n")
            head = dict(x.split(": ", 1) for x in data[:end].decode().split("\r\n")[1:])
            payload = data[end + 4 : end + 4 + int(head["Content-Length"])]
            number = lambda key: int(head[key].rpartition(":")[2][:-1]) if key in head else None  # noqa: B023, E731
            said, is_revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
            digest = said if is_revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
            values = number("WARC-Record-ID"), head["WARC-Type"], head["WARC-Target-URI"], digest, None if is_revisit else len(payload), number("WARC-Refers-To"), payload.decode(), digest == said
            for column, v in zip(rows.values(), values, strict=True):
                column.append(v)
            size += len(payload)
            if size > 1 << 22:
                yield pa.RecordBatch.from_pydict(rows, schema=_SCHEMA)
                rows, size = {f.name: [] for f in _SCHEMA}, 0
        yield pa.RecordBatch.from_pydict(rows, schema=_SCHEMA)


def read_archives(index: DataFrame) -> DataFrame:
    """id, type, uri, digest, bytes, refers, payload, whole of every record of the index, or of a part of it.

    digest and bytes of a response are computed from the payload read, and ``whole`` tells whether its header says the
    same; those of a revisit are its header's digest and null, for its payload is in the record it refers to.
    """
    return index.mapInArrow(_records, "id long, type string, uri string, digest string, bytes long, refers long, payload string, whole boolean")


def revisit_table(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes archives of ``pages`` to the shared folder, reads them back and returns a row per record.

    page_id, payload_bytes, payload_digest, record_type, refers_to; an empty table gives no rows. A revisit takes bytes and
    digest from the response it refers to, as read; a record whose payload is not what its header says fails the job, and so
    does a revisit whose response is not among the records.
    """
    return resolved(write_archives(pages, scratch(pages.sparkSession, "warc"), least_bytes))


def resolved(index: DataFrame) -> DataFrame:
    """The rows of ``revisit_table`` of the records that an index names."""
    fails = F.raise_error(F.concat(F.lit("payload and digest differ in record "), F.col("id"))).cast("string")
    read = read_archives(index).withColumn("digest", F.when(F.col("whole"), F.col("digest")).otherwise(fails))
    read = cut(read.select("id", "type", "digest", "bytes", "refers"))  # archives are read once
    # one response stands for all with its id and digest; they have equal payloads
    told = read.filter("type = 'response'").groupBy("id", "digest").agg(F.first("bytes").alias("of_bytes")).withColumnsRenamed({"id": "of", "digest": "of_digest"})
    revisits = read.filter("type = 'revisit'")
    joined = revisits.join(told, (F.col("refers") == F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
    lost = F.raise_error(F.concat(F.lit("no response for the revisit in record "), F.col("id"))).cast("string")
    joined = joined.select("id", "type", F.when(F.col("of").isNotNull(), F.col("of_digest")).otherwise(lost).alias("digest"), F.col("of_bytes").alias("bytes"), "refers")
    out = read.filter("type = 'response'").unionByName(joined)
    return out.select(
        shown_id("id").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        shown_id("refers").alias("refers_to"),
    )


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS o FROM p),
q AS (SELECT *, list_transform(range(8), lambda k: CAST('0x' || substr(h, CAST(5 * k + 1 AS INT), 5) AS BIGINT)) AS v FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('{BASE32}', CAST(((x >> s) & 31) + 1 AS INT), 1)), '')), '') AS payload_digest,
       CASE WHEN o = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN o <> page_id THEN o END AS refers_to
FROM q
"""
