"""WARC archives as a table of record chunks.

A record (header, payload, closing blank lines) is stored as rows of its
identifier, a chunk number and at most CHUNK bytes; joined in order, the
chunks of an archive are a WARC/1.1 file.

Writing takes two passes over the pages where they lie. The first carries a
digest over each payload piece by piece, and gives a short row for each page:
these are what is compared, so no payload moves for it. The second cuts
payloads into chunks before anything is shuffled; then the chunks of a record
meet its short row, which gives the header and says whether they are kept.
Readers carry a digest and the header's bytes from chunk to chunk. So beyond
the scan of a table that has whole payloads as values, nothing holds a record.

Payloads of REVISIT_BYTES or more that occur again are written once, as the
response of the smallest id; the others revisit it. Null payloads are empty.
Null urls, and those of a table without the column, are empty, and line ends in
them are percent-encoded; so is whatever in an id isn't plain. Ids may be
numbers or strings. Records with a null id never are what others revisit,
unless all of a payload's are null; then all are responses. Repeated rows give
repeated records; of those with the id that others revisit, all are responses.
Empty tables give empty archives; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, whole

CHUNK, BATCH_BYTES = 1 << 20, 4 << 20
REVISIT_BYTES = 100
URN, NO_ID = "urn:page:", "urn:nopage:"
RECORD = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, intact boolean"


def _header(response: Column, key: Column, url: Column, digest: Column, n: Column, refers: Column, written: str) -> Column:
    id_ = lambda c: F.concat(F.lit("<"), F.coalesce(F.concat(F.lit(URN), F.url_encode(c.cast("string"))), F.lit(NO_ID)), F.lit(">\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit("\r\n\r\n"))
    safe = F.regexp_replace(F.regexp_replace(whole(url), "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(response, "response").otherwise("revisit"), F.lit("\r\nWARC-Record-ID: "), id_(key),
        F.lit(f"WARC-Date: {written}\r\nWARC-Target-URI: "), safe, F.lit("\r\nWARC-Payload-Digest: sha256:"), digest, F.lit("\r\nX-Payload-Length: "), n.cast("string"), F.lit("\r\n"),
        F.when(response, F.lit("")).otherwise(F.concat(F.lit("WARC-Refers-To: "), id_(refers), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), (F.length(http) + F.when(response, n).otherwise(0)).cast("string"), F.lit("\r\n\r\n"), http,
    ).cast("binary")


def _payload(column: pa.Array, i: int) -> memoryview:
    return memoryview(column[i].as_buffer() or b"")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sizes = [], []
        for i in range(batch.num_rows):
            data, digest = _payload(batch.column("payload"), i), hashlib.sha256()
            for at in range(0, len(data), CHUNK):
                digest.update(data[at : at + CHUNK])
            digests.append(digest.hexdigest())
            sizes.append(len(data))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("h"), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], names=["key", "h", "digest", "n"])


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Pages to rows of a header's place (chunk 0), the payload's chunks, and the end."""
    context = TaskContext.get()
    record = (context.partitionId() if context else 0) << 32
    for batch in batches:
        rows: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            pages = pa.array([r[0] for r in rows], pa.int64())
            columns = [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.bool_()), pa.array([r[4] for r in rows], pa.binary())]
            return pa.RecordBatch.from_arrays([*[batch.column(c).take(pages) for c in ("key", "h", "url")], *columns], names=["key", "h", "url", "record", "chunk", "body", "bytes"])

        for i in range(batch.num_rows):
            data = _payload(batch.column("payload"), i)
            parts = -(-len(data) // chunk)
            rows.append((i, record, 0, False, None))
            for k in range(parts):
                rows.append((i, record, k + 1, True, data[k * chunk : (k + 1) * chunk]))
                size += len(rows[-1][4])
                if size >= BATCH_BYTES:
                    yield made()
                    rows, size = [], 0
            rows.append((i, record, parts + 1, False, b"\r\n\r\n"))
            record += 1
        if rows:
            yield made()


def to_chunks(pages: DataFrame, scratch: Scratch, chunk: int = CHUNK, id_col: str = "page_id", payload_col: str = "html", written: datetime | None = None) -> DataFrame:
    """The chunk rows (record, chunk, bytes) of an archive of pages, dated written (now, if None)."""
    kind = dict(pages.dtypes)[id_col]
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("key"), url.alias("url"), whole(F.col(payload_col)).cast("binary").alias("payload")).withColumn("h", F.xxhash64("payload"))
    signed = scratch.keep(rows.select("key", "h", "payload").mapInArrow(_digests, f"key {kind}, h long, digest string, n long").distinct(), "digests")
    first = scratch.keep(signed.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.min("key").alias("refers")).where("refers is not null"), "first")
    kinds = signed.join(first, "digest", "left").withColumn("response", F.col("refers").isNull() | F.col("key").eqNullSafe(F.col("refers")))
    kinds = scratch.keep(kinds.withColumnsRenamed({"key": "k", "h": "kh"}), "kinds").hint("merge")  # the same plan at every size
    cut = rows.mapInArrow(lambda it: _chunks(it, chunk), f"key {kind}, h long, url string, record long, chunk long, body boolean, bytes binary")
    own = cut.join(kinds, F.col("key").eqNullSafe(F.col("k")) & (F.col("h") == F.col("kh"))).where("response or not body")
    date = (written or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    header = _header(F.col("response"), F.col("key"), F.col("url"), F.col("digest"), F.col("n"), F.col("refers"), date)
    return own.select("record", "chunk", F.coalesce("bytes", header).alias("bytes"))


class Reader:
    """Reads one record chunk by chunk: WARC and HTTP headers are parsed, payload bytes are digested and let go."""

    def __init__(self):
        self.head, self.fields, self.digest, self.left, self.n, self.bad = b"", None, hashlib.sha256(), None, 0, False

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            warc, gap, rest = self.head.partition(b"\r\n\r\n")
            http, gap2, rest = rest.partition(b"\r\n\r\n")
            if not (gap and gap2):
                return
            lines = warc.decode("utf-8").split("\r\n")
            self.bad = not lines[0].startswith("WARC/1.")
            self.fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
            self.left = int(self.fields.get("Content-Length", 0)) - len(http) - 4
            self.head, data = b"", rest
        body = data[: self.left]
        self.digest.update(body)
        self.n += len(body)
        self.left -= len(body)

    def record(self) -> dict:
        f = self.fields or {}
        key = lambda s: unquote_plus(s[1 + len(URN) : -1]) if s and s.startswith(f"<{URN}") else None
        said, n = f.get("WARC-Payload-Digest", "").removeprefix("sha256:"), int(f.get("X-Payload-Length", self.n))
        revisit = f.get("WARC-Type") == "revisit"
        return {
            "page_id": key(f.get("WARC-Record-ID")), "url": f.get("WARC-Target-URI"), "payload_bytes": n if revisit else self.n,
            "payload_digest": said if revisit else self.digest.hexdigest(), "record_type": f.get("WARC-Type"), "refers_to": key(f.get("WARC-Refers-To")),
            "intact": not self.bad and self.fields is not None and self.left == 0 and (revisit or (said == self.digest.hexdigest() and n == self.n)),
        }


def _parse(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    now, reader, out = None, None, []
    for batch in batches:
        ids, data = batch.column("record").to_pylist(), batch.column("bytes")
        for i, r in enumerate(ids):
            if r != now:
                if reader:
                    out.append(reader.record())
                now, reader = r, Reader()
            reader.feed(data[i].as_py())
        if len(out) >= 5000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if reader:
        out.append(reader.record())
    yield pa.RecordBatch.from_pylist(out, schema)


def records(chunks: DataFrame) -> DataFrame:
    """The records of a chunk table, each read by its chunks in order; intact: complete, and its digest agrees."""
    text = pa.string()
    schema = pa.schema([("page_id", text), ("url", text), ("payload_bytes", pa.int64()), ("payload_digest", text), ("record_type", text), ("refers_to", text), ("intact", pa.bool_())])
    rows = chunks.select("record", "chunk", "bytes").repartition("record").sortWithinPartitions("record", "chunk")
    return rows.mapInArrow(lambda it: _parse(it, schema), RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Writes pages as an archive in the shared folder and reads its records back."""
    kind = dict(pages.dtypes)[id_col]
    scratch = Scratch(spark, "warc")
    archive = scratch.keep(to_chunks(pages, scratch, id_col=id_col), "archive")
    return records(archive).withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def save_file(chunks: DataFrame, path: str) -> None:
    """Writes a chunk table as one WARC file, streaming one partition at a time to the driver's disk."""
    with open(path, "wb") as f:
        for row in chunks.repartitionByRange("record", "chunk").sortWithinPartitions("record", "chunk").toLocalIterator():
            f.write(row.bytes)
