"""WARC archives through a table of chunks.

A record's payload becomes rows (record, chunk number) of at most ``CHUNK``
bytes, each with the digest of the payload up to its end, so an oversized
payload is never held again once it is read: neither by the writer, which
writes a chunk as a segment of its record (``continuation`` records), nor by
the reader, which takes an archive as Spark's line reader inflates it, cut at
its empty lines, and hashes on. No record and no archive is ever held whole.

An archive is what one task writes, through Spark's own writer to the shared
folder, so a lost executor's archives are written anew. Payloads that have
been archived already are recorded as revisits of the record with the least
page id.

Edge cases: a null payload is empty, a null url has no target; payloads of
fewer than ``LEAST`` bytes are never revisits; rows with one page id are
records of their own, and if that id is the least of its payload all of them
are responses; rows without id come after all others; an empty table gives an
empty result; other columns are not written.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import broadcast_up_to, checkpoint, shared_dir, table

CHUNK, LEAST = 1 << 16, 100
#: Bytes of chunks in one batch of rows.
BATCH = 1 << 22
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decided(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, n_bytes, digest, first``: first is the least
    page id with that payload where there are several."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    several = rows.where(F.col("n_bytes") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("digest", "first")
    return rows.join(broadcast_up_to(checkpoint(several), 200_000), "digest", "left")


def chunk_table(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk; ``running`` is the digest up to the chunk's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("running", pa.string()), ("data", pa.binary())])
        out, held = [], 0
        for batch in batches:
            for i in range(len(batch)):
                page, url, n, digest, refers = (batch.column(k)[i].as_py() for k in range(5))
                body = memoryview(batch.column(5)[i].as_buffer()) if refers is None else memoryview(b"")
                sha, at, number = hashlib.sha256(), 0, 0
                while number == 0 or at < len(body):
                    part = body[at : at + chunk]
                    sha.update(part)
                    at, number = at + len(part), number + 1
                    out.append((page, url, n, digest, refers, number, at >= len(body), sha.hexdigest(), bytes(part)))
                    held += len(part) + 200
                    if held >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    named = rows.select("page_id", "url", "n_bytes", "digest", F.when(later, F.col("first")).alias("refers_to"), "payload")
    return named.mapInArrow(run, "page_id long, url string, n_bytes long, digest string, refers_to long, chunk long, last boolean, running string, data binary")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def record(date: str = "2025-01-01T00:00:00Z") -> Column:
    """The bytes of a chunk's record, but for the empty lines at its end."""
    first, revisit = F.col("chunk") == 1, F.col("refers_to").isNotNull()
    own = F.when(first, _urn(F.col("page_id"))).otherwise(F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("chunk").cast("string"), F.lit(">")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).when(first, F.lit("response")).otherwise(F.lit("continuation"))),
        F.concat(F.lit("WARC-Record-ID: "), own),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("Page-Id: "), F.col("page_id").cast("string")),
        F.when(first, F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20]", "%20"))),
        F.when(first, F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))),
        F.when(first, F.concat(F.lit("Payload-Length: "), F.col("n_bytes").cast("string"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to")))),
        F.when(~first | ~F.col("last"), F.concat(F.lit("WARC-Segment-Number: "), F.col("chunk").cast("string"))),
        F.when(~first, F.concat(F.lit("WARC-Segment-Origin-ID: "), _urn(F.col("page_id")))),
        F.when(~first & F.col("last"), F.concat(F.lit("WARC-Segment-Total-Length: "), F.col("n_bytes").cast("string"))),
        F.when(~revisit, F.concat(F.lit("Running-Digest: sha256:"), F.col("running"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length("data").cast("string")),
    ]
    # Parts that are null (a missing url, say) leave no line.
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END)).cast("binary")


def write(pages: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Archives of ``pages`` (page_id, url, html) in the folder ``path``."""
    rows = chunk_table(decided(pages), chunk)
    whole = F.concat(record(), F.col("data")).cast("string")
    rows.select(whole.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


class _Stream:
    """Bytes of an archive, taken from its pieces as they are asked for."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def more(self) -> bool:
        part = next(self.pieces, None)
        if part is not None:
            self.held += part
        return part is not None

    def until(self, mark: bytes) -> bytes | None:
        while (i := self.held.find(mark)) < 0:
            if not self.more():
                return None
        out = bytes(self.held[:i])
        del self.held[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(pieces: Iterator[bytes], payload: bool) -> Iterator[tuple]:
    """Chunk rows of an archive, given as its bytes piece by piece; payloads
    are hashed on from chunk to chunk."""
    stream, sha, head, total = _Stream(pieces), hashlib.sha256(), {}, 0
    while (block := stream.until(END.encode())) is not None:
        if not block and not stream.held and not stream.more():
            return  # the rest of a last payload's own line end, see ``read``
        lines = block.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        got = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        kind, left = got["warc-type"], int(got["content-length"])
        if kind != "continuation":
            sha, head, total = hashlib.sha256(), got, 0
        number = int(got.get("warc-segment-number", 1))
        piece = 0
        while True:
            data = stream.take(min(left, CHUNK))
            if left and not data:
                raise ValueError("the archive ends within a record")
            left, total, piece = left - len(data), total + len(data), piece + 1
            sha.update(data)
            if left == 0:
                break
            yield head, number, piece, False, total, sha.hexdigest(), data if payload else None
        last = "warc-segment-number" not in got or "warc-segment-total-length" in got
        digest = sha.hexdigest()
        want = head.get("warc-payload-digest", "").removeprefix("sha256:")
        if last and head["warc-type"] != "revisit" and want and want != digest:
            raise ValueError(f"payload digest of {head['warc-record-id']}: {digest}, not {want}")
        yield head, number, piece, last, total, digest, data if payload else None
        if stream.take(4) != END.encode():
            raise ValueError("a record is not closed by empty lines")


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Chunk rows of all archives in ``path``; without ``payload`` their data
    stays where it is hashed. A record's last chunk has its whole digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("segment", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("data", pa.binary())])

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        def lines():
            for batch in batches:
                yield from zip(batch.column(0), batch.column(1), strict=True)

        for _, archive in groupby(lines(), key=lambda x: x[0].as_py()):
            out, held = [], 0
            for head, segment, piece, last, total, digest, data in parse((x.as_py() + END.encode() for _, x in archive), payload):
                page, refers = head.get("page-id"), head.get("warc-refers-to")
                revisit = head["warc-type"] == "revisit"
                out.append((int(page) if page else None, head.get("warc-target-uri"), head["warc-type"], int(refers.strip("<>").rpartition(":")[2]) if refers else None, segment, piece, last, int(head["payload-length"]) if revisit else total, head["warc-payload-digest"].removeprefix("sha256:") if revisit else digest, data))
                held += 200 + len(data or b"")
                if held > BATCH:
                    yield rows(out)
                    out, held = [], 0
            if out:
                yield rows(out)

    # Spark inflates a compressed archive as it goes and hands it over in order, cut at empty lines. If the last payload ends in
    # a line end, that is left over behind the last cut and looks like one more line: then four bytes too many are put back.
    files = spark.read.option("lineSep", END).text(path).select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("value"))
    return files.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, segment long, chunk long, last boolean, payload_bytes long, digest string, data binary")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4()}"
    write(table(spark, sf_dir, "pages"), path)
    found = read(spark, path, payload=False).where("last")
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
       case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
       case when first <> page_id then first end as refers_to
from d left join f using (payload_digest)
"""
