"""WARC archives with revisit records: writing, reading, and resolving equal payloads."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.operators.storage import materialize

# Fixed values of the WARC 1.1 format.
CRLF = "\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: One archive holds so many records at most; a reader holds the compressed archive whole.
RECORDS_PER_FILE = 10_000
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: every 5 hex digits are 4 base32 digits."""
    hexed = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The originals of payloads that occur more than once: (digest, bytes, original, original_url).

    ``headers`` has (id, url, digest, bytes). Only headers are shuffled, by digest, and each task sums
    them first, so a payload that a third of all records hold costs no task more. The original is the record with the
    smallest id (null last). Payloads under ``min_bytes`` are never revisits.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("nil"), "id", "url"))
    groups = headers.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.count("*").alias("n"), first.alias("o"))
    return groups.where("n > 1").select("digest", "bytes", F.col("o.id").alias("original"), F.col("o.url").alias("original_url"))


def _clean(url: Column) -> Column:
    """A header value can't hold line ends."""
    return F.regexp_replace(url, r"[\r\n]", "%0A")


def _urn(id_: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(">"))


def record_text(id_: Column, url: Column, payload: Column, digest: Column, size: Column, original: Column, original_url: Column, is_revisit: Column, date: str = DATE) -> Column:
    """A WARC record without its closing line ends.

    A response holds the HTTP head and the payload; a revisit holds the HTTP head alone, whose
    Content-Length is that of the payload left out.
    """
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(RECORD_END))
    line = lambda name, value: F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)))
    none = F.lit(None).cast("string")
    block = F.when(is_revisit, head).otherwise(F.concat(head, payload))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(CRLF),
        line("WARC-Record-ID", _urn(id_, digest)),
        F.lit(f"WARC-Date: {date}{CRLF}"),
        line("WARC-Target-URI", _clean(url)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Refers-To", F.when(is_revisit, _urn(original, digest)).otherwise(none)),
        line("WARC-Refers-To-Target-URI", F.when(is_revisit, _clean(original_url)).otherwise(none)),
        line("WARC-Profile", F.when(is_revisit, F.lit(REVISIT_PROFILE)).otherwise(none)),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = DATE, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a WARC record for every row, equal payloads once, under fresh headers.

    Headers (id, digest, length) are shuffled by payload digest to find the originals; revisits are then
    joined to them. The archives are written by Spark's own committer: gzip files of records that end as the
    format asks, each task's files appearing once however often the task ran.

    A null payload is empty; a null url leaves its header out; line ends in a url are escaped; a null id is never an
    original where another is there. Rows that repeat the original's id and payload are responses as it is.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": payload_digest(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})
    originals = materialize(resolve_revisits(rows.select("id", "url", "digest", "bytes"), min_bytes), "originals")
    joined = rows.join(originals, ["digest", "bytes"], "left")
    revisit = F.coalesce(F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original")), F.lit(False))
    record = record_text(F.col("id"), F.col("url"), F.col("payload"), F.col("digest"), F.col("bytes"), F.col("original"), F.col("original_url"), revisit, date)
    joined.select(record.alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class _Stream:
    """Bytes of a gzip archive (any number of members) or a plain one, unpacked as they are asked for."""

    def __init__(self, data: bytes, step: int = 1 << 20):
        self._data, self._at, self._step, self._buffer = memoryview(data), 0, step, bytearray()
        self._gzip = data[:2] == b"\x1f\x8b"
        self._unpack = zlib.decompressobj(31) if self._gzip else None

    def _more(self) -> bool:
        if self._at >= len(self._data):
            return False
        raw = self._data[self._at : self._at + self._step]
        self._at += len(raw)
        while self._gzip and len(raw):
            self._buffer += self._unpack.decompress(raw)
            raw = memoryview(self._unpack.unused_data)
            if self._unpack.eof:
                self._unpack = zlib.decompressobj(31)
        if not self._gzip:
            self._buffer += raw
        return True

    def until(self, mark: bytes) -> bytes | None:
        """All before the next ``mark``, which is skipped; None at the end."""
        seen = 0
        while (found := self._buffer.find(mark, seen)) < 0:
            seen = max(0, len(self._buffer) - len(mark))
            if not self._more():
                return None
        out = bytes(self._buffer[:found])
        del self._buffer[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self._buffer) < n and self._more():
            pass
        if len(self._buffer) < n:
            raise ValueError("an archive ends inside a record")
        out = bytes(self._buffer[:n])
        del self._buffer[:n]
        return out


def parse_records(data: bytes):
    """(headers with lower-case names, block) of every record of an archive."""
    stream = _Stream(data)
    while (head := stream.until(RECORD_END.encode())) is not None:
        lines = head.decode("utf-8").lstrip("\r\n").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield headers, stream.take(int(headers["content-length"]))
        if stream.take(4) != RECORD_END.encode():
            raise ValueError("a record doesn't end with two line ends")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean, url string, refers_to_url string"


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``.

    Length and digest of a response are reckoned from its payload and held against its headers
    (``digest_ok``); those of a revisit are what its own headers say of the payload left out. With
    ``with_payload`` a column ``payload`` follows, null for revisits. Archives are streamed out of
    their compressed bytes; a record is held whole, an archive never.
    """
    schema = READ + (", payload string" if with_payload else "")

    def page(urn: str | None) -> int | None:
        name = (urn or "").strip("<>").split(":")
        return int(name[2]) if len(name) > 3 and name[2] != "null" else None

    def rows(data: bytes):
        for headers, block in parse_records(data):
            head, _, payload = block.partition(RECORD_END.encode())
            told = headers.get("warc-payload-digest", "").removeprefix("sha1:")
            if headers["warc-type"] == "response":
                digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
            else:
                fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:])
                digest, size, payload = told, int(fields[b"content-length"]), None
            row = (page(headers["warc-record-id"]), size, digest, headers["warc-type"], page(headers.get("warc-refers-to")), digest == told, headers.get("warc-target-uri"), headers.get("warc-refers-to-target-uri"))
            yield row + ((None if payload is None else payload.decode("utf-8"),) if with_payload else ())

    def read(batches):
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string()] + [pa.string()] * with_payload
        names = [x.split(" ")[0] for x in schema.split(", ")]

        def batch(held):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

        for b in batches:
            for content in b.column(0):
                held, size = [], 0
                for row in rows(content.as_buffer().to_pybytes()):
                    held.append(row)
                    size += len(row[-1] or "") if with_payload else 0
                    if len(held) >= 5000 or size > 1 << 24:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(read, schema)
