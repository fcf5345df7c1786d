"""WARC archives: writing page records, and reading them one gzip member at a time."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trekframe.llm.words import small_batches
from trekframe.storage import materialize, scratch_path

READ_BYTES = 1 << 16
RECORDS = (
    "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "digest_ok boolean, payload binary"
)
_EPOCH = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return _base32(hashlib.sha1(payload))


def _base32(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record_bytes(page_id, url: str | None, payload: bytes, payload_digest: str, refers_to, level: int = 6) -> bytes:
    """One WARC record as a gzip member of its own. A revisit holds the HTTP header only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    kind = "revisit" if revisit else "response"
    uri = "".join(c for c in (url or "") if c not in "\r\n")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_EPOCH}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    lines += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}",
        ]
    raw = ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8") + block + b"\r\n\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


class RecordReader:
    """Reads the records of one archive in order.

    The stream is taken in small blocks; each gzip member is one record, decompressed by ``block`` bytes at a time. The
    header ends at the first empty line, and ``Content-Length`` says how long the block is; it comes in chunks as it is
    inflated, and the member has to end two line ends later. Zero bytes between members are padding.
    """

    def __init__(self, stream, block: int = READ_BYTES):
        self.stream, self.block, self.rest = stream, block, b""

    def _begins(self) -> bool:
        while not (rest := self.rest.lstrip(b"\0")):
            self.rest = self.stream.read(self.block)
            if not self.rest:
                return False
        self.rest = rest
        return True

    def _member(self):
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if not self.rest and not (rest := self.stream.read(self.block)):
                raise EOFError("the archive ends within a record")
            out = unpack.decompress(self.rest or rest, self.block)
            self.rest = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            yield out

    def __iter__(self):
        """``(fields, chunks)`` of each record; what is left of the chunks is read before the next one."""
        while self._begins():
            parts = self._member()
            head = b""
            while (end := head.find(b"\r\n\r\n")) < 0:
                if not (more := next(parts, None)) and more is None:
                    raise ValueError("a record without an end of its header")
                head += more
            version, *lines = head[:end].decode("utf-8").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"not a WARC record: {version[:20]!r}")
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
            chunks = self._framed(head[end + 4 :], parts, int(fields["Content-Length"]))
            yield fields, chunks
            for _ in chunks:
                pass

    @staticmethod
    def _framed(first: bytes, parts, left: int):
        tail = b""
        for part in chain((first,), parts):
            if own := part[:left]:
                left -= len(own)
                yield own
            tail += part[len(own) :]
        if left or tail != b"\r\n\r\n":
            raise ValueError("a record's length differs from its Content-Length")


def parse_record(fields: dict, chunks, keep_payload: bool = True) -> tuple:
    """A row of ``RECORDS``. Bytes and digest of a response are those of the payload read, a revisit's are its header's;
    ``digest_ok`` tells whether block and payload have the digests and length that the headers say."""
    whole, inner, head, size, kept = hashlib.sha1(), hashlib.sha1(), b"", 0, []
    inside = False
    for chunk in chunks:
        whole.update(chunk)
        if not inside:
            head += chunk
            end = head.find(b"\r\n\r\n")
            if end < 0:
                continue
            inside, chunk, head = True, head[end + 4 :], head[:end]
        inner.update(chunk)
        size += len(chunk)
        if keep_payload:
            kept.append(chunk)
    http = dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
    stated, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
    revisit = fields["WARC-Type"] == "revisit"
    found = _base32(inner)
    ok = _base32(whole) == fields["WARC-Block-Digest"].removeprefix("sha1:") and (size == 0 if revisit else (found, size) == (stated, length))
    page, to = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
    return (
        None if page is None else int(page), fields["WARC-Target-URI"] or None, fields["WARC-Type"], None if to is None else int(to),
        length if revisit else size, stated if revisit else found, ok, b"".join(kept) if keep_payload and not revisit else None,
    )


def assign_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, html, digest, refers_to)``: of equal payloads, the largest page_id stands for the others.

    Only ids and digests are grouped and joined; the payloads themselves are dealt by page, so many copies of one
    payload are not one task's work. Payloads under ``min_bytes`` stand for themselves. Rows with the largest id of
    their payload are all responses; rows without an id stand for themselves.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    ids = rows.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= min_bytes)).select("page_id", "digest")
    last = ids.groupBy("digest").agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = ids.join(last, "digest").where("page_id < last_id").distinct()
    return rows.join(revisits.hint("merge"), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", F.col("last_id").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 2000, level: int = 6) -> None:
    """Writes each page as a record into gzip archives under ``path``, through Spark's own committed file writer.

    Every output row is one gzip member and the row separator is a zero byte, which gzip readers take for padding.
    """

    def build(batches):
        for batch in batches:
            ids, urls, htmls, digests, to = (c.to_pylist() for c in batch.columns)
            out = []
            for page_id, url, html, sha, ref in zip(ids, urls, htmls, digests, to):
                payload = html.encode("utf-8")
                out.append(record_bytes(page_id, url, payload, base64.b32encode(bytes.fromhex(sha)).decode(), ref, level))
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["value"])

    members = assign_revisits(pages, min_bytes).mapInArrow(build, "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``, checked against their digests (``digest_ok``). An archive is one cell
    on its way to the reader, so Spark raises an error for one of more than 2 GB."""

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, chunks in RecordReader(io.BytesIO(content.as_py())):
                    rows.append(parse_record(fields, chunks, keep_payload))
                    held += len(rows[-1][-1] or b"")
                    if len(rows) == 500 or held > _HELD:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(read, RECORDS)


_HELD = 4 << 20


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=names)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes all pages to archives and reads them back: a row per page with what its record holds.

    Bytes and digest of a response are those of the payload read back; a revisit gets those of the response that it
    refers to. Any record whose digests or lengths do not hold, and a revisit that does not agree with its response,
    raises an error. Null html is an empty payload, a null url an empty target; pages of any length are whole records.
    Repeated rows are records of their own, other columns are ignored, and an empty table gives an empty result.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return verified(pages.sparkSession, path)


def verified(spark: SparkSession, path: str) -> DataFrame:
    """The records under ``path`` without their payloads; an error for one that does not hold what it says, as above."""
    back = materialize(read_archives(spark, path, keep_payload=False).drop("payload"), "records")
    shown = back.where("record_type = 'response' and digest_ok").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes")).distinct()
    revisits = back.where("record_type = 'revisit'").join(shown, ["refers_to"], "left")
    agrees = F.col("digest_ok") & (F.col("digest") == F.col("payload_digest")) & (F.col("bytes") == F.col("payload_bytes"))
    revisits = revisits.withColumn("digest_ok", F.coalesce(agrees, F.lit(False))).withColumns({"payload_digest": F.col("digest"), "payload_bytes": F.col("bytes")})
    both = back.where("record_type = 'response'").unionByName(revisits.select(*back.columns))
    wrong = F.raise_error(F.concat(F.lit("a record differs from its digests: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    return both.withColumn("record_type", F.when(F.col("digest_ok"), F.col("record_type")).otherwise(wrong.cast("string")))
