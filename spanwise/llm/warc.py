"""WARC archives: a writer with revisit records, and a splittable reader of gzip members.

Every record is a gzip member of its own. The reader's tasks each scan one byte
range of an archive for the gzip magic. A candidate counts as a member if what it
inflates to starts with a WARC version line and a readable header block, however
long. A task
owns the records whose member starts inside its range and reads the last of them
past the range's end. Each record is thus read once however the ranges lie.

Defined cases: null or empty HTML is an empty payload; rows that repeat a
``page_id`` give a record each; a null ``page_id`` is kept as null and is smaller than
any other, so that such a page is a revisit where a page with an id has its payload,
and a response where none has; an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, shared_dir

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
#: Bytes inflated at once while a header block's end is sought.
HEADER_BYTES = 1 << 16
ROWS_PER_FILE = 20_000
#: Parts that rows without ``page_id`` and of one payload are dealt into.
SPREAD = 32
#: The identifier of a page without ``page_id``.
NO_ID = "urn:uuid:ffffffff-ffff-ffff-ffff-ffffffffffff"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record_id(page_id: int | None) -> str:
    """A URN that holds the page's number, so that a reference leads back to it."""
    return NO_ID if page_id is None else f"urn:uuid:{uuid.UUID(int=page_id % (1 << 64))}"


def page_of(record: str | None) -> int | None:
    text = (record or "").strip("<> ")
    if not text.startswith("urn:uuid:") or text == NO_ID:
        return None
    n = uuid.UUID(text[9:]).int
    return n - (1 << 64) if n >= 1 << 63 else n


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, which states the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c for c in url or "" if c > " ") or "about:blank"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, digest, refers_to`` (hex SHA-1 of the payload) of each page whose payload a page with a larger ``page_id`` has too; null is the smallest."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    seen = cut(pages.select("page_id", F.sha1(payload).alias("digest"), F.length(payload).alias("n")).where(F.col("n") >= least_bytes), "warc-digests")
    shared = seen.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    return seen.join(shared, "digest").where("page_id < refers_to OR page_id IS NULL AND refers_to IS NOT NULL").select("page_id", "digest", "refers_to").distinct()


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = _open(folder)
        # a second attempt of this task writes another file; only files in the manifest are read
        path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        n, out, at_page, page, known = 0, None, None, None, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for x in batch.slice(at, 256).to_pylist():
                    if (x["page_id"], x["spread"]) != at_page:
                        at_page, page, known = (x["page_id"], x["spread"]), x["page_id"], {}
                    if x["digest"] is not None:  # what a page refers to stands before the page
                        known[x["digest"]] = x["refers_to"]
                        continue
                    if out is None:
                        system.create_dir(base, recursive=True)
                        out = system.open_output_stream(path, compression=None)
                    payload = x["payload"] or b""
                    first = known.get(hashlib.sha1(payload).hexdigest()) if known else None
                    out.write(warc_record(page, x["url"], payload, first, first is not None, date))
                    n += 1
        if out is not None:
            out.close()
            size = system.get_file_info(path).size
            yield pa.RecordBatch.from_pydict({"file": [path], "bytes": [size], "records": [n]}, pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return run


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives under ``folder``; returns their manifest ``file, bytes, records``.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the
    largest ``page_id`` is written as response, the others as revisits of it. Of
    rows that repeat a response's ``page_id`` each is a response. Payloads are
    shuffled once, by ranges of ``page_id``, together with what they refer to.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    # rows without a page_id are spread by their payload, and what they refer to is sent to each part
    none = F.col("page_id").isNull()
    spread = F.when(none, F.xxhash64(F.sha1("payload"), F.pmod(F.xxhash64("url"), F.lit(SPREAD)))).otherwise(0)
    parts = F.when(none, F.transform(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda k: F.xxhash64("digest", k.cast("long")))).otherwise(F.array(F.lit(0).cast("long")))
    both = rows.withColumn("spread", spread).unionByName(revisits(pages, least_bytes).withColumn("spread", F.explode(parts)), allowMissingColumns=True)
    files = max(-(-pages.count() // ROWS_PER_FILE), int(spark.conf.get("spark.sql.shuffle.partitions")))
    written = both.repartitionByRange(files, "page_id", "spread").sortWithinPartitions("page_id", "spread", F.col("digest").isNull()).mapInArrow(_writer(f"{folder}/archives", date), "file string, bytes long, records long")
    written.write.parquet(f"{folder}/manifest")
    return spark.read.schema("file string, bytes long, records long").parquet(f"{folder}/manifest")


def header_block(raw: bytes) -> tuple[dict[str, str], int] | None:
    """The fields of a WARC header block and its length, or None if ``raw`` does not start with one."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/") or end < 0:
        return None
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            fields[last] = value.strip()
        else:
            return None
    return (fields, end + 4) if "warc-type" in fields else None


class Range:
    """A file's bytes in a window that moves on."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if at < self.at or at + n > self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, min(READ_BYTES, self.size - at)))
        return self.held[at - self.at : at - self.at + n]


def starts_record(source: Range, at: int) -> bool:
    """Whether a gzip member with a WARC header block starts here."""
    inflate = zlib.decompressobj(31)
    got, step = bytearray(), 4096
    try:
        while not inflate.eof:
            raw = inflate.unconsumed_tail
            if not raw:
                raw = source.bytes(at, step)
                at += len(raw)
            more = inflate.decompress(raw, HEADER_BYTES)
            if not raw and not more:
                return False
            seen = max(0, len(got) - 3)
            got += more
            if len(got) >= 5 and not got.startswith(b"WARC/"):
                return False
            if got.find(b"\r\n\r\n", seen) >= 0:
                return header_block(bytes(got)) is not None
    except zlib.error:
        return False
    return False


def inflate_member(source: Range, at: int) -> tuple[bytes, int]:
    """A whole member and where the next one starts."""
    inflate, parts = zlib.decompressobj(31), []
    while not inflate.eof and at < source.size:
        raw = source.bytes(at, 1 << 16)
        parts.append(inflate.decompress(raw))
        at += len(raw)
    return b"".join(parts), at - len(inflate.unused_data)


def members(source: Range, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of each record whose member starts in ``[start, end)``."""
    at = start
    while at < end:
        window = source.bytes(at, min(READ_BYTES, end + len(MAGIC) - 1 - at))
        k = window.find(MAGIC)
        if k < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += k
        if at >= end:
            return
        if not starts_record(source, at):
            at += 1
            continue
        begin = at
        raw, at = inflate_member(source, begin)
        fields, n = header_block(raw)
        yield begin, fields, raw[n : n + int(fields.get("content-length", "0") or 0)]


RECORDS = "file string, offset long, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, http_length long, payload binary"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in RECORDS.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for x in batch.to_pylist():
            system, path = _open(x["file"])
            rows, held = [], 0
            with system.open_input_file(path) as file:
                for offset, fields, block in members(Range(file, x["bytes"]), x["start"], x["end"]):
                    length, payload = None, block
                    if fields.get("content-type", "").startswith("application/http"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        for line in head.split(b"\r\n")[1:]:
                            if line.lower().startswith(b"content-length:"):
                                length = int(line.split(b":", 1)[1])
                    rows.append((x["file"], offset, fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest"), length, payload))
                    held += len(payload)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every record of ``archives`` (file, bytes), read by byte ranges of ``split_bytes``."""
    spark = archives.sparkSession
    ranges = archives.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")).withColumn("end", F.least(F.col("start") + split_bytes, "bytes"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(max(n, 1), "file", "start").mapInArrow(_scan, RECORDS)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per record the page it holds; a response's digest and length are computed from its payload."""
    for batch in batches:
        rows = []
        for x in batch.select(["warc_type", "record_id", "refers_to", "payload_digest", "http_length", "payload"]).to_pylist():
            revisit = x["warc_type"] == "revisit"
            said = (x["payload_digest"] or "").removeprefix("sha1:")
            digest = said if revisit else sha1_base32(x["payload"])
            rows.append((page_of(x["record_id"]), x["http_length"] if revisit else len(x["payload"]), digest, x["warc_type"], page_of(x["refers_to"]) if revisit else None, digest == said))
        cols = list(zip(*rows)) or [()] * 6
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok"])


def round_trip(pages: DataFrame, least_bytes: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, one row a record.

    Fails if the reader does not find as many records as the manifest counts. The
    archives stay in the shared folder.
    """
    folder = shared_dir(pages.sparkSession, "warc")
    manifest = write_warc(pages, folder, least_bytes)
    rows = cut(read_warc(manifest, split_bytes).mapInArrow(_digested, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"), "warc-rows")
    written, read = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], rows.count()
    if read != written:
        raise RuntimeError(f"{written} records were written and {read} read")
    return rows
