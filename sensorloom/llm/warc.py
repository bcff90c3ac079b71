"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The writer puts each page into one record, each record into its own gzip member. The reader
checks member, header, lengths and payload digest. Where a check fails it searches for the
next gzip member or ``WARC/1.`` version line, goes on there and reports the bytes in between as
a quarantined gap, so damage costs only the records it touches.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.arrow_text import trimmed
from sensorloom.session import durable, scratch_path

MIN_REVISIT_BYTES = 100
FILE_BYTES = 16 << 20
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
RECORD_SCHEMA = (
    "file string, offset long, page_id long, url string, record_type string, refers_to long, "
    "payload binary, payload_bytes long, payload_digest string, gap_start long, gap_end long, reason string"
)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, payload_digest, refers_to`` (null for a response).

    Null html is an empty payload. Of equal payloads of at least ``min_bytes`` the smallest
    page_id is the response. Rows that repeat that page_id are responses too; a group with null
    page_ids only has no revisits. The join carries only digests of groups with several rows,
    from a checkpointed table, so that adaptive execution can split a hot payload.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    digest = F.when(F.octet_length("payload") >= min_bytes, F.sha2("payload", 256))
    keyed = rows.select("*", digest.alias("key"))
    firsts = durable(
        keyed.where("key is not null").groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    )
    joined = keyed.join(firsts, "key", "left")
    refers = F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first"))
    return joined.select("page_id", "url", "payload", F.coalesce("key", F.sha2("payload", 256)).alias("payload_digest"), refers.alias("refers_to"))


def write_warc(records: DataFrame, uri: str, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Write records under ``uri`` (a folder of a shared store); one manifest row per file.

    A task writes into a hidden folder of its own and moves that to ``part-<partition>`` when
    all its files are whole. Where an earlier attempt has done so, the later one's files stay
    hidden; so each partition is read once, whatever was retried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(uri)
        part = TaskContext.get().partitionId()
        temp, final = f"{folder}/_{uuid.uuid4().hex}", f"{folder}/part-{part:06d}"
        sink = None
        size = 0
        done: list[int] = []
        for batch in batches:
            for row in _rows(batch):
                if sink is None:
                    if not done:
                        fs.create_dir(temp, recursive=True)
                    sink = fs.open_output_stream(f"{temp}/{len(done):05d}.warc.gz", compression=None)
                    done.append(0)
                member = gzip_member(record_bytes(*row, date), level)
                sink.write(member)
                size += len(member)
                done[-1] += 1
                if size >= FILE_BYTES:
                    sink.close()
                    sink, size = None, 0
        if sink is not None:
            sink.close()
        if done:
            try:
                fs.move(temp, final)
            except OSError:
                if fs.get_file_info(final).type != pafs.FileType.Directory:
                    raise
            names = [f"part-{part:06d}/{i:05d}.warc.gz" for i in range(len(done))]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(done, pa.int64())], ["file", "records"])

    return records.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(trimmed(run), "file string, records long")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        yield tuple(batch.column(j)[i].as_py() for j in range(5))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One uncompressed record. A null page_id or url leaves its header out."""
    kind = "response" if refers_to is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    headers = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        headers.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if refers_to is not None:
        headers.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        headers.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of one archive, gzipped per record, plain, or both mixed.

    Yields ``{offset, page_id, ..., payload}`` for records and ``{gap_start, gap_end, reason}``
    for byte ranges that hold none; together they cover the whole file.
    """
    at, end, gap, why = 0, len(data), None, ""
    while at < end:
        found = problem = None
        try:
            found, after = _member(data, at)
        except (ValueError, zlib.error) as error:
            problem = str(error)
        if found is None:
            if gap is None:
                gap, why = at, problem
            at = _next_start(data, at + 1)
            continue
        if gap is not None:
            yield {"gap_start": gap, "gap_end": at, "reason": why}
            gap = None
        yield found | {"offset": at}
        at = after
    if gap is not None:
        yield {"gap_start": gap, "gap_end": end, "reason": why}


PIECE = 1 << 14


def _next_start(data: bytes, at: int) -> int:
    member = data.find(GZIP_MAGIC, at)
    line = VERSION.search(data, at, member if member >= 0 else len(data))
    return line.start() if line else member if member >= 0 else len(data)


def _member(data: bytes, at: int) -> tuple[dict, int]:
    if data.startswith(GZIP_MAGIC, at):
        unpack, view, parts, end = zlib.decompressobj(31), memoryview(data), [], at
        # In pieces: what is left of the input is handed back as a copy, which must not be the rest of the file.
        while not unpack.eof and end < len(data):
            parts.append(unpack.decompress(view[end : end + PIECE]))
            end = min(end + PIECE, len(data))
        if not unpack.eof:
            raise ValueError("member ends early")
        raw = b"".join(parts)
        record, used = parse_record(raw, 0)
        if used != len(raw):
            raise ValueError("bytes after the record in its member")
        return record, end - len(unpack.unused_data)
    if VERSION.match(data, at):
        return parse_record(data, at)
    raise ValueError("neither a member nor a version line")


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at ``at`` and where the next one would begin; ValueError if a check fails."""
    if not VERSION.match(data, at):
        raise ValueError("no version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise ValueError("header without end")
    fields: dict[str, str] = {}
    for line in data[at:head].decode("utf-8", "strict").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header line without colon")
        fields[name.strip().lower()] = value.strip()
    length = int(fields.get("content-length", "missing"))
    start, stop = head + 4, head + 4 + length
    if length < 0 or data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("block length is wrong")
    http = data.find(b"\r\n\r\n", start, stop)
    payload = data[http + 4 : stop] if http >= 0 else data[start:stop]
    kind = fields.get("warc-type")
    digest = fields.get("warc-payload-digest", "").partition(":")[2]
    if kind == "response" and digest and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload digest is wrong")
    record = {
        "page_id": _page(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload": payload if kind == "response" else None,
        "payload_bytes": len(payload) if kind == "response" else int(fields.get("x-payload-length", "-1")),
        "payload_digest": digest,
    }
    return record, stop + 4


def _page(value: str | None) -> int | None:
    match = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(match[1]) if match else None


def read_warc(spark: SparkSession, uri: str) -> DataFrame:
    """Records and gaps (``gap_start`` is not null) of all archives under ``uri`` and its folders.

    One archive is one task's row, so archives should stay well under 2 GB; the writer rolls
    them at 16 MB. Hidden folders (of writers that did not finish) are passed over.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true")
    files = reader.load(uri).select(F.col("path").alias("file"), "content")

    names = [part.split(" ")[0] for part in RECORD_SCHEMA.split(", ")]
    schema = pa.schema(
        [(n, pa.binary() if n == "payload" else pa.string() if n in ("file", "url", "record_type", "payload_digest", "reason") else pa.int64()) for n in names]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer()
                rows, size = [], 0
                for found in salvage(content.to_pybytes()):
                    rows.append(found | {"file": file})
                    size += len(found.get("payload") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(trimmed(run), RECORD_SCHEMA)


def archive_round_trip(pages: DataFrame, name: str = "warc") -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    uri = scratch_path(spark, name)
    manifest = durable(write_warc(with_revisits(pages), _with_scheme(uri)))
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD_SCHEMA)
    return read_warc(spark, uri)


def _with_scheme(uri: str) -> str:
    return uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
