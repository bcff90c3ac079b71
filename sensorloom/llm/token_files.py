"""Token ids in files: frequency-ranked, one to four bytes each, lengths in separate control bytes.

The commonest id gets rank 0, so most ids take one byte. A control byte holds the lengths of
four ids of one document (two bits each, the last byte of a document may hold fewer); all
control bytes of a chunk come before its data bytes, so numpy decodes a chunk by looking lengths
up in a table of 256 rows and gathering bytes, without a loop.

Chunk: magic ``FRVB``, then little-endian unsigned 64-bit numbers (documents, ids, data
bytes, crc32 of all that follows), the documents' ids (signed 64-bit) and a byte each that is 0
for a null id, their id counts (unsigned 64-bit), control bytes, data bytes. The file
``ranks.u32`` beside the folders lists the ids by rank.
"""

from __future__ import annotations

import os
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.llm.arrow_text import SPACE, flat_bytes, rolling_hash, slices, trimmed
from sensorloom.session import durable, scratch_path

END = 0
CHUNK_IDS = 1 << 20
FILE_BYTES = 16 << 20
MAGIC = b"FRVB"
HEAD = struct.Struct("<4s4Q")
SLOTS = 21
CACHED_IDS = 1 << 23
CACHED_BYTES = 1 << 25
PRINTABLE, LETTER, PUNCTUATION = (np.isin(np.arange(256), [*map(ord, x)]) for x in (string.printable[:94], string.ascii_letters, string.punctuation))
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.int64)


# Tokenizing


class Encoder:
    """A tokenizer with a cache of the ids of whole pieces of text.

    A byte-level BPE splits before white space that follows other characters and between a
    letter and punctuation, so a text may be cut there and each distinct piece encoded once. Cuts
    are made only where ASCII (before white space, also letters of two bytes) leaves no doubt, and none in a
    text that holds the text of an added token, which the tokenizer looks for across such places. The
    cache is a table of slots by hash, whose bytes are compared on every hit; a new piece takes the
    slot of an older one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content)
        self.keys = np.zeros(1 << SLOTS, np.uint64)
        self.text, self.read = np.zeros(CACHED_BYTES, np.uint8), 0
        self.text_at, self.text_size = np.zeros(1 << SLOTS, np.int32), np.full(1 << SLOTS, -1, np.int32)
        self.first, self.size = np.zeros(1 << SLOTS, np.int32), np.zeros(1 << SLOTS, np.int32)
        self.flat = np.zeros(CACHED_IDS, np.uint32)
        self.used = 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, and where each document's begin."""
        raw = data.tobytes()
        start = cuts(data, offsets, self._whole(raw, offsets))
        end = np.append(start[1:], len(data))
        rolling = rolling_hash(2)
        keys = rolling.between(rolling.prefixes(data), start, end) + (end - start).astype(np.uint64)
        slot = (keys >> np.uint64(64 - SLOTS)).astype(np.int64)
        first, size = self.first[slot].astype(np.int64), self.size[slot].astype(np.int64)
        hit = (self.keys[slot] == keys) & (self.text_size[slot] == end - start)
        rows = np.flatnonzero(hit)
        hit[rows] = same_bytes(data, start[rows], self.text, self.text_at[slot[rows]].astype(np.int64), (end - start)[rows])
        missing = np.flatnonzero(~hit)
        flat = self.flat
        if len(missing):
            _, at, inverse = np.unique(keys[missing], return_index=True, return_inverse=True)
            # Pieces of one hash but other bytes than the first of them stand alone.
            alike = missing[at][inverse]
            equal = (end - start)[missing] == (end - start)[alike]
            rows = np.flatnonzero(equal)
            equal[rows] = same_bytes(data, start[missing[rows]], data, start[alike[rows]], (end - start)[missing[rows]])
            cached = len(at)
            odd = np.flatnonzero(~equal)
            inverse[odd] = cached + np.arange(len(odd))
            new = np.concatenate([missing[at], missing[odd]])
            pieces = [raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist())]
            sizes, ids = [], []
            for i in range(0, len(pieces), 4096):
                coded = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[i : i + 4096], add_special_tokens=False)]
                sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)))
                ids.append(np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes[-1].sum())))
            sizes, ids = np.concatenate(sizes), np.concatenate(ids)
            begin = self.used + np.cumsum(sizes) - sizes
            lengths = (end - start)[new[:cached]]
            if self.used + len(ids) > len(self.flat) or self.read + lengths.sum() > len(self.text):
                flat = np.concatenate([self.flat[: self.used], ids])  # for this call only
                self.keys[:], self.text_size[:] = 0, -1
                self.used = self.read = 0
            else:
                self.flat[self.used : self.used + len(ids)] = ids
                self.used += len(ids)
                kept = slot[new[:cached]]
                self.keys[kept], self.first[kept], self.size[kept] = keys[new[:cached]], begin[:cached], sizes[:cached]
                self.text_at[kept], self.text_size[kept] = self.read + np.cumsum(lengths) - lengths, lengths
                spread = np.repeat(start[new[:cached]] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                self.text[self.read : self.read + len(spread)] = data[spread]
                self.read += len(spread)
            first[missing], size[missing] = begin[inverse], sizes[inverse]
        before = np.concatenate(([0], np.cumsum(size)))
        ids = flat[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
        return ids, before[np.searchsorted(start, offsets)]


    def _whole(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Documents with the text of an added token in them."""
        found = []
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                found.append(at)
                at = raw.find(token, at + 1)
        return np.unique(np.searchsorted(offsets, found, "right") - 1)


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``a[a_start : a_start + length]`` and ``b[b_start : b_start + length]`` agree; no length is 0."""
    out = np.zeros(len(length), bool)
    for i in range(0, len(length), 1 << 16):
        s = slice(i, i + (1 << 16))
        first = np.cumsum(length[s]) - length[s]
        step = np.arange(length[s].sum())
        equal = a[np.repeat(a_start[s] - first, length[s]) + step] == b[np.repeat(b_start[s] - first, length[s]) + step]
        out[s] = np.logical_and.reduceat(equal, first)
    return out


def cuts(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """Starts of the pieces: each document's first byte, white space after a sure non-space, punctuation after a letter.

    Documents of ``whole`` are not cut.
    """
    mark = np.zeros(len(data), bool)
    if len(data) > 1:
        two = np.zeros(len(data), bool)
        two[1:] = (data[:-1] >= 0xC3) & (data[:-1] < 0xE0) & (data[1:] >= 0x80)  # two-byte characters from U+00C0 on hold no white space
        mark[1:] = (SPACE[data[1:]] & (PRINTABLE[data] | two)[:-1]) | (PUNCTUATION[data[1:]] & LETTER[data[:-1]])
    for doc in [] if whole is None else whole:
        mark[offsets[doc] : offsets[doc + 1]] = False
    mark[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(mark)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n, ids`` of every row: ids of the whole text and the end id, as unsigned 32-bit bytes (16-bit where all fit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        kind = np.uint16 if coder.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, bounds = coder.encode(*flat_bytes(part.column(1)))
                n = np.diff(bounds)
                closed = np.insert(ids, bounds[1:], END).astype(kind)
                ends = (np.cumsum(n + 1) * closed.itemsize).astype(np.int64)
                blobs = _blobs(closed.view(np.uint8), np.concatenate(([0], ends)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n + 1, pa.int64()), blobs], ["doc_id", "n", "ids"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(trimmed(run), "doc_id long, n long, ids binary")


def _blobs(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The bytes between offsets as a binary column."""
    buffers = [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def _ids(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint16 if len(blob) == 2 * n else np.uint32)


def ranked(tokens: DataFrame) -> np.ndarray:
    """All ids that occur, the commonest first (ties: the smaller id). One row per id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.bincount(_ids(blob.as_buffer(), n))
                if len(found) > len(total):
                    found[: len(total)] += total
                    total = found
                else:
                    total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    counts = tokens.select("n", "ids").mapInArrow(trimmed(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))], np.uint32)


# The coding


def _places(counts: np.ndarray) -> np.ndarray:
    """Index of every id among the two-bit codes, where each document fills whole control bytes."""
    quads = -(-counts // 4) * 4
    shift = np.cumsum(quads) - quads - (np.cumsum(counts) - counts)
    return np.arange(counts.sum()) + np.repeat(shift, counts)


def encode_ranks(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and where each document's begin, data bytes and where each document's begin."""
    size = 1 + (ranks >= 1 << 8).astype(np.int64) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    control_at = np.concatenate(([0], np.cumsum(-(-counts // 4))))
    codes = np.zeros(int(control_at[-1]) * 4, np.uint8)
    codes[_places(counts)] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    at = np.concatenate(([0], np.cumsum(size)))
    data = np.zeros(int(at[-1]), np.uint8)
    data[at[:-1]] = ranks & np.uint32(0xFF)
    for byte in range(1, 4):
        here = np.flatnonzero(size > byte)
        if not len(here):
            break
        data[at[here] + byte] = ranks[here] >> np.uint32(8 * byte) & np.uint32(0xFF)
    return control, control_at, data, at[np.concatenate(([0], np.cumsum(counts)))]


def decode_ranks(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    size = LENGTHS[control].ravel()[_places(counts)]
    at = np.cumsum(size) - size
    out = data[at].astype(np.uint32)
    for byte in range(1, 4):
        here = np.flatnonzero(size > byte)
        if not len(here):
            break
        out[here] |= data[at[here] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def pack_chunk(doc_ids: list, counts: list, control: bytes, data: bytes) -> bytes:
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.array(counts, "<u8").tobytes(), control, data]
    body = b"".join(parts)
    return HEAD.pack(MAGIC, len(doc_ids), sum(counts), len(data), zlib.crc32(body)) + body


def unpack_chunks(blob: bytes) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """``(doc_ids, counts, ranks)`` of each chunk; ValueError where a chunk is damaged."""
    at = 0
    view = memoryview(blob)
    while at < len(view):
        if len(view) - at < HEAD.size:
            raise ValueError(f"file ends early at byte {at}")
        magic, docs, n, size, crc = HEAD.unpack_from(view, at)
        at += HEAD.size
        table = view[at : at + 17 * docs]
        if magic != MAGIC or len(table) < 17 * docs:
            raise ValueError(f"damaged chunk before byte {at}")
        counts = np.frombuffer(table[9 * docs :], "<u8").astype(np.int64)
        quads = int((-(-counts // 4)).sum())
        body = view[at : at + 17 * docs + quads + size]
        if counts.sum() != n or len(body) != 17 * docs + quads + size or zlib.crc32(body) != crc:
            raise ValueError(f"damaged chunk before byte {at}")
        at += len(body)
        ids, known = np.frombuffer(table[: 8 * docs], "<i8").tolist(), bytes(table[8 * docs : 9 * docs])
        control, data = np.frombuffer(body, np.uint8, quads, 17 * docs), np.frombuffer(body, np.uint8, size, 17 * docs + quads)
        yield [d if k else None for d, k in zip(ids, known)], counts, decode_ranks(control, data, counts)


# Files


def write_token_files(tokens: DataFrame, uri: str, order: np.ndarray) -> DataFrame:
    """Write documents in ascending doc_id order (null first); ``file, n`` per file, files in order by name.

    Like the archives: hidden folder first, moved to ``part-<partition>`` when whole. Partitions
    are ranges of doc_id and sorted, so every attempt writes the same files.
    """
    fs, folder = pafs.FileSystem.from_uri(uri)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/ranks.u32", compression=None) as sink:
        sink.write(order.astype("<u4").tobytes())
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids", 2 << 20):
                counts = part.column(1).to_numpy()
                flat, _ = flat_bytes(part.column(2))
                ids = _ids(flat.tobytes(), int(counts.sum()))
                control, control_at, data, data_at = encode_ranks(rank[ids], counts)
                columns = [part.column(0), part.column(1), _blobs(control, control_at), _blobs(data, data_at)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "control", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(uri)
        part = TaskContext.get().partitionId()
        temp, final = f"{folder}/_{uuid.uuid4().hex}", f"{folder}/part-{part:06d}"
        held: list[tuple] = []
        size = pending = 0
        sink, done = None, []

        def flush() -> None:
            nonlocal sink, held, pending, size
            if not held:
                return
            if sink is None:
                if not done:
                    fs.create_dir(temp, recursive=True)
                sink, size = fs.open_output_stream(f"{temp}/{len(done):05d}.ids", compression=None), 0
                done.append(0)
            ids, counts, controls, datas = zip(*held)
            chunk = pack_chunk(list(ids), list(counts), b"".join(controls), b"".join(datas))
            sink.write(chunk)
            size += len(chunk)
            done[-1] += pending
            held, pending = [], 0
            if size >= FILE_BYTES:
                sink.close()
                sink = None

        for batch in batches:
            for i in range(batch.num_rows):
                held.append(tuple(batch.column(j)[i].as_py() for j in range(4)))
                pending += held[-1][1]
                if pending >= CHUNK_IDS:
                    flush()
        flush()
        if sink is not None:
            sink.close()
        if done:
            try:
                fs.move(temp, final)
            except OSError:
                if fs.get_file_info(final).type != pafs.FileType.Directory:
                    raise
            names = [f"part-{part:06d}/{i:05d}.ids" for i in range(len(done))]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(done, pa.int64())], ["file", "n"])

    spark = tokens.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = tokens.mapInArrow(trimmed(code), "doc_id long, n long, control binary, data binary")
    sorted_ = coded.repartitionByRange(width, "doc_id").sortWithinPartitions("doc_id", "n", "data")
    return durable(sorted_.mapInArrow(trimmed(run), "file string, n long"))


def _decoded(batches: Iterator[pa.RecordBatch], order: np.ndarray) -> Iterator[tuple[str, int, list, np.ndarray, np.ndarray]]:
    """``file, place, doc_ids, counts, ids`` of each chunk; place counts the file's documents before it."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            place = 0
            for names, counts, ranks in unpack_chunks(content.as_buffer()):
                yield "/".join(path.split("/")[-2:]), place, names, counts, order[ranks]
                place += len(names)


def _files(spark: SparkSession, uri: str) -> tuple[DataFrame, np.ndarray]:
    fs, folder = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(f"{folder}/ranks.u32") as source:
        order = np.frombuffer(source.read(), "<u4")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").option("recursiveFileLookup", "true")
    return reader.load(uri).select("path", "content"), order


def read_token_files(spark: SparkSession, uri: str) -> DataFrame:
    """``file, place, doc_id, n, ids`` of every document; ids are unsigned 32-bit little-endian bytes, place orders a file's documents."""
    files, order = _files(spark, uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, place, names, counts, ids in _decoded(batches, order):
            blobs = _blobs(ids.view(np.uint8), np.concatenate(([0], np.cumsum(counts) * 4)))
            columns = [pa.array([file] * len(names)), pa.array(range(place, place + len(names)), pa.int64()), pa.array(names, pa.int64()), pa.array(counts), blobs]
            yield pa.RecordBatch.from_arrays(columns, ["file", "place", "doc_id", "n", "ids"])

    return files.mapInArrow(trimmed(run), "file string, place long, doc_id long, n long, ids binary")


def read_digests(spark: SparkSession, uri: str) -> DataFrame:
    """``file, doc_id, inside, n_tokens, ids_crc32`` of every document, without handing its ids on."""
    files, order = _files(spark, uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, base = None, 0
        for file, _, names, counts, ids in _decoded(batches, order):
            base = base if file == current else 0
            current = file
            ends = np.cumsum(counts)
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
            columns = [pa.array([file] * len(names)), pa.array(names, pa.int64()), pa.array(base + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "inside", "n_tokens", "ids_crc32"])
            base += int(ends[-1])

    return files.mapInArrow(trimmed(run), "file string, doc_id long, inside long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, name: str = "tokens") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, from files that were written and read back.

    Null text is empty and holds the end id only. Repeated rows are written each; rows with a
    null doc_id come first. Without rows nothing is written.
    """
    spark = docs.sparkSession
    table = scratch_path(spark, name)
    tokenize(docs, path).write.option("compression", "zstd").parquet(table)
    tokens = spark.read.parquet(table)
    uri = scratch_path(spark, f"{name}-files")
    uri = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
    files = write_token_files(tokens, uri, ranked(tokens))
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per file of 16 MB
    bases = files.select("file", (F.sum("n").over(order) - F.col("n")).alias("base"))
    return read_digests(spark, uri).join(bases, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
