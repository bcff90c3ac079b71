"""Exact removal of repeated byte strings by prefix-free parsing.

Parsing: a trigger is the ``WIDTH``-byte string with the smallest rolling hash inside a string of
``LENGTH`` bytes. All strings of ``LENGTH`` bytes with the same trigger position make one phrase;
consecutive phrases overlap by ``LENGTH - 1`` bytes, so each such string lies in exactly one
phrase, and equal strings lie at the same offset in phrases with equal triggers.

The dictionary holds each distinct phrase once, at its first place; phrases of the parse that
occurred before are repeats as a whole and never looked at again. Only dictionary phrases that
share their trigger with another one are sorted: the suffixes of a group of phrases get ranks by
prefix doubling up to ``LENGTH`` bytes, and ranks combined with the phrases' places give the corpus
order, in which every string but the first of its class is a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.arrow_text import flat_bytes, prime_hash, rolling_hash, slices, trimmed
from sensorloom.session import durable, scratch_path

LENGTH = 100
WIDTH = 28
GROUP_PHRASES = 8_000
CHUNK_BYTES = 1 << 18
#: Rows that a task gathers before it sorts out repeats on its own.
GATHERED = 1 << 19
PIECE = 1 << 20
#: place: start of the first string << 16 | (strings - 1) << 8 | trigger - start
PHRASES = "trigger long, phrase long, doc_id long, text_id long, place long"
MARKS = "trigger long, doc_id long, text_id long, place long"
SUFFIXES = "key long, tie long, doc_id long, text_id long, place long, bytes binary"
SPANS = "doc_id long, text_id long, start long, strings long"
TEXT = ["doc_id", "text_id"]
NAMES = [x.split(" ")[0] for x in MARKS.split(", ")]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by running minima within blocks of ``width``."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def parse(data: np.ndarray, offsets: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """``first, last, at, trigger, phrase``: the phrases' first and last string, trigger position and hashes."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty
    rolling = rolling_hash(3)
    prefixes = rolling.prefixes(data)
    grams = np.arange(len(data) - width + 1)
    hashes = rolling.between(prefixes, grams, grams + width)
    bits = np.uint64(max(24, len(data).bit_length()))
    packed = (hashes >> bits << bits) | grams.astype(np.uint64)  # leftmost of equal hashes
    at = (sliding_minimum(packed, length - width + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.arange(len(data) - length + 1)
    inside = start + length <= np.repeat(offsets[1:], np.diff(offsets))[: len(start)]
    start, at = start[inside], at[inside]
    if not len(start):
        return empty, empty, empty, empty, empty
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))))
    first, last, at = start[cut], start[np.append(cut[1:], len(start)) - 1], at[cut]
    hashing = prime_hash(3)  # equal phrases are not compared again
    return first, last, at, hashes[at].view(np.int64), hashing.between(hashing.prefixes(data), first, last + length).view(np.int64)


def first_places(parsed: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``PHRASES`` rows of a task, the trigger null where it met the phrase at an earlier place.

    Rows are gathered and sorted, repeats leave, and the first places of phrases that were met more than once
    stay to meet the next rows. So a phrase of any frequency leaves a task with few first places, and
    what is dealt by trigger afterwards does not grow with its copies.
    """
    names = [x.split(" ")[0] for x in PHRASES.split(", ")]

    def rows_of(columns: list[np.ndarray], repeat: bool) -> pa.RecordBatch:
        null = np.full(len(columns[0]), repeat)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64(), mask=null if i == 0 else None) for i, c in enumerate(columns)], names)

    gathered: list[list[np.ndarray]] = []
    n = 0
    for batch in parsed:
        gathered.append([c.to_numpy() for c in batch.columns])
        n += batch.num_rows
        if n < GATHERED:
            continue
        first, many, repeats = _sorted_out(gathered)
        yield rows_of(repeats, True)
        stay = many & (many.sum() <= GATHERED // 2)
        yield rows_of([c[~stay] for c in first], False)
        gathered = [[c[stay] for c in first]]
        n = int(stay.sum())
    if n:
        first, _, repeats = _sorted_out(gathered)
        yield rows_of(repeats, True)
        yield rows_of(first, False)


def _sorted_out(gathered: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """First places of the phrases, whether each came more than once, and all other places (without a first place again)."""
    columns = [np.concatenate(c) for c in zip(*gathered)]
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
    at = np.flatnonzero(new)
    origin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    again = ~new & np.logical_or.reduce([c != c[origin] for c in columns[2:]])
    return [c[at] for c in columns], np.diff(np.append(at, len(new))) > 1, [c[again] for c in columns]


def phrases(texts: DataFrame, length: int, width: int) -> DataFrame:
    """The parse of ``doc_id, text, text_id``, a row per phrase, seen by its task (``first_places``); very long texts are parsed in overlapping pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                data, offsets = flat_bytes(part.column(1))
                ids, text_ids = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
                for at in range(0, max(len(data), 1), PIECE) if len(ids) == 1 else (0,):
                    if len(ids) == 1:
                        piece = data[at : at + PIECE + length - 1]
                        bounds = np.array([0, len(piece)])
                    else:
                        piece, bounds = data, offsets
                    first, last, trigger_at, trigger, phrase = parse(piece, bounds, length, width)
                    doc = np.searchsorted(bounds, first, "right") - 1
                    place = (first - bounds[doc] + at) << 16 | (last - first) << 8 | (trigger_at - first)
                    columns = [trigger, phrase, ids[doc], text_ids[doc], place]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["trigger", "phrase", "doc_id", "text_id", "place"])

    return texts.mapInArrow(trimmed(lambda batches: first_places(run(batches))), PHRASES)


def dictionary(parsed: DataFrame) -> DataFrame:
    """Phrases that matter: repeats of a phrase (trigger null) and phrases that share their trigger with another.

    Repeats that their task found (trigger null) go through. The rest is streamed in order, one row held at a time,
    so a trigger of any frequency fits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # trigger and phrase of the last row, and where that phrase came first
        pending: tuple | None = None  # first row of the open trigger while it is the only phrase
        for batch in batches:
            known = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            if known.any():
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(known)) for i in (0, 2, 3, 4)], NAMES)
                batch = batch.filter(pa.array(~known))
            if not batch.num_rows:
                continue
            trigger, phrase, doc, text, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            new_trigger = np.concatenate(([before is None or trigger[0] != before[0]], trigger[1:] != trigger[:-1]))
            new_phrase = new_trigger | np.concatenate(([before is None or phrase[0] != before[1]], phrase[1:] != phrase[:-1]))
            if new_trigger[0]:
                pending = None
            another = new_phrase & ~new_trigger
            run_id = np.cumsum(new_trigger)
            shared = np.unique(run_id[another])
            first_rows = np.flatnonzero(new_trigger & np.isin(run_id, shared))
            take = np.sort(np.concatenate([np.flatnonzero(another), first_rows]))
            # A row at its phrase's first place is that place again: a repeated row of one document.
            origin = np.maximum.accumulate(np.where(new_phrase, np.arange(len(doc)), -1))
            first = [x[origin] for x in (doc, text, place)]
            if before is not None:
                first = [np.where(origin < 0, b, x) for b, x in zip(before[2:], first)]
            repeats = np.flatnonzero(~new_phrase & ((doc != first[0]) | (text != first[1]) | (place != first[2])))
            rows_t = np.concatenate([trigger[take], np.zeros(len(repeats), np.int64)])
            rows = np.concatenate([take, repeats])
            lists = [rows_t, doc[rows], text[rows], place[rows]]
            null = np.concatenate([np.zeros(len(take), bool), np.ones(len(repeats), bool)])
            if pending is not None and 0 in shared:  # run 0 goes on from the batch before
                lists = [np.append(x, y) for x, y in zip(lists, pending)]
                null = np.append(null, False)
                pending = None
            last = int(run_id[-1])
            if last > 0 and last not in shared:
                i = int(np.flatnonzero(new_trigger)[-1])
                pending = (trigger[i], doc[i], text[i], place[i])
            elif last > 0:
                pending = None
            before = (trigger[-1], phrase[-1], *(x[-1] for x in first))
            if len(null):
                columns = [pa.array(lists[0], pa.int64(), mask=null), *(pa.array(x, pa.int64()) for x in lists[1:])]
                yield pa.RecordBatch.from_arrays(columns, NAMES)

    # Repeats may go to any task; their place deals them out.
    dealt = parsed.repartition(F.coalesce("trigger", F.xxhash64("doc_id", "place")))
    return dealt.sortWithinPartitions("trigger", "phrase", "doc_id", "text_id", "place").mapInArrow(trimmed(run), MARKS)


def suffixes(texts: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """Bytes of the dictionary phrases to sort, keyed by trigger.

    Phrases of triggers with more than ``GROUP_PHRASES`` of them come as single strings, keyed by
    two independent 64-bit hashes, so that no group of phrases has to fit into a task.
    """
    large = durable(shared.groupBy("trigger").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_PHRASES).select("trigger", F.lit(True).alias("large")))
    marked = shared.join(large, "trigger", "left")
    by_doc = marked.groupBy(*TEXT).agg(F.collect_list(F.struct("trigger", "place", F.coalesce("large", F.lit(False)).alias("large"))).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = flat_bytes(part.column(1))
                found = part.column(2)
                bounds = found.offsets.to_numpy()
                doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                values = found.values.slice(bounds[0], bounds[-1] - bounds[0])
                trigger, place = (values.field(i).to_numpy() for i in range(2))
                large = values.field(2).to_numpy(zero_copy_only=False)
                ids, text_ids = part.column(0).to_numpy(), part.column(3).to_numpy()
                start = offsets[doc] + (place >> 16)
                end = start + (place >> 8 & 255) + length
                small = np.flatnonzero(~large)
                raw = data.tobytes()
                blobs = [raw[a:b] for a, b in zip(start[small].tolist(), end[small].tolist())]
                columns = [trigger[small], np.zeros(len(small), np.int64), ids[doc[small]], text_ids[doc[small]], place[small]]
                yield _suffix_rows(columns, pa.array(blobs, pa.binary()))
                if large.any():
                    rows = np.flatnonzero(large)
                    many = (place[rows] >> 8 & 255) + 1
                    owner = np.repeat(rows, many)
                    step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                    at = start[owner] + step
                    keys = [r.between(r.prefixes(data), at, at + length).view(np.int64) for r in (prime_hash(4), prime_hash(5))]
                    yield _suffix_rows([*keys, ids[doc[owner]], text_ids[doc[owner]], ((place[owner] >> 16) + step) << 16], pa.nulls(len(owner), pa.binary()))

    return texts.join(by_doc, TEXT).select("doc_id", "text", "found", "text_id").mapInArrow(trimmed(run), SUFFIXES)


def _suffix_rows(columns: list[np.ndarray], blobs: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), blobs], ["key", "tie", "doc_id", "text_id", "place", "bytes"])


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes at every position of a text among all of them (equal bytes, equal rank).

    Prefix doubling: ranks of eight bytes, then of twice as many from two ranks each, until two
    overlapping ranks cover ``length``.
    """
    covered = min(8, length)
    n = len(data) - covered + 1
    ranks = np.zeros(n, np.uint64)
    for byte in range(covered):
        ranks <<= np.uint64(8)
        ranks |= data[byte : byte + n]
    ranks = np.unique(ranks, return_inverse=True)[1].astype(np.int64)
    while covered < length:
        step = min(covered, length - covered)
        pairs = ranks[:-step] * (int(ranks.max()) + 1) + ranks[step:]
        ranks = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        covered += step
    return ranks


def later_strings(rows: DataFrame, length: int) -> DataFrame:
    """Strings of the sorted suffixes that also start earlier, as ``doc_id, text_id, start, strings`` runs."""

    def sort_chunk(held: list[tuple]) -> tuple[np.ndarray, ...]:
        blobs = [b for *_, columns in held for b in columns]
        doc, text, place = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
        data = np.frombuffer(b"".join(blobs), np.uint8)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
        begin = np.cumsum(sizes) - sizes
        many = sizes - length + 1
        owner = np.repeat(np.arange(len(blobs)), many)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        rank = suffix_ranks(data, length)[begin[owner] + step]
        strings = [doc[owner], text[owner], (place[owner] >> 16) + step]
        order = np.lexsort((*strings[::-1], rank))
        equal = rank[order][1:] == rank[order][:-1]
        again, prior = order[1:][equal], order[:-1][equal]
        # Repeated rows of one document are the same place.
        again = again[np.logical_or.reduce([x[again] != x[prior] for x in strings])]
        return tuple(x[again] for x in strings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last_key = 0, None
        before: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, tie, doc, text, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            alone = batch.column(5).is_null().to_numpy(zero_copy_only=False)
            if alone.any():
                single = [x[alone] for x in (key, tie, doc, text, place)]
                if before is not None:
                    single = [np.concatenate(([x], y)) for x, y in zip(before, single)]
                k, t, d, i, p = ((x[1:] != x[:-1]) for x in single)
                again = 1 + np.flatnonzero(~k & ~t & (d | i | p))
                before = tuple(x[-1] for x in single)
                yield _runs(single[2][again], single[3][again], single[4][again] >> 16)
            rows = np.flatnonzero(~alone)
            if not len(rows):
                continue
            keys = key[rows]
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(rows)]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != last_key and size >= CHUNK_BYTES:
                    yield _runs(*sort_chunk(held))
                    held, size = [], 0
                last_key = keys[a]
                some = rows[a:b]
                blobs = batch.column(5).take(pa.array(some)).to_pylist()
                held.append((last_key, doc[some], text[some], place[some], blobs))
                size += sum(map(len, blobs))
        if held:
            yield _runs(*sort_chunk(held))

    return rows.repartition(F.col("key")).sortWithinPartitions("key", "tie", "doc_id", "text_id", "place").mapInArrow(trimmed(run), SPANS)


def _runs(doc: np.ndarray, text: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Neighbouring starts of one text as one row."""
    many = start
    if len(doc):
        order = np.lexsort((start, text, doc))
        doc, text, start = doc[order], text[order], start[order]
        other = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
        keep = np.concatenate(([True], other | (start[1:] != start[:-1])))
        doc, text, start = doc[keep], text[keep], start[keep]
        other = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
        cut = np.flatnonzero(np.concatenate(([True], other | (start[1:] != start[:-1] + 1))))
        many = np.diff(np.append(cut, len(doc)))
        doc, text, start = doc[cut], text[cut], start[cut]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, text, start, many)], ["doc_id", "text_id", "start", "strings"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every row of ``docs`` (``doc_id, text``; more columns are ignored).

    ``spans`` (array of start and end) are the maximal runs of bytes covered by a ``length``-byte
    string that also starts earlier: in a smaller doc_id, or earlier in the same text. ``kept`` is
    the rest. Strings never cross documents; null text is empty, shorter texts stay whole. A
    null doc_id has no place in the order, so nothing is removed from or because of it. Equal rows
    are one document; different texts of one doc_id are documents of their own, in the order of their hashes.
    """
    spark = docs.sparkSession
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = typed.where("doc_id is not null").withColumn("text_id", F.xxhash64("text"))
    path = scratch_path(spark, "repeats")
    dictionary(phrases(known, length, width)).write.option("compression", "zstd").parquet(path)
    marks = spark.read.schema(MARKS).parquet(path)
    # One shuffle of the texts serves the look-up of phrases and the removal.
    texts = known.repartition(*TEXT)
    later = later_strings(suffixes(texts, marks.where("trigger is not null"), length), length)
    whole = marks.where("trigger is null").select(*TEXT, F.shiftright("place", 16).alias("start"), (F.shiftright("place", 8).bitwiseAND(255) + 1).alias("strings"))
    spans = later.unionByName(whole).groupBy(*TEXT).agg(F.collect_list(F.struct("start", "strings")).alias("found"))
    cleaned = _remove(texts.join(spans, TEXT, "left"), length)
    nameless = typed.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<start:long,strings:long>>").alias("found"))
    return cleaned.union(_remove(nameless, length))


def _remove(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                found = part.column(2)
                sizes, spans, kept = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    raw = text.encode()
                    runs = merge_runs(found[i].values, length) if found[i].is_valid else []
                    pieces, at = [], 0
                    for a, b in runs:
                        pieces.append(raw[at:a])
                        at = b
                    pieces.append(raw[at:])
                    sizes.append(len(raw))
                    spans.append([{"start": a, "end": b} for a, b in runs])
                    kept.append(b"".join(pieces))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])

    return rows.select("doc_id", "text", "found").mapInArrow(trimmed(run), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def merge_runs(found: pa.StructArray, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by runs of strings; touching ones are one."""
    start = found.field(0).to_numpy(zero_copy_only=False)
    end = start + found.field(1).to_numpy(zero_copy_only=False) + length - 1
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return list(zip(start[cut].tolist(), end[np.append(cut[1:], len(start)) - 1].tolist()))


