"""Texts of an Arrow batch as one flat byte array, so that numpy works on many documents at once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX_2 = np.uint64(0xD6E8FEB86659FD93)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, giving freed memory back to the system after each partition.

    Workers are kept for later stages; what their allocators hold would add up with the JVM's heap.
    """

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return bounded


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with at most ``limit`` bytes of text each (a longer text stands alone).

    numpy needs some ten bytes of memory per byte of text; this bounds it whatever the batch holds.
    """
    _, offsets = flat_bytes(batch.column(batch.schema.get_field_index(column)))
    start, rows = 0, batch.num_rows
    while start < rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after another and where each begins; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    x = x ^ (x >> np.uint64(29))
    x = x * MIX_2
    return x ^ (x >> np.uint64(32))


class RollingHash:
    """Polynomial hash modulo 2**64 over random byte values: any substring in constant time."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.table = draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(draw.integers(1 << 40, 1 << 62)) | 5  # odd, so that it has an inverse
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            size = max(n + 1, SLICE_BYTES + 1)
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def between(self, prefixes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefixes[end] - prefixes[start]) * self.inverses[start])


PRIMES = (2**31 - 1, 2**31 - 19)


class PrimeHash:
    """Polynomial hash of substrings modulo two primes with seeded bases, as one 64-bit value.

    Modulo 2**64 there are texts (Thue-Morse words) that collide in every base; modulo primes there are none.
    """

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.table = draw.integers(1, 2**31 - 20, 256, dtype=np.int64)
        self.bases = [int(b) for b in draw.integers(1 << 20, 2**31 - 20, len(PRIMES))]
        self.tables = [(np.ones(1, np.uint32), np.ones(1, np.uint32)) for _ in PRIMES]

    def _grow(self, n: int) -> None:
        if len(self.tables[0][0]) <= n:
            size = max(n + 1, SLICE_BYTES + 1)
            # Below 2**31: half the memory, of which every worker has its own.
            self.tables = [tuple(_powers(x, p, size).astype(np.uint32) for x in (b, pow(b, -1, p))) for b, p in zip(self.bases, PRIMES)]

    def prefixes(self, data: np.ndarray) -> list[np.ndarray]:
        self._grow(len(data))
        values, out = self.table[data], []
        for (powers, _), p in zip(self.tables, PRIMES):
            sums = np.zeros(len(data) + 1, np.int64)
            np.cumsum(values * powers[: len(data)] % p, out=sums[1:])
            out.append(sums)
        return out

    def between(self, prefixes: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = ((x[end] - x[start]) % p * inverses[start] % p for x, (_, inverses), p in zip(prefixes, self.tables, PRIMES))
        return mix((one.astype(np.uint64) << np.uint64(32)) | two.astype(np.uint64))


def _powers(base: int, prime: int, size: int) -> np.ndarray:
    """``base ** i`` modulo a prime below 2**31, by doubling."""
    out = np.ones(size, np.int64)
    done = 1
    while done < size:
        more = min(done, size - done)
        out[done : done + more] = out[:more] * pow(base, done, prime) % prime
        done += more
    return out


@lru_cache(maxsize=8)
def rolling_hash(seed: int) -> RollingHash:
    """The faster hash, for places where equal values are compared byte by byte or set the work only."""
    return RollingHash(seed)


@lru_cache(maxsize=4)
def prime_hash(seed: int) -> PrimeHash:
    return PrimeHash(seed)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every run without white space, and the first word of each document.

    White space is space and the characters 9 to 13. The last array has one more entry than
    there are documents, so document i has the words first[i] to first[i + 1].
    """
    inside = ~SPACE[data]
    before = np.zeros(len(data), bool)
    after = np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the first word of each document."""
    data, offsets = flat_bytes(column)
    if lower:
        data = LOWER[data]
    start, end, first = words(data, offsets)
    hashing = prime_hash(1)
    return hashing.between(hashing.prefixes(data), start, end), first


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each word on, and which of them lie inside one document.

    A document with fewer words (but at least one) has its whole sequence as its only shingle.
    """
    n = len(hashes)
    chained = np.zeros(n, np.uint64)
    valid = np.zeros(n, bool)
    counts = np.diff(first)
    last = np.repeat(first[1:], counts)
    position = np.arange(n)
    current = hashes.copy()
    for length in range(1, k + 1):
        if length > 1:
            current = mix(current * MIX + np.uint64(length))
            if n >= length:
                current[: n - length + 1] += hashes[length - 1 :]
        if length < k:
            short = first[:-1][counts == length]
            chained[short], valid[short] = mix(current[short]), True
    whole = position + k <= last
    chained[whole], valid[whole] = mix(current[whole]), True
    return chained, valid


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every document, as int64."""
    hashes, first = word_hashes(column)
    chained, valid = shingle_hashes(hashes, first, k)
    signed = chained.view(np.int64)
    return [np.unique(signed[a:b][valid[a:b]]) for a, b in zip(first[:-1], first[1:])]
