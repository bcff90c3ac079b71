"""Groups of rows streamed through Arrow: one call per group, never one Python worker call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.arrow_text import trimmed


def blocks(rows: DataFrame, key: str, member: Column, parts: Column) -> DataFrame:
    """Cut large groups so that every pair of members still meets in some block.

    Members of a group are dealt into ``parts`` chunks and each block holds two of them (a group
    of one part is one block). A group's rows grow by its number of parts, no block grows with
    the group. Adds ``block`` (long), which is the key to group by, ``chunk`` and ``inner`` (the
    block holds one chunk only).
    """
    chunk = F.when(F.col("_parts") > 1, F.pmod(F.xxhash64(member), F.col("_parts"))).otherwise(F.lit(0))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
    dealt = rows.withColumn("_parts", F.greatest(parts.cast("long"), F.lit(1).cast("long"))).withColumn("_chunk", chunk.cast("long")).select("*", other.alias("_other"))
    block = F.xxhash64(F.col(key), F.least("_chunk", "_other"), F.greatest("_chunk", "_other"))
    return dealt.withColumns({"block": block, "chunk": F.col("_chunk"), "inner": F.col("_chunk") == F.col("_other")}).drop("_parts", "_chunk", "_other")


def map_groups(rows: DataFrame, key: str, function: Callable[[pa.Table], pa.RecordBatch | None], schema) -> DataFrame:
    """``function`` over all rows of each value of ``key``, in partitions sorted by the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        out: list[pa.RecordBatch] = []
        size = 0

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                result = function(pa.Table.from_batches(held))
                held = []
                if result is not None and result.num_rows:
                    out.append(result)
                    size += result.num_rows
                if size > 10_000:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out.clear()
                    size = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != current:
                    yield from finish()
                    current = keys[a]
                held.append(batch.slice(a, b - a))
        yield from finish()
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return rows.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(trimmed(run), schema)


def spanning_links(ids: np.ndarray, flat: np.ndarray, offsets: np.ndarray, linked: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> tuple[list, list]:
    """A spanning forest of the links between token sets: ``(id, smaller id or root)`` lists.

    Set i is ``flat[offsets[i]:offsets[i + 1]]``, sorted by ids beforehand so that roots are
    smallest. ``linked(i, others, common)`` tells which of ``others`` are linked with i, given
    their numbers of common tokens. Breadth first: each set is compared once with those not
    reached yet, so what comes out is linear however many pairs are linked.
    """
    m = len(ids)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    inverse = inverse.astype(np.int32)  # positions of a block: half the memory
    shared = counts[inverse] > 1
    owner = np.repeat(np.arange(m, dtype=np.int32), np.diff(offsets))[shared]
    token = inverse[shared]
    del inverse, shared
    order = np.argsort(token, kind="stable")
    posting, by_token = owner[order], token[order]
    del order
    bounds = np.searchsorted(by_token, np.arange(len(counts) + 1, dtype=np.int32))
    del by_token
    own = np.searchsorted(owner, np.arange(m + 1, dtype=np.int32))
    del owner
    open_ = np.ones(m, bool)
    left, right = [], []
    for root in range(m):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            tokens = token[own[i] : own[i + 1]]
            if not len(tokens):
                continue
            starts, sizes = bounds[tokens], bounds[tokens + 1] - bounds[tokens]
            spread = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            near = posting[spread]
            near = near[open_[near]]
            if not len(near):
                continue
            common = np.bincount(near, minlength=m)
            others = np.flatnonzero(common)
            others = others[linked(i, others, common[others])]
            open_[others] = False
            left += ids[others].tolist()
            right += [ids[root]] * len(others)
            queue += others.tolist()
    return left, right
