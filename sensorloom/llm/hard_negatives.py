"""Hard negatives: Hilbert-ordered Parquet blocks with zone maps, chosen per anchor by interval arithmetic.

Vectors become whole numbers, are ordered along a Hilbert curve over a few seeded projections
and written as Parquet blocks of one label each, with the least and greatest value of every
dimension. For an anchor, those intervals bound the inner products a block can hold from both
sides, so an anchor reads only blocks that can reach its window of scores. Bounds are taken
for groups of anchors against pages of zone maps, each pair of which is one bounded unit of
work; neither anchors nor zone maps are collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.arrow_text import trimmed
from sensorloom.llm.grouped import map_groups
from sensorloom.session import durable, scratch_path

AXES, BITS = 6, 10
SEED = 13
BLOCK = 1024
PAGE = 512
GROUP = 32
ANCHORS_AT_ONCE = 256
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1

ROWS = "vec_id long, label long, anchor boolean, dim int, width int, curve long, q binary"
BLOCKS = "block long, label long, dim int, width int, n int, ids binary, keys binary, q binary, low binary, high binary, anchors binary, floors binary"
ASKS = "home long, label long, dim int, id long, row_key long, q binary, lows array<long>, highs array<long>"
REQUESTS = "block long, ids binary, keys binary, vectors binary, lows binary, highs binary"
FOUND = "anchor_id long, anchor_key long, slot int, found_id long, found_key long, score long"
UNIT = "unit long, zone boolean, block long, label long, dim int, id long, row_key long, q binary, high binary, lows array<long>, highs array<long>"


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of each row of whole coordinates below ``2 ** bits``."""
    x = cells.T.astype(np.int64).copy()
    for b in range(bits - 1, 0, -1):
        bit, below = 1 << b, (1 << b) - 1
        for axis in x:
            upper = (axis & bit) != 0
            swap = np.where(upper, 0, (x[0] ^ axis) & below)
            x[0] ^= np.where(upper, below, swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= flip
    place = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            place = (place << 1) | ((axis >> b) & 1)
    return place


def curve_places(vectors: np.ndarray) -> np.ndarray:
    """Hilbert position of each vector's direction, seen along ``AXES`` seeded random projections."""
    n, dim = vectors.shape
    if not n or not dim:
        return np.zeros(n, np.int64)
    axes = np.random.default_rng([SEED, dim]).normal(size=(dim, AXES))
    unit = vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), 1.0)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    z = unit @ axes
    share = (1.0 + z / np.sqrt(1.0 + z * z)) / 2.0
    return hilbert(np.clip(share * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


def quantised(rows: DataFrame, scale: float) -> DataFrame:
    """``vec_id, label, anchor, vector`` with whole components; rows that take no part are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            if not batch.num_rows:
                continue
            lengths = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            flat = lists.flatten()
            values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.floor(values * scale) + 0.0
            start = np.concatenate(([0], np.cumsum(lengths)))
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            good = (bad[start[1:]] == bad[start[:-1]]) & ~np.asarray(lists.is_null())
            for dim in np.unique(lengths[good]):
                chosen = np.flatnonzero(good & (lengths == dim))
                vectors = values[start[chosen][:, None] + np.arange(dim)]
                width = np.where(np.abs(vectors).max(axis=1, initial=0.0) < 2.0**24, 4, 8).astype(np.int32)
                packed = [v.astype(f"<f{w}").tobytes() for v, w in zip(vectors, width)]
                taken = batch.take(pa.array(chosen))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns[:3], pa.array(np.full(len(chosen), dim, np.int32)), pa.array(width), pa.array(curve_places(vectors)), pa.array(packed, pa.binary())],
                    ["vec_id", "label", "anchor", "dim", "width", "curve", "q"],
                )

    return rows.mapInArrow(trimmed(run), ROWS)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors as int64; what lies beyond long counts as the nearest long."""
    if np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in b]
    out = [[min(max(sum(x * y for x, y in zip(p, q)), LEAST), MOST) for q in whole] for p in ([int(v) for v in row] for row in a)]
    return np.array(out, np.int64).reshape(len(a), len(b))


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector inside each block's intervals."""
    plus, minus = np.maximum(a, 0.0), np.minimum(a, 0.0)
    slack = np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T * 1e-12
    return plus @ low.T + minus @ high.T - slack, plus @ high.T + minus @ low.T + slack


def _vectors(data: bytes, width: int, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<f{width}").reshape(n, dim).astype(np.float64)


def write_blocks(rows: DataFrame, path: str, positives: int) -> DataFrame:
    """Blocks of up to ``BLOCK`` rows of one label in curve order, written and read again.

    Repeated rows (same id, label and vector) are neighbours in this order and count once. Each
    anchor gets a floor: the score of its ``positives``-th best other row in its own block.
    """
    order = ["label", "dim", "width", "curve", "vec_id", "row_key"]
    keyed = rows.withColumn("row_key", F.xxhash64("label", "q")).select(*order, "anchor", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, number = 0, TaskContext.get().partitionId() << 32
        before = None

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, number
            if size:
                table = pa.Table.from_batches(held).sort_by([("vec_id", "ascending"), ("row_key", "ascending")])
                yield _block(table, number, positives)
                number += 1
            held, size = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4, 5)]
            first = tuple(v[0] for v in values)
            step = [np.concatenate(([before is None or before[i] != first[i]], v[1:] != v[:-1])) for i, v in enumerate(values)]
            before = tuple(v[-1] for v in values)
            fresh = np.logical_or.reduce(step)
            change = np.logical_or.reduce(step[:3])[fresh]
            batch = batch.filter(pa.array(fresh))
            cuts = [0, *(c for c in np.flatnonzero(change).tolist() if c), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a < len(change) and change[a]:
                    yield from finish()
                while a < b:
                    take = min(b - a, BLOCK - size)
                    held.append(batch.slice(a, take))
                    size += take
                    a += take
                    if size == BLOCK:
                        yield from finish()
        yield from finish()

    built = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(trimmed(run), BLOCKS)
    built.write.parquet(path)
    return rows.sparkSession.read.schema(BLOCKS).parquet(path)


def _block(table: pa.Table, number: int, positives: int) -> pa.RecordBatch:
    n, dim, width = table.num_rows, table["dim"][0].as_py(), table["width"][0].as_py()
    packed = b"".join(table["q"].to_pylist())
    vectors = _vectors(packed, width, dim, n)
    places = np.flatnonzero(table["anchor"].to_numpy())
    floors = np.full(len(places), LEAST, np.int64)
    if n > positives:
        for a in range(0, len(places), ANCHORS_AT_ONCE):
            part = places[a : a + ANCHORS_AT_ONCE]
            scores = products(vectors[part], vectors)
            scores[np.arange(len(part)), part] = LEAST
            floors[a : a + ANCHORS_AT_ONCE] = np.partition(scores, n - positives, axis=1)[:, n - positives]
    values = [
        number, table["label"][0].as_py(), dim, width, n,
        table["vec_id"].to_numpy().astype("<i8").tobytes(), table["row_key"].to_numpy().astype("<i8").tobytes(), packed,
        vectors.min(axis=0).tobytes(), vectors.max(axis=0).tobytes(), places.astype("<i4").tobytes(), floors.tobytes(),
    ]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 7]
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)


def anchor_rows(blocks: DataFrame) -> DataFrame:
    """One row per anchor: its home block, vector and the floor of its positives' scores."""
    source = blocks.where(F.octet_length("anchors") > 0).select("block", "label", "dim", "width", "n", "ids", "keys", "q", "anchors", "floors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                places = np.frombuffer(block["anchors"], "<i4")
                m = len(places)
                vectors = _vectors(block["q"], block["width"], block["dim"], block["n"])[places]
                floors = np.frombuffer(block["floors"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block["block"]] * m, pa.int64()), pa.array([block["label"]] * m, pa.int64()), pa.array([block["dim"]] * m, pa.int32()),
                        pa.array(np.frombuffer(block["ids"], "<i8")[places]), pa.array(np.frombuffer(block["keys"], "<i8")[places]),
                        pa.array([v.tobytes() for v in vectors], pa.binary()),
                        pa.array([[f] for f in floors.tolist()], pa.list_(pa.int64())), pa.array([[MOST]] * m, pa.list_(pa.int64())),
                    ],
                    ["home", "label", "dim", "id", "row_key", "q", "lows", "highs"],
                )

    return source.mapInArrow(trimmed(run), ASKS)


def block_requests(asks: DataFrame, blocks: DataFrame, same_label: bool) -> DataFrame:
    """Which blocks each anchor must read: one row per block and group of anchors that ask for it.

    Groups of about ``GROUP`` home blocks meet pages of about ``PAGE`` zone maps; each unit holds one of either.
    """
    zones = blocks.select("block", "label", "dim", "low", "high")
    pages = max(1, -(-zones.count() // PAGE))
    groups = max(1, -(-asks.select("home").distinct().count() // GROUP))
    none = F.lit(None)
    left = asks.withColumns({"_group": F.pmod(F.xxhash64("home"), F.lit(groups)), "_page": F.explode(F.sequence(F.lit(0), F.lit(pages - 1)))}).select(
        (F.col("_page") * groups + F.col("_group")).cast("long").alias("unit"), F.lit(False).alias("zone"),
        F.col("home").alias("block"), "label", "dim", "id", "row_key", "q", none.cast("binary").alias("high"), "lows", "highs",
    )
    right = zones.withColumns({"_page": F.pmod(F.xxhash64("block"), F.lit(pages)), "_group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))}).select(
        (F.col("_page") * groups + F.col("_group")).cast("long").alias("unit"), F.lit(True).alias("zone"),
        "block", "label", "dim", none.cast("long").alias("id"), none.cast("long").alias("row_key"), F.col("low").alias("q"), "high",
        none.cast("array<long>").alias("lows"), none.cast("array<long>").alias("highs"),
    )

    def choose(table: pa.Table) -> pa.RecordBatch | None:
        zone = table["zone"].to_numpy()
        near, asked = table.filter(pa.array(zone)), table.filter(pa.array(~zone))
        if not near.num_rows or not asked.num_rows:
            return None
        out: dict[int, list[tuple]] = {}
        numbers, labels, dims = (near[c].to_numpy() for c in ("block", "label", "dim"))
        a_labels, a_dims = asked["label"].to_numpy(), asked["dim"].to_numpy()
        for label, dim in sorted(set(zip(a_labels.tolist(), a_dims.tolist()))):
            fits = np.flatnonzero((dims == dim) & ((labels == label) == same_label))
            if not len(fits):
                continue
            part = asked.filter(pa.array((a_labels == label) & (a_dims == dim)))
            vectors = _vectors(b"".join(part["q"].to_pylist()), 8, dim, part.num_rows)
            chosen = near.take(pa.array(fits))
            low, high = (_vectors(b"".join(chosen[c].to_pylist()), 8, dim, len(fits)) for c in ("q", "high"))
            ids, keys = part["id"].to_numpy(), part["row_key"].to_numpy()
            lows, highs = (np.array(part[c].to_pylist(), np.int64) for c in ("lows", "highs"))
            for a in range(0, len(ids), ANCHORS_AT_ONCE):
                s = slice(a, a + ANCHORS_AT_ONCE)
                least, most = bounds(vectors[s], low, high)
                reached = np.zeros(least.shape, bool)
                for w in range(lows.shape[1]):
                    real = lows[s, w] <= highs[s, w]
                    reached |= real[:, None] & (most >= lows[s, w][:, None]) & (least <= highs[s, w][:, None])
                for j in np.flatnonzero(reached.any(axis=0)):
                    r = a + np.flatnonzero(reached[:, j])
                    out.setdefault(int(numbers[fits[j]]), []).append((ids[r], keys[r], vectors[r], lows[r], highs[r]))
        names = [c.split()[0] for c in REQUESTS.split(", ")]
        columns = [pa.array(list(out), pa.int64())]
        columns += [pa.array([np.concatenate([p[i] for p in parts]).tobytes() for parts in out.values()], pa.binary()) for i in range(5)]
        return pa.RecordBatch.from_arrays(columns, names)

    fields = [c.split()[0] for c in UNIT.split(", ")]
    return map_groups(left.select(*fields).unionByName(right.select(*fields)), "unit", choose, REQUESTS)


def read_requested(requests: DataFrame, blocks: DataFrame, count: int) -> DataFrame:
    """The first ``count`` rows of every window among each requested block's, then among all blocks'."""
    joined = requests.withColumnsRenamed({"ids": "a_ids", "keys": "a_keys"}).join(blocks.select("block", "dim", "width", "n", "ids", "keys", "q"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, keys = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["keys"], "<i8")
                a_ids, a_keys = np.frombuffer(row["a_ids"], "<i8"), np.frombuffer(row["a_keys"], "<i8")
                m = len(a_ids)
                block = _vectors(row["q"], row["width"], row["dim"], row["n"])
                anchors = _vectors(row["vectors"], 8, row["dim"], m)
                lows, highs = (np.frombuffer(row[c], "<i8").reshape(m, -1) for c in ("lows", "highs"))
                for a in range(0, m, ANCHORS_AT_ONCE):
                    s = slice(a, a + ANCHORS_AT_ONCE)
                    scores = products(anchors[s], block)
                    other = (ids[None, :] != a_ids[s][:, None]) | (keys[None, :] != a_keys[s][:, None])
                    for w in range(lows.shape[1]):
                        i, j = np.nonzero(other & (scores >= lows[s, w][:, None]) & (scores <= highs[s, w][:, None]))
                        order = np.lexsort((j, ~scores[i, j], i))
                        i, j = i[order], j[order]
                        first = np.searchsorted(i, i)
                        kept = np.arange(len(i)) - first < count
                        i, j = i[kept], j[kept]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(a_ids[s][i]), pa.array(a_keys[s][i]), pa.array(np.full(len(i), w, np.int32)), pa.array(ids[j]), pa.array(keys[j]), pa.array(scores[i, j])],
                            [c.split()[0] for c in FOUND.split(", ")],
                        )

    found = joined.mapInArrow(trimmed(run), FOUND)
    best = Window.partitionBy("anchor_id", "anchor_key", "slot").orderBy(F.desc("score"), "found_id", "found_key")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= count)


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80, scale: float = 256.0,
    vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """For every anchor and each of its best rows of the same label, the best rows of other labels just below it.

    A component x counts as ``floor(scale * x)`` and a score is the inner product with the
    anchor; higher scores come first, then smaller ids. Positives are an anchor's first
    ``positives`` other rows of its label. A negative's score is at least ``least_percent`` percent of the
    positive's score and at most that score. Returns ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part.
    Vectors of different length have no score with each other; empty ones score 0. Repeated rows
    (same id, label and vector) count once; rows that share an id but differ are different rows.
    Extra columns are not looked at. A null ``anchor`` condition is false. The result is empty where no anchor has both.
    """
    spark = rows.sparkSession
    plain = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("vector"),
    ).where("vec_id is not null and label is not null and vector is not null")
    blocks = write_blocks(quantised(plain, scale), scratch_path(spark, "negative-blocks"), positives)
    asks = anchor_rows(blocks)
    best = durable(read_requested(block_requests(asks, blocks, True), blocks, positives).drop("slot"))

    low = F.ceil(F.col("score").cast("decimal(20,0)") * least_percent / 100).cast("long")
    windows = best.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("place", low.alias("low"), "score"))).alias("_w"))
    slots = [F.get("_w", F.lit(i)) for i in range(positives)]
    wanted = asks.drop("lows", "highs").join(windows, (F.col("id") == F.col("anchor_id")) & (F.col("row_key") == F.col("anchor_key")))
    wanted = wanted.select(
        "home", "label", "dim", "id", "row_key", "q",
        F.array(*[F.coalesce(s["low"], F.lit(1).cast("long")) for s in slots]).alias("lows"),
        F.array(*[F.coalesce(s["score"], F.lit(0).cast("long")) for s in slots]).alias("highs"),
    )
    wanted = durable(wanted)
    found = read_requested(block_requests(wanted, blocks, False), blocks, negatives)
    pairs = found.withColumnsRenamed({"place": "rank", "found_id": "negative_id", "score": "negative_score"}).withColumn("place", F.col("slot") + 1)
    chosen = best.select("anchor_id", "anchor_key", "place", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(chosen, ["anchor_id", "anchor_key", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""
