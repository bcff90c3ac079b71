"""Exact cosine range join of vectors: pivots cut the space into cells that join independently.

Unit vectors with cosine t lie sqrt(2 - 2 t) = r apart. A vector belongs to the cell of its
nearest pivot. If it lies within r of a vector of cell j, the triangle inequality gives
d(x, p_j) <= d(x, p_home) + 2 r, so it is copied to just those cells, and every linked pair
meets in the lower-numbered of its two cells. Cells that are still large are cut into blocks of
two chunks each. Copies of one vector are joined beforehand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.arrow_text import trimmed
from sensorloom.llm.graph import components
from sensorloom.llm.grouped import blocks, map_groups
from sensorloom.session import durable

COSINE = 0.98
CELL_MEMBERS = 2_048
SAMPLE = 4_096
LINKS = "src long, dst long, n long"
LINK_SCHEMA = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("n", pa.int64())])


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, unit``: the direction as float64 bytes, null where a vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = []
            column, labels, ids = batch.column(1), batch.column(2), batch.column(0)
            for i in range(batch.num_rows):
                value = column[i]
                unit = None
                if value.is_valid and labels[i].is_valid and ids[i].is_valid and len(value) and not value.values.null_count:
                    x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    most = np.abs(x).max()
                    if np.isfinite(most) and most > 0:
                        x = x / most
                        unit = (x / np.sqrt(x @ x)).tobytes()
                units.append(unit)
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(units, pa.binary())], ["vec_id", "label", "unit"])

    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"), F.col("label").cast("long").alias("label"))
    return source.mapInArrow(trimmed(run), "vec_id long, label long, unit binary")


def choose_pivots(classes: DataFrame, total: int) -> dict:
    """Pivots by (label, bytes of a vector), farthest first, from a bounded sample in hash order.

    About one pivot for ``CELL_MEMBERS`` vectors of a label, as far as the sample goes. Pivots
    set the work only: any choice gives the same links.
    """
    rows = classes.select("label", "unit", F.xxhash64("unit").alias("h")).orderBy("h", "label").limit(SAMPLE).collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault((r.label, len(r.unit)), []).append(np.frombuffer(bytes(r.unit)))
    pivots = {}
    for key, sample in groups.items():
        points = np.stack(sample)
        wanted = math.ceil(len(points) / len(rows) * total / CELL_MEMBERS)
        chosen, nearest = [0], 2 - 2 * points @ points[0]
        while len(chosen) < min(wanted, len(points)) and nearest.max() > 1e-9:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, 2 - 2 * points @ points[chosen[-1]])
        pivots[key] = points[chosen]
    return pivots


def cells(classes: DataFrame, pivots: dict, radius: float) -> DataFrame:
    """Each vector in its home cell and in each lower-numbered cell it may have links in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            labels, units = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            reps, counts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            by_space: dict = {}
            for i, (label, unit) in enumerate(zip(labels, units)):
                by_space.setdefault((label, len(unit)), []).append(i)
            for (label, size), rows in by_space.items():
                points = pivots.get((label, size))
                if points is None:
                    out += [(label, size, 0, True, reps[i], counts[i], units[i]) for i in rows]
                    continue
                x = np.stack([np.frombuffer(units[i]) for i in rows])
                distance = np.sqrt(np.maximum(2 - 2 * x @ points.T, 0))
                home = distance.argmin(1)
                own = distance[np.arange(len(rows)), home]
                reach = distance <= own[:, None] + 2 * radius + 1e-9
                between = np.sqrt(np.maximum(2 - 2 * points @ points.T, 1e-18))
                # Sharper on the line through both pivots: the distance to the plane between the cells.
                plane = (distance**2 - own[:, None] ** 2) / (2 * between[home])
                reach &= plane <= radius + 1e-6
                reach &= np.arange(len(points))[None, :] < home[:, None]
                for a, i in enumerate(rows):
                    out.append((label, size, int(home[a]), True, reps[i], counts[i], units[i]))
                    out += [(label, size, int(j), False, reps[i], counts[i], units[i]) for j in np.flatnonzero(reach[a])]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            names = ["label", "size", "cell", "home", "rep", "n", "unit"]
            for at in range(0, len(out), 4096):
                columns = list(zip(*out[at : at + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return classes.select("label", "unit", "rep", "n").mapInArrow(trimmed(run), "label long, size int, cell int, home boolean, rep long, n long, unit binary")


def cell_links(placed: DataFrame, cosine: float) -> DataFrame:
    """``src, dst, n``: degrees (dst null) and a spanning forest (n null) of each block."""
    keyed = placed.withColumn("key", F.xxhash64("label", "size", "cell"))
    sizes = durable(keyed.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > CELL_MEMBERS))
    joined = keyed.join(sizes, "key", "left")
    dealt = blocks(joined, "key", F.col("rep"), F.ceil(F.coalesce("members", F.lit(1)) / CELL_MEMBERS))

    def link(table: pa.Table) -> pa.RecordBatch | None:
        rep, order = np.unique(table["rep"].to_numpy(), return_index=True)
        n = table["n"].to_numpy()[order]
        home = table["home"].to_numpy()[order]
        chunk = table["chunk"].to_numpy()[order]
        inner = bool(table["inner"][0].as_py())
        units = table["unit"].to_pylist()
        x = np.stack([np.frombuffer(units[i]) for i in order])
        m = len(rep)
        mask = np.zeros((m, m), bool)
        for a in range(0, m, 1024):
            mask[a : a + 1024] = x[a : a + 1024] @ x.T >= cosine
        mask &= home[:, None] | home[None, :]
        if not inner:
            mask &= chunk[:, None] != chunk[None, :]
        np.fill_diagonal(mask, False)
        degree = mask @ n.astype(np.float64)
        src, dst = _forest(mask)
        linked = np.flatnonzero(degree)
        left = np.concatenate([rep[linked], rep[src]]).astype(np.int64)
        right = pa.array([None] * len(linked) + rep[dst].tolist(), pa.int64())
        count = pa.array(degree[linked].astype(np.int64).tolist() + [None] * len(src), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(left), right, count], schema=LINK_SCHEMA)

    return map_groups(dealt.select("block", "chunk", "inner", "home", "rep", "n", "unit"), "block", link, LINKS)


def _forest(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every reached row to the smallest row of its component."""
    src, dst = [], []
    open_ = mask.any(1)
    for root in np.flatnonzero(open_):
        if not open_[root]:
            continue
        reached = np.zeros(len(mask), bool)
        front = np.array([root])
        reached[root] = True
        while len(front):
            front = np.flatnonzero(mask[front].any(0) & ~reached)
            reached[front] = True
        open_[reached] = False
        reached[root] = False
        members = np.flatnonzero(reached)
        src.append(members)
        dst.append(np.full(len(members), root))
    empty = np.zeros(0, np.int64)
    return np.concatenate(src or [empty]), np.concatenate(dst or [empty])


def embedding_components(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding, label``).

    Vectors link when their labels and lengths are equal and their cosine reaches ``cosine``.
    Null vectors, ids or labels, zero vectors and those with null or non-finite components link
    with nothing. Repeated rows count as vectors of their own; an id that comes with several
    vectors joins their components.
    """
    units = durable(unit_vectors(vectors))
    # A class of equal vectors goes by a hash of its own: one id may come with several vectors.
    named = units.where("unit is not null").withColumn("rep", F.xxhash64("label", "unit"))
    classes = durable(named.groupBy("label", "unit", "rep").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")))
    radius = math.sqrt(max(2 - 2 * cosine, 0))
    pivots = choose_pivots(classes, classes.count())
    links = durable(cell_links(cells(classes, pivots, radius), cosine))
    degree = links.where("n is not null").groupBy(F.col("src").alias("rep")).agg(F.sum("n").alias("linked"))
    ids = named.groupBy("vec_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    same_id = named.join(ids.select("vec_id", "low"), "vec_id").where("rep <> low").select(F.col("rep").alias("src"), F.col("low").alias("dst")).distinct()
    found = components(links.where("dst is not null").select("src", "dst").unionByName(same_id)).select(F.col("id").alias("rep"), F.col("component").alias("_class"))
    joined = durable(classes.join(degree, "rep", "left").join(found, "rep", "left").withColumn("_class", F.coalesce("_class", "rep")))
    smallest = joined.groupBy("_class").agg(F.min("least").alias("component"))
    labelled = joined.join(smallest, "_class").select(
        "label", "unit", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), "component"
    )
    out = units.join(labelled, ["label", "unit"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
