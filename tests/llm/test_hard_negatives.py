import math
import random

import numpy as np
import pytest
from llm_data import prepare
from pyspark.sql import functions as F

from sensorloom.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<double>, label int, score string, block string, unit int"


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, "s", "b", 1) for r in rows], SCHEMA).repartition(4)


def brute(rows, anchors, k=5):
    """All by definition, over whole numbers of any size."""
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[(i, label, tuple(math.floor(256 * x) for x in v))] = None
    kept = list(kept)
    out = []
    for a in kept:
        if not anchors(a[0]):
            continue
        scored = [(min(max(sum(x * y for x, y in zip(a[2], b[2])), h.LEAST), h.MOST), b) for b in kept if b is not a and len(b[2]) == len(a[2])]
        scored.sort(key=lambda s: (-s[0], s[1][0]))
        for p, positive in [s for s in scored if s[1][1] == a[1]][:k]:
            near = [s for s in scored if s[1][1] != a[1] and 80 * p <= 100 * s[0] <= 100 * p][:k]
            out += [(a[0], positive[0], rank, n[0], p, s) for rank, (s, n) in enumerate(near, 1)]
    return sorted(out)


def vectors(seed, n=700, dim=5, huge=False):
    rng = random.Random(seed)
    common = [rng.gauss(0, 1) for _ in range(dim)]
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 1) * (1e12 if huge and i % 3 == 0 else 1) for _ in range(dim)]
        if i % 3 == 1:  # ties: a third of all rows hold one vector
            v = list(common)
        rows.append((i, v, rng.choice([0, 0, 0, 1, 2])))
    rows += [rows[1], rows[1], rows[0], (None, common, 0), (9001, None, 1), (9002, common, None), (9003, [1.0, None, 1.0, 1.0, 1.0], 1)]
    rows += [(9004, [float("nan")] * dim, 1), (9005, [float("inf")] * dim, 1), (9006, [1.0] * (dim + 1), 1), (9007, [1.0] * (dim + 1), 1), (9008, [], 1), (9009, [], 0), (9010, [], 1)]
    return rows


@pytest.mark.parametrize("huge", [False, True])
def test_against_brute_force(spark, monkeypatch, huge):
    monkeypatch.setattr(h, "PAGE", 3)  # many pages and groups
    monkeypatch.setattr(h, "GROUP", 2)
    rows = vectors(3, huge=huge)
    got = h.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 5 == 0)


def test_rows_of_one_id_that_differ_are_different_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [0.5, 0.5], 1), (5, [1.0, 1.0], 1), (6, [0.9, 0.0], 2), (7, [0.95, 0.0], 3), (6, [0.85, 0.0], 2)]
    got = h.hard_negatives(frame(spark, rows), F.col("vec_id") == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i == 0)


def test_nothing_to_find(spark):
    rows = vectors(4, 30)
    for part in ([], [(1, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)]):
        assert h.hard_negatives(frame(spark, part), F.col("vec_id") == 0).count() == 0
    assert h.hard_negatives(frame(spark, rows), F.lit(None).cast("boolean")).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    block = np.floor(rng.normal(size=(200, 8)) * 20 + 100)
    anchors = np.floor(rng.normal(size=(50, 8)) * 256)
    least, most = h.bounds(anchors, block.min(axis=0)[None], block.max(axis=0)[None])
    scores = h.products(anchors, block)
    assert (scores >= least).all() and (scores <= most).all()
    assert (most[:, 0] - least[:, 0]).max() < 2 * np.abs(anchors).sum(axis=1).max() * 80


def test_hilbert_curve_visits_neighbours():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    place = h.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
