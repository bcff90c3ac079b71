import math
from collections import Counter

import numpy as np
import pytest

from sensorloom.llm import embedding_join
from sensorloom.session import ship_package

SCHEMA = "vec_id long, embedding array<float>, label int, unit string, n int, key string"


def vectors(seed=4, size=8):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, 2):
        for _ in range(25):
            center = rng.normal(size=size)
            for _ in range(rng.integers(1, 6)):
                rows.append((i, (center + rng.normal(size=size) * 0.12).tolist(), label))
                i += 1
    same = rows[3][1]
    rows += [(i + j, same, rows[3][2]) for j in range(5)]
    rows += [(i + 10, [x * 3 for x in same], 0), (i + 11, None, 0), (i + 12, [0.0] * size, 0), (i + 13, [math.nan] * size, 0), (i + 14, [math.inf] + [1.0] * (size - 1), 0)]
    rows += [(i + 15, [None] + [1.0] * (size - 1), 0), (i + 16, same, None), (None, same, 0), (i + 17, [], 0), (i + 18, [1.0, 2.0], 0), (i + 19, [1.0, 2.0], 0), rows[0]]
    return rows


def expected(rows, cosine):
    ok = []
    for v, e, label in rows:
        good = v is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
        ok.append(np.float32(e).astype(float) / np.linalg.norm(np.float32(e).astype(float)) if good else None)
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i, (a, _, la) in enumerate(rows):
        for j, (b, _, lb) in enumerate(rows[:i]):
            if ok[i] is not None and ok[j] is not None and la == lb and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= cosine:
                links[i] += 1
                links[j] += 1
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    out = Counter()
    for i, (v, _, _) in enumerate(rows):
        c = None if v is None else root(v)
        out[(v, links[i], c, None if v is None else c == v)] += 1
    return out


@pytest.mark.parametrize("cell, cosine", [(2048, 0.98), (20, 0.98), (6, 0.9), (20, 0.5)])
def test_links_match_brute_force(spark, monkeypatch, cell, cosine):
    ship_package(spark)
    monkeypatch.setattr(embedding_join, "CELL_MEMBERS", cell)
    rows = vectors()
    table = spark.createDataFrame([(*r, "u", 1, "k") for r in rows], SCHEMA).repartition(4)
    assert Counter(tuple(r) for r in embedding_join.embedding_components(table, cosine).collect()) == expected(rows, cosine)


def test_no_rows(spark):
    assert embedding_join.embedding_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_id_with_several_vectors_loses_no_link(spark):
    near = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.01]
    rows = [(1, near[2], 1), (2, near[0], 1), (3, near[1], 1), (3, near[3], 1), (4, [0.0, 0.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = sorted(tuple(r) for r in embedding_join.embedding_components(frame).collect())
    assert found == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
