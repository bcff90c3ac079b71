import random

import duckdb
import pytest
from llm_data import documents, shown, texts
from pyspark.sql import functions as F

from sensorloom.llm import decontaminate


def benchmark(spark, rows=None):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(["Which", "of", "these", "is", "né"] + [f"w{j}" for j in range(60)], k=rng.randint(12, 50)))) for i in range(12)]
    items += [(20, "too short one"), (21, None), (22, ""), (None, items[0][1]), (23, items[1][1]), (0, items[0][1])]
    return spark.createDataFrame(items if rows is None else rows, "item_id long, text string"), items


def leaky(spark):
    bench, items = benchmark(spark)
    rows = [r for r in texts() if r[0] is not None]
    for i in range(12):
        words = items[i][1].split()
        rows.append((200 + i, "before it all, " + ", ".join(words).upper() + " and after"))
        rows.append((220 + i, " ".join(words[: -1 if i % 2 else None] + ["some", "more"])))
        rows.append((240 + i, " ".join(words[: len(words) // 2])))
        edited = list(words)
        edited[len(words) // 2 : len(words) // 2] = ["inserted"]
        rows.append((260 + i, "x y z " * 5 + " ".join(edited)))
    return documents(spark, [*rows, (None, items[3][1])]), bench


def test_same_rows_as_sql_and_planted_leaks(spark):
    docs, bench = leaky(spark)
    found = decontaminate.contaminated(docs, bench)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    con.register("benchmark", bench.dropDuplicates(["item_id"]).toPandas())
    columns = ["doc_id", "item_id", "start", "n_words", "similarity"]
    want = set(con.sql(f"SELECT {', '.join(columns)} FROM ({decontaminate.SQL})").fetchall())
    got = shown(found.select(*columns))
    assert got == want and {(200 + i, i) for i in range(12)} <= {(d, i) for d, i, *_ in got}
    assert not {d for d, *_ in got} & {r[0] for r in texts()}
    kept = decontaminate.keep_uncontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, *_ in got}


def test_many_seeds_take_the_shuffled_way(spark, monkeypatch):
    docs, bench = leaky(spark)
    usual = shown(decontaminate.contaminated(docs, bench))
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", 0)
    assert shown(decontaminate.contaminated(docs, bench)) == usual


def test_empty_tables(spark):
    docs, bench = leaky(spark)
    assert decontaminate.contaminated(documents(spark, []), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_no_python_runs(spark):
    docs, bench = leaky(spark)
    plan = decontaminate.windows(docs, spark.createDataFrame([(1, 5, 0)], "shingle long, n int, item_pos int"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("radius", [7, 15])
def test_blocks_find_every_fingerprint_in_the_radius(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(8)]
    prints = []
    for i in range(400):
        x = base[i % 8]
        for bit in rng.sample(range(64), i % 24):
            x ^= 1 << bit
        prints.append((i, 0, 5, x - (1 << 64) if x >> 63 else x))
    items = [(i, 5 if i else 6, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(base)]
    found = decontaminate.hamming_candidates(
        spark.createDataFrame(prints, "doc_id long, start int, n int, fingerprint long"), spark.createDataFrame(items, "item_id long, n int, fingerprint long"), radius
    )
    want = {(d, 0, 5, i) for d, _, _, x in prints for i, n, y in items if n == 5 and ((x ^ y) & (1 << 64) - 1).bit_count() <= radius}
    assert shown(found) == want and want


def test_simhash_takes_the_majority_of_bits(spark):
    row = spark.range(1).select(F.lit(1).alias("k"), F.expr("array(1L, 3L, -1L)").alias("hashes"))
    assert decontaminate.simhash(row, ["k"]).first().fingerprint == 3


@pytest.mark.parametrize("limit", [100_000, 0])
def test_every_text_of_a_doc_id_is_searched(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", limit)
    rng = random.Random(9)
    item = [f"w{rng.randrange(900)}" for _ in range(30)]
    other = [[f"x{rng.randrange(900)}" for _ in range(80)] for _ in range(6)]
    # Windows of both texts of document 1 begin at the same word; those of 2 leak in the second text only.
    rows = [(1, " ".join(other[0][:10] + item + other[0][10:])), (1, " ".join(other[1][:10] + item[:3] + other[1][10:])), (2, " ".join(other[2])), (2, " ".join(other[3] + item)), (3, " ".join(other[4]))]
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    for shuffled in (rows, rows[::-1]):
        found = decontaminate.contaminated(documents(spark, shuffled), benchmark).collect()
        assert sorted((r.doc_id, r.item_id, r.start, r.similarity) for r in found) == [(1, 7, 10, 1.0), (2, 7, 80, 1.0)]
