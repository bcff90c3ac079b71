import random
import zlib

import numpy as np
import pyarrow as pa
from llm_data import SCHEMA, documents, prepare, texts
from pyspark.sql import functions as F

from sensorloom.llm import language
from sensorloom.llm.queries import op11_language

SYLLABLES = {"aa": "ba de ki lo mu ra", "bb": "sta nne ö ver ich ung", "cc": "что не по ма то ра"}


def prose(rng, lang, words):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(words)).capitalize() + "."


def known(spark, n=600, seed=1):
    prepare(spark)
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["aa", "aa", "aa", "bb", "cc"])
        rows.append((i, prose(rng, lang, rng.choice([3, 10, 200])), lang if i % 9 else None, "s", 1, "h", 1, 2))
    rows += [rows[1]] * 3 + [(700, None, "aa", "s", 1, "h", 1, 2), (701, "", "bb", None, 1, "h", 1, 2), (702, "12 34 - ²", "cc", "s", 1, "h", 1, 2)]
    rows += [(None, rows[2][1], "bb", "s", 1, "h", 1, 2), (703, prose(rng, "cc", 40_000), "cc", "s", 1, "h", 1, 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), rows


def sets(text):
    data = text.lower().encode()
    return {data[i : i + n] for n in (1, 2, 3) for i in range(len(data) - n + 1)}


def test_kernel_is_the_blended_spectrum(spark):
    docs, rows = known(spark, 120)
    model = language.fit(docs.select("doc_id", "text", "lang"), landmarks=30)
    scorer = language.Scorer(model)
    landmarks = []
    for j in range(len(model.sizes)):
        codes = set(model.grams[model.presence[:, j] > 0].tolist())
        landmarks.append({c.to_bytes(3, "big") if c < 1 << 24 else (c - language.STARTS[1]).to_bytes(2, "big") if c < language.STARTS[2] else bytes([c - language.STARTS[2]]) for c in codes})
    assert all(any(s == sets(r[1] or "") for r in rows) for s in landmarks)
    column = pa.array([r[1] for r in rows])
    wanted = [[len(sets(r[1] or "") & s) / np.sqrt(max(len(sets(r[1] or "")) * len(s), 1)) for s in landmarks] for r in rows]
    assert np.allclose(scorer.kernel(column), wanted, atol=1e-6)


def test_weights_are_the_ridge_solution(spark):
    docs, _ = known(spark, 200)
    source = docs.select("doc_id", "text", "lang")
    model = language.fit(source, landmarks=20)
    used = language.training_sample(source.where("lang is not null").where(F.col("text").rlike("\\p{L}")), language.TRAINING_ROWS).collect()
    x = language.Scorer(model).expand(pa.array([r.text for r in used]))
    y = np.array([[float(r.lang == c) for c in model.languages] for r in used])
    penalty = np.eye(x.shape[1]) * language.RIDGE * len(x)
    penalty[-1, -1] = 1e-9
    assert np.allclose(model.weights, np.linalg.solve(x.T @ x + penalty, x.T @ y), atol=1e-6)


def test_held_out_accuracy_without_peeking(spark, tmp_path):
    docs, rows = known(spark)
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    held = language.fold(F.col("doc_id")) == 0
    docs.withColumns({"lang": F.when(held, "zz").otherwise(F.col("lang")), "source": F.lit("x")}).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    first, second = (sorted(map(tuple, op11_language(spark, str(tmp_path / d)).collect()), key=str) for d in "ab")
    assert first == second and len(first) == len(rows)
    truth = {r[0]: r for r in rows}
    right = [lang == truth[d][2] for d, out, lang, _ in first if out and d is not None and truth[d][2] and truth[d][1]]
    assert len(right) > 80 and np.mean(right) > 0.97
    for doc, out, lang, score in first:
        assert out == (doc is None or zlib.crc32(str(doc).encode()) % 5 == 0) and 0 <= score <= 1
        if doc in (700, 701, 702):
            assert (lang, score) == ("und", 0.0)
        elif doc == 703:
            assert lang == "cc"
        else:
            assert lang in SYLLABLES


def test_awkward_rows_and_nothing_to_learn(spark):
    docs = documents(spark)
    assert language.identify(docs).count() == len(texts())
    unknown = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}
    assert language.identify(documents(spark, [])).count() == 0


def test_sample_is_bounded(spark):
    docs, _ = known(spark)
    rows = language.training_sample(docs.where("lang is not null and text is not null"), 20)
    assert {r["count"] for r in rows.groupBy("lang").count().collect()} == {20}
