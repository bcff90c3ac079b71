import random

import numpy as np
from llm_data import documents, texts
from pyspark.sql import functions as F

from sensorloom.llm import quality


def labelled(spark, n=400):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + str(rng.randrange(40)) for _ in range(rng.randint(20, 200))]
        rows.append((i, ". ".join(" ".join(words[j : j + 9]) for j in range(0, len(words), 9)) if good else " ".join(w.upper() + "!!" for w in words[:3] * 20)))
        labels.append((i, int(good), "x"))
    labels += [(0, None, "x"), (None, 1, "x"), (1, labels[1][1], "x"), (99_999, 1, "x")]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, score string")


def test_held_out_accuracy_and_no_peeking(spark):
    docs, labels = labelled(spark)
    held = quality.fold(F.col("doc_id")) == 2
    rows = docs.select("doc_id").join(labels.where("quality is not null").dropDuplicates(["doc_id"]), "doc_id").where(held).collect()
    assert len(rows) > 60
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.score_quality(docs, labels, ["doc_id"]).collect()}
    b = {r.doc_id: r.score for r in quality.score_quality(docs, flipped, ["doc_id"]).collect()}
    assert a == b
    right = [(a[r.doc_id] >= 0.5) == bool(r.quality) for r in rows]
    assert np.mean(right) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, s in a.items() if s >= 0.7}


def direct_scores(texts, labels):
    """Scores by definition: one least-squares problem over all rows of fold 0 and 1, the best monotone fit on fold 3."""
    import zlib

    folds = {d: zlib.crc32(str(d).encode()) % 4 for d in texts}
    features = {d: np.array(quality.statistics(t)) for d, t in texts.items()}
    known = sorted(d for d in labels if d in texts)
    learn = [d for d in known if folds[d] in (0, 1)]
    rows = np.array([features[d] for d in learn])
    mean, scale = rows.mean(0), rows.std(0)
    scale[scale <= 1e-9] = 1.0
    draw = np.random.default_rng(quality.SEED)
    frequencies = draw.normal(size=(rows.shape[1], quality.DIMENSIONS)) / quality.WIDTH
    phases = draw.uniform(0, 2 * np.pi, quality.DIMENSIONS)

    def row(x):
        z = np.clip((x - mean) / scale, -8, 8)
        waves = [np.sqrt(2 / quality.DIMENSIONS) * np.cos(z @ frequencies[:, j] + phases[j]) for j in range(quality.DIMENSIONS)]
        return np.array([*waves, *z, 1.0])

    x, y = np.array([row(r) for r in rows]), np.array([float(labels[d]) for d in learn])
    penalty = np.sqrt(np.array([quality.RIDGE * len(learn)] * (x.shape[1] - 1) + [1e-9]))
    weights = np.linalg.lstsq(np.vstack([x, np.diag(penalty)]), np.concatenate([y, np.zeros(x.shape[1])]), rcond=None)[0]
    raw = {d: float(row(f) @ weights) for d, f in features.items()}
    bins: dict = {}
    for d in known:
        if folds[d] == 3:
            place = min(max((raw[d] + 0.5) / 2, 0), 1) * (quality.BINS - 1)
            bins.setdefault(int(place + 0.5), []).append(d)
    order = [bins[b] for b in sorted(bins)]
    sums = np.cumsum([0] + [sum(labels[d] for d in b) for b in order])
    counts = np.cumsum([0] + [len(b) for b in order])
    m = len(order)
    average = [[(sums[b + 1] - sums[a]) / (counts[b + 1] - counts[a]) if a <= b else None for b in range(m)] for a in range(m)]
    best = [max(min(average[a][b] for b in range(i, m)) for a in range(i + 1)) for i in range(m)]
    blocks: list = []
    for i, members in enumerate(order):
        if i and abs(best[i] - best[i - 1]) < 1e-12:
            blocks[-1] += members
        else:
            blocks.append(list(members))
    knots = [np.mean([raw[d] for d in b]) for b in blocks]
    levels = [(sum(labels[d] for d in b) + y.mean()) / (len(b) + 1) for b in blocks]
    return {d: float(np.clip(np.interp(r, knots, np.maximum.accumulate(levels)), 0, 1)) for d, r in raw.items()}


def test_scores_are_those_of_one_direct_fit(spark):
    rng = random.Random(8)
    docs, _ = labelled(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    # Labels that the texts explain in part only, so that the monotone fit has blocks to merge.
    labels = {d: int(rng.random() < (0.8 if "!!" not in t else 0.3)) for d, t in texts.items()}
    frame = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    found = {r.doc_id: r.score for r in quality.score_quality(docs.repartition(7), frame, ["doc_id"]).collect()}
    wanted = direct_scores(texts, labels)
    assert found.keys() == wanted.keys() and len(set(found.values())) > 5
    assert max(abs(found[d] - wanted[d]) for d in wanted) < 1e-5


def test_awkward_rows_and_no_labels(spark):
    _, labels = labelled(spark, 40)
    docs = documents(spark)
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = quality.score_quality(docs, known, ["doc_id"]).collect()
        assert len(rows) == len(texts()) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0.5 for r in quality.score_quality(docs, labels.limit(0), ["doc_id"]).collect())
    assert quality.score_quality(documents(spark, []), labels, ["doc_id"]).count() == 0


def test_fold_is_crc32_of_the_id(spark):
    import zlib

    rows = spark.range(50).select("id", quality.fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)
