"""Quality scores: random Fourier features over document statistics, ridge, isotonic calibration.

Statistics of whole texts approximate a Gaussian kernel through random cosine features. Each
partition sums its part of the normal equations; the driver adds a bounded number of these
fixed-size matrices, solves for the ridge weights and calibrates scores by isotonic regression
over a fixed number of score bins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.arrow_text import slices, trimmed
from sensorloom.session import durable

FEATURES = [
    "log_bytes", "log_words", "mean_word", "long_words", "distinct_words", "top_word", "top_5_words", "upper", "digits", "punctuation",
    "commas", "stops", "exclamation", "bars", "other_symbols", "non_ascii", "lines_per_word", "repeated_lines", "short_lines",
    "repeated_bigrams", "adjacent_repeats", "one_letter_words", "upper_words", "capital_words",
]
DIMENSIONS = 256
WIDTH = 4.0
RIDGE = 1e-3
PARTS = 16
BINS = 512
SEED = 5


def statistics(text: str) -> list[float]:
    """One value per name of ``FEATURES``, over the whole text; all finite, also for empty text."""
    words = text.split()
    n, chars = len(words), len(text)
    if n == 0:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    top = counts.most_common(5)
    lines = text.split("\n")
    line_counts = Counter(lines)
    per_char, per_word = 1.0 / chars, 1.0 / n
    letters = chars - text.count(" ") - text.count("\n")
    lengths = sum(map(len, words))
    ascii_only = len(text.encode("ascii", "ignore"))
    pairs = Counter(zip(words, words[1:]))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = sum(map(text.count, "0123456789"))
    points = {c: text.count(c) for c in ".,;:!?|\"'()[]{}<>/\\#$%&*+=@^_~-"}
    common = sum(points[c] for c in ".,;:?\"'()-")
    exclaim, bars = points["!"], points["|"]
    distinct_upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    capital = sum(c for w, c in counts.items() if w[0].isupper())
    return [
        np.log1p(chars),
        np.log1p(n),
        lengths * per_word,
        sum(c for w, c in counts.items() if len(w) > 20) * per_word,
        len(counts) * per_word,
        top[0][1] * per_word,
        sum(c for _, c in top) * per_word,
        upper * per_char,
        digits * per_char,
        common * per_char,
        points[","] * per_word,
        points["."] * per_word,
        exclaim * per_word,
        bars * per_word,
        (sum(points.values()) - common - exclaim - bars) * per_char,
        (chars - ascii_only) / max(letters, 1),
        len(lines) * per_word,
        1.0 - len(line_counts) / len(lines),
        sum(len(x) < 30 for x in lines) / len(lines),
        1.0 - len(pairs) / max(n - 1, 1),
        sum(c for (a, b), c in pairs.items() if a == b) * per_word,
        sum(c for w, c in counts.items() if len(w) == 1) * per_word,
        distinct_upper * per_word,
        capital * per_word,
    ]


def document_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``features`` (array of double) of every row; null text counts as empty."""
    source = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    schema = source.drop("_text").schema.add("features", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                values = [statistics(t) for t in part.column(part.num_columns - 1).to_pylist()]
                columns = [*part.columns[:-1], pa.array(values, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "features"])

    return source.mapInArrow(trimmed(run), schema)


@dataclass
class Model:
    """Everything a task needs to score: a few hundred kilobytes, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, features: np.ndarray) -> np.ndarray:
        return expand(features, self.mean, self.scale, self.frequencies, self.phases) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(features), self.knots, self.levels), 0.0, 1.0)


def expand(features, mean, scale, frequencies, phases) -> np.ndarray:
    """Random cosine features of the standardised statistics, the statistics themselves and a constant."""
    z = np.clip((features - mean) / scale, -8, 8)
    waves = np.cos(z @ frequencies + phases) * np.sqrt(2.0 / len(phases))
    return np.hstack([waves, z, np.ones((len(z), 1))])


def fit(labelled: DataFrame, dimensions: int = DIMENSIONS, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Fit on ``features, label, fold``: weights on fold 0, calibration on fold 1.

    Rows with a null label or features are left out. With no rows, or one class only, the
    score is the mean label (0.5 without rows).
    """
    rows = labelled.where("label is not null and features is not null").select("features", F.col("label").cast("double").alias("label"), "fold")
    rows = durable(rows)
    d = len(FEATURES)
    moments = rows.where("fold = 0").select(
        F.count("*"), F.coalesce(F.avg("label"), F.lit(0.5)),
        *[f(F.col("features")[i]) for f in (F.avg, F.stddev_pop) for i in range(d)],
    ).first()
    n, prior = moments[0], moments[1]
    mean = np.array([x or 0.0 for x in moments[2 : 2 + d]])
    scale = np.array([x if x and x > 1e-9 else 1.0 for x in moments[2 + d :]])
    draw = np.random.default_rng(seed)
    frequencies = draw.normal(size=(d, dimensions)) / width
    phases = draw.uniform(0, 2 * np.pi, dimensions)
    size = dimensions + d + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                x = expand(_matrix(batch.column(0), d), mean, scale, frequencies, phases)
                total += x.T @ np.column_stack([x, batch.column(1).to_numpy(zero_copy_only=False)])
        if total[-1, -2]:  # rows seen
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_buffer()).reshape(size, size + 1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    each = rows.where("fold = 0").select("features", "label").mapInArrow(trimmed(sums), "part binary")
    parts = each.repartition(PARTS).mapInArrow(trimmed(add), "part binary").collect()  # one matrix of fixed size per part
    total = sum((np.frombuffer(bytes(p.part)).reshape(size, size + 1) for p in parts), np.zeros((size, size + 1)))
    penalty = np.eye(size) * ridge * max(n, 1)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(total[:, :size] + penalty, total[:, size])
    model = Model(mean, scale, frequencies, phases, weights, np.array([0.0]), np.array([float(prior)]))
    if n:
        model.knots, model.levels = _calibrate(rows, model, float(prior))
    return model


def _calibrate(rows: DataFrame, model: Model, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of labels on raw scores of fold 1 (of fold 0 if that is empty), over score bins."""
    scored = _scored(rows, ["fold", "label"], model, raw=True)
    low, high = -0.5, 1.5
    place = F.least(F.greatest((F.col("score") - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * (BINS - 1)
    bins = (
        scored.groupBy("fold", F.round(place).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("total"), F.avg("score").alias("at")).collect()
    )  # at most 2 x BINS rows
    use = [b for b in bins if b.fold == 1] or bins
    blocks: list[list[float]] = []
    for b in sorted(use, key=lambda b: b.bin):
        blocks.append([b.at * b.n, b.total, b.n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    knots = np.array([b[0] / b[2] for b in blocks])
    levels = np.array([(b[1] + prior) / (b[2] + 1) for b in blocks])
    return knots, np.maximum.accumulate(levels)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def _scored(rows: DataFrame, keep: list[str], model: Model, raw: bool = False) -> DataFrame:
    source = rows.select(*keep, "features")
    schema = source.drop("features").schema.add("score", "double")
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.num_columns - 1), d)
            score = (model.raw(x) if raw else model.score(x)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"])

    return source.mapInArrow(trimmed(run), schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)).cast("int")


def labels_by_document(labels: DataFrame, column: str = "quality") -> DataFrame:
    """One row per document: the mean of its labels that are not null."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.avg(F.col(column).cast("double")).alias("label"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Weights from labelled rows of folds 0 and 1, calibration from fold 3; fold 2 is never learnt from.

    All labelled rows count, nothing is sampled.
    """
    return _trained(docs.select("doc_id", "text"), labels, None)


def _trained(docs: DataFrame, labels: DataFrame, features: DataFrame | None) -> Model:
    known = labels_by_document(labels)
    split = fold(F.col("doc_id"))
    rows = features if features is not None else document_statistics(docs, ["doc_id"])
    return fit(rows.select("doc_id", "features").join(known, "doc_id").where(split != 2).withColumn("fold", (split == 3).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, with all their columns.

    Statistics are computed twice (for the fit and for the filter), so that texts need neither
    a shuffle nor a copy on disk.
    """
    model = train(docs, labels)
    place = docs.columns.index("text")
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                values = [statistics(t or "") for t in part.column(place).to_pylist()]
                score = model.score(np.array(values).reshape(-1, d))
                yield part.filter(pa.array(score >= least))

    return docs.mapInArrow(trimmed(run), docs.schema)


def score_quality(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns (doc_id among them) and ``score`` of every row.

    Null and empty texts are scored like any other, from statistics that are all 0. Repeated
    rows get equal scores.
    """
    features = durable(document_statistics(docs, keep))
    model = _trained(docs, labels, features)
    return _scored(features, keep, model)

