"""Language identification: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest ridge.

Two texts are as alike as the share of byte n-grams (one to three bytes of the lower-cased
text) that both hold: k(x, y) = |common| / sqrt(|x| |y|). A bounded, seeded sample of landmark
texts spans the kernel (Nyström); one ridge regression per language is fitted on its features
from partition-summed normal equations. Scoring multiplies batches of presence rows
with the landmark matrix: every text is read whole, and memory is bounded whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.arrow_text import flat_bytes, slices, trimmed
from sensorloom.session import durable

LONGEST = 3
#: Codes of n-grams: three bytes, then two, then one.
STARTS = (0, 1 << 24, (1 << 24) + (1 << 16))
CODES = (1 << 24) + (1 << 16) + (1 << 8)
LANDMARKS = 192
TRAINING_ROWS = 2000
RIDGE = 1e-4
EIGEN = 1e-6
ROWS_AT_ONCE = 64
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def gram_codes(data: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of all byte n-grams of one text, by length."""
    wide = data.astype(np.int32)
    yield wide + STARTS[2]
    if len(wide) > 1:
        pairs = (wide[:-1] << 8) | wide[1:]
        yield pairs + STARTS[1]
        if len(wide) > 2:
            yield (pairs[:-1] << 8) | wide[2:]


class Spectrum:
    """Counts distinct n-grams in linear time: the last place of each code is noted and looked up again."""

    def __init__(self):
        self.place = np.zeros(CODES, np.int32)

    def distinct(self, codes: np.ndarray) -> int:
        at = np.arange(len(codes), dtype=np.int32)
        self.place[codes] = at
        return int((self.place[codes] == at).sum())

    def codes(self, data: np.ndarray) -> np.ndarray:
        parts = list(gram_codes(data))
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32)


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """UTF-8 bytes of every lower-cased text."""
    lowered = pa.array([t.lower() if t else "" for t in column.to_pylist()], pa.large_string())
    data, offsets = flat_bytes(lowered)
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield data[a:b]


@dataclass
class Model:
    """What a task needs: landmark presences by n-gram, and weights by landmark and language."""

    languages: list[str]
    grams: np.ndarray
    presence: np.ndarray
    sizes: np.ndarray
    features: np.ndarray
    weights: np.ndarray


class Scorer:
    def __init__(self, model: Model):
        self.model, self.spectrum = model, Spectrum()
        self.column = np.full(CODES, -1, np.int32)
        self.column[model.grams] = np.arange(len(model.grams), dtype=np.int32)
        self.landmarks = model.presence.astype(np.float32)
        self.presence = np.zeros((ROWS_AT_ONCE, len(model.grams)), np.float32)

    def kernel(self, column: pa.Array) -> np.ndarray:
        """Kernel values of every text with every landmark; 0 for texts without bytes."""
        out, sizes = [], []
        rows = list(texts(column))
        for start in range(0, len(rows), ROWS_AT_ONCE):
            part = rows[start : start + ROWS_AT_ONCE]
            self.presence[: len(part)] = 0.0
            for i, data in enumerate(part):
                size = 0
                for codes in gram_codes(data):
                    size += self.spectrum.distinct(codes)
                    found = self.column[codes]
                    self.presence[i, found[found >= 0]] = 1.0
                sizes.append(size)
            out.append(self.presence[: len(part)] @ self.landmarks)
        common = np.concatenate(out) if out else np.zeros((0, len(self.model.sizes)), np.float32)
        return common / np.sqrt(np.maximum(np.outer(sizes, self.model.sizes), 1.0))

    def expand(self, column: pa.Array) -> np.ndarray:
        """Nyström features and a constant."""
        features = self.kernel(column) @ self.model.features
        return np.hstack([features, np.ones((len(features), 1))])

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        languages = self.model.languages
        lettered = np.array([has_letter(t) for t in column.to_pylist()], bool)
        if not languages:
            return [UNKNOWN] * len(lettered), np.zeros(len(lettered))
        raw = self.expand(column) @ self.model.weights
        best = raw.argmax(axis=1)
        score = np.where(lettered, np.clip(raw[np.arange(len(raw)), best], 0.0, 1.0), 0.0)
        return [languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], score


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out, as is a null id."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def training_sample(known: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` different rows ``lang, text, rank`` of each language, lowest hashes first.

    The cut of each language is found on hashes alone, so texts are neither sorted nor shuffled before it.
    """
    hashed = known.withColumn("_hash", F.xxhash64("doc_id", "text"))
    place = Window.partitionBy("lang").orderBy("_hash")
    lowest = hashed.select("lang", "_hash").distinct().withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= per_language)
    cuts = [x for row in lowest.groupBy("lang").agg(F.max("_hash")).collect() for x in (F.lit(row[0]), F.lit(row[1]))]  # one per language
    chosen = hashed.where(F.col("_hash") <= F.create_map(*cuts)[F.col("lang")]) if cuts else hashed.limit(0)
    chosen = chosen.dropDuplicates(["lang", "_hash"])
    return chosen.withColumn("rank", F.row_number().over(place)).select("lang", "text", "rank")


def fit(known: DataFrame, landmarks: int = LANDMARKS, rows: int = TRAINING_ROWS, ridge: float = RIDGE) -> Model:
    """Fit on ``doc_id, text, lang``; rows with a null language, or without a letter, are not learnt from.

    ``rows`` bounds the sample per language, ``landmarks`` the landmarks of all languages
    (at least one each): the driver holds their n-grams and one square matrix of that size.
    """
    usable = known.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    sample = durable(training_sample(usable, rows).repartition(16, F.xxhash64("text")))
    languages = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not languages:
        return Model([], *(np.zeros(0, np.int64),) * 5)
    each = max(1, landmarks // len(languages))

    def spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum()
        for batch in batches:
            for data in texts(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([spectrum.codes(data).astype("<i4").tobytes()], pa.binary())], ["codes"])

    chosen = sample.where(F.col("rank") <= each).select("text").mapInArrow(trimmed(spectra), "codes binary").collect()
    codes = sorted(bytes(r.codes) for r in chosen)  # an order that does not depend on partitions
    sets = [np.frombuffer(c, "<i4") for c in codes]
    grams = np.unique(np.concatenate(sets))
    presence = np.zeros((len(grams), len(sets)), np.uint8)
    for j, s in enumerate(sets):
        presence[np.searchsorted(grams, s), j] = 1
    sizes = presence.sum(axis=0).astype(np.float64)
    wide = presence.astype(np.float32)
    values, vectors = np.linalg.eigh((wide.T @ wide).astype(np.float64) / np.sqrt(np.outer(sizes, sizes)))
    real = values > EIGEN * values.max()
    model = Model(languages, grams, presence, sizes, vectors[:, real] / np.sqrt(values[real]), np.zeros(0))
    size, classes = int(real.sum()) + 1, len(languages)
    shared = known.sparkSession.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, total, n = Scorer(shared.value), np.zeros((size, size + classes)), 0
        for batch in batches:
            for part in slices(batch):
                x = scorer.expand(part.column(0))
                y = np.array(part.column(1).to_pylist())[:, None] == np.array(shared.value.languages)[None, :]
                total += x.T @ np.hstack([x, y])
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n])], ["part", "n"])

    parts = sample.select("text", "lang").mapInArrow(trimmed(sums), "part binary, n long").collect()  # one of at most 16 partitions each
    total = sum(np.frombuffer(bytes(p.part)).reshape(size, size + classes) for p in parts)
    penalty = np.eye(size) * ridge * sum(p.n for p in parts)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(total[:, :size] + penalty, total[:, size:])
    shared.unpersist()
    return model


def predict_languages(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns, ``lang_pred`` and ``score`` (0 to 1) of every row.

    ``und`` and 0 stand for a null text, one without a letter, and for every text if nothing was
    learnt. Equal texts get equal answers; of equally likely languages the first in order is taken.
    """
    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = T.StructType([*source.drop("_text").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(shared.value)
            for part in slices(batch, "_text"):
                languages, score = scorer.predict(part.column(part.num_columns - 1))
                columns = [*part.columns[:-1], pa.array(languages, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "lang_pred", "score"])

    return source.mapInArrow(trimmed(run), schema)


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Learn from the documents with a language that are not held out, and predict all.

    Returns the ``keep`` columns (``doc_id``) with ``lang_pred`` and ``score``. Language, source and id of a
    document have no part in its prediction. Extra columns are not looked at; an empty table gives none.
    """
    model = fit(docs.where(fold(F.col("doc_id")) != 0).select("doc_id", "text", "lang"))
    return predict_languages(docs, model, keep or ["doc_id"])
