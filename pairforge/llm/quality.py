"""Quality by compression: the text goes with the dictionary under which it gets smaller.

Two zstandard dictionaries are built from labelled good and bad text. A document is cut into chunks, each is compressed
with either dictionary, and the difference of the compressed sizes, summed over the whole text and divided by its bytes,
is mapped to a probability by logistic calibration on labelled documents that the dictionaries have not seen.

Fitting uses a bounded sample of rows (`per_class` documents of each label, whole texts); scoring reads whole texts, very
long ones too. Defined results: null and empty texts get the calibrated score of a difference of zero; without both labels
the score is the smoothed share of label 1; a null id is in no held-out fold; repeated rows are scored each; a score equal
to the threshold is kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from pairforge.llm.common import free_name, small_batches
from pairforge.llm.training import labelled, remainder, sample

PER_CLASS = 1500
CHUNK = 1024
LEVEL = 3
DICTIONARY_BYTES = 65_536
FOLD = (3, 1)


@dataclass(frozen=True)
class QualityModel:
    good: bytes | None
    bad: bytes | None
    #: Score = logistic(a + b * difference).
    a: float
    b: float

    def score(self, difference: float) -> float:
        z = self.a + self.b * difference
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary from chunks of the texts; for too few of them, the texts themselves."""
    chunks = [t[k : k + CHUNK] for t in texts for k in range(0, len(t), CHUNK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, chunks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chunks)[-DICTIONARY_BYTES:] or b" " * 8


class Scorer:
    def __init__(self, model: QualityModel):
        self.model = model
        self.by = [self._compressor(d) for d in (model.good, model.bad)] if model.good is not None else None

    @staticmethod
    def _compressor(data: bytes):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def difference(self, text: bytes) -> float:
        """(size by the bad dictionary - size by the good one) / bytes, over the whole text."""
        if not text or self.by is None:
            return 0.0
        good, bad = self.by
        total = 0
        for k in range(0, len(text), CHUNK):
            piece = text[k : k + CHUNK]
            total += len(bad(piece)) - len(good(piece))
        return total / len(text)

    def score(self, text: bytes) -> float:
        return self.model.score(self.difference(text))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of y on x by Newton's method, with a slight pull towards 0."""
    scale = float(np.std(x)) or 1.0
    features = np.stack([np.ones(len(x)), x / scale], 1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ theta, -30, 30)))
        slope = features.T @ (weight * (y - p)) - 1e-2 * theta
        bend = (features * (weight * p * (1 - p))[:, None]).T @ features + 1e-2 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        theta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1] / scale)


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, fold: tuple[int, int] = FOLD, id_column: str = "doc_id", text_column: str = "text") -> QualityModel:
    rows, counts = sample(docs, labelled(docs, labels, "quality", fold), per_class, id_column=id_column, text_column=text_column)
    texts = {c: [t.encode() for _, label, t in rows if label == c] for c in (0, 1)}
    if min(map(len, texts.values())) < 2:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return QualityModel(None, None, math.log(share / (1 - share)), 0.0)
    # two thirds teach the dictionaries, the rest the calibration
    teach = {c: [t for k, t in enumerate(ts) if k % 3] for c, ts in texts.items()}
    rest = {c: [t for k, t in enumerate(ts) if not k % 3] for c, ts in texts.items()}
    scorer = Scorer(QualityModel(dictionary(teach[1]), dictionary(teach[0]), 0.0, 1.0))
    x = np.array([scorer.difference(t) for c in (0, 1) for t in rest[c]])
    y = np.array([float(c) for c in (0, 1) for _ in rest[c]])
    # labels weigh as they occur among all rows
    weight = np.array([counts[c] / len(rest[c]) for c in (0, 1) for _ in rest[c]])
    a, b = calibrate(x, y, weight * len(weight) / weight.sum())
    return QualityModel(scorer.model.good, scorer.model.bad, a, b)


def score(docs: DataFrame, model: QualityModel, *, text_column: str = "text", column: str = "score") -> DataFrame:
    """`docs` with a column `score`."""
    # a bounded object: two dictionaries
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        scorer = _scorer(shared)
        return pa.array([scorer.score(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts.cast(pa.large_binary())], pa.float64())

    return docs.withColumn(column, of(F.col(text_column)))


_scorers: dict = {}


def _scorer(shared) -> Scorer:
    """One scorer for each model and worker."""
    if shared not in _scorers:
        _scorers.clear()
        _scorers[shared] = Scorer(shared.value)
    return _scorers[shared]


def quality_report(docs: DataFrame, labels: DataFrame, *, fold: tuple[int, int] = FOLD, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(docs, labels, fold=fold, id_column=id_column, text_column=text_column, **options)
    scored = score(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")), model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), fold[0]) == fold[1]).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, with their columns."""
    column = free_name(docs, "_score")
    return score(docs, fit(docs, labels, id_column=id_column, text_column=text_column, **options), text_column=text_column, column=column).where(F.col(column) >= threshold).drop(column)
