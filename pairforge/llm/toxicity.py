"""Toxic spans by a conditional random field, and documents' scores from its marginals.

Labels are given for documents; the training words' labels come from them: a word of a toxic document is taken as toxic
if it, or a beginning of it, occurs in toxic documents well beyond chance and hardly in others. The field learns those words' affixes, n-grams, and how
toxic words follow one another, and gives every word of a text a marginal. A document's score is a calibrated function
of the expected number of toxic words and of the largest marginal; runs of words above a marginal are its spans.

Fitting uses bounded samples of rows, whole texts: `per_class` documents of each label tell which words are toxic and
calibrate, and all words of the first `taught` of each train the field. Scoring reads whole texts, very long ones too.
Defined results: null and empty texts have no toxic words and get the calibrated score of none; where there are no labels
of both kinds, or no word sets them apart, the score is the smoothed share of label 1; repeated rows are scored each; a
score equal to the threshold is toxic; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairforge.llm import crf
from pairforge.llm.common import importable
from pairforge.llm.kernel import slices, words
from pairforge.llm.training import labelled, remainder, sample

PER_CLASS, TAUGHT = 1200, 300
FOLD = (4, 2)
THRESHOLD = 0.3
#: A toxic stem: in at least so many of the sample's toxic documents, at such a share of all documents that have it (were
#: both kinds as frequent), and so many letters long unless it is a whole word.
LEAST_DOCS, PRECISION, STEM = 4, 0.9, 5
SPAN_AT = 0.5
#: How strongly weights are pulled towards 0, against the training words' likelihood.
PULL = 5.0
#: Marginals below this add nothing to a document, however long.
COUNT_AT = 0.2


@dataclass
class ToxicityModel:
    field: crf.Crf | None
    #: logistic(a + b * largest marginal + c * log(1 + expected toxic words))
    a: float
    b: float
    c: float

    def score(self, largest: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a + self.b * largest + self.c * np.log1p(expected), -30, 30)))


def toxic_stems(rows: list[tuple[int, object, str]]) -> set[str]:
    """Beginnings of words, and whole words, that mark toxic documents well beyond chance."""
    total = Counter(label for _, label, _ in rows)
    words_of = [({_bare(x) for x in text.split()}, label) for _, label, text in rows]
    toxic = Counter(stem for found, label in words_of if label for stem in {s for w in found for s in _stems(w)})
    toxic = {s: n for s, n in toxic.items() if n >= LEAST_DOCS}
    other = Counter(stem for found, label in words_of if not label for stem in {s for w in found for s in _stems(w) if s in toxic})
    chance = total[1] / (total[0] + total[1])
    needed = math.log(max(len(toxic), 1)) + 2
    out = set()
    for stem, n in toxic.items():
        m = other[stem]
        rate, rest = n / total[1], m / total[0]
        gain = n * math.log(n / ((n + m) * chance)) + (m * math.log(m / ((n + m) * (1 - chance))) if m else 0.0)
        if rate >= PRECISION * (rate + rest) and gain >= needed:
            out.add(stem)
    return out


def _stems(word: str) -> list[str]:
    """The word, and its beginnings of at least STEM letters."""
    return [word[:k] for k in range(STEM, min(len(word), STEM + 6))] + [word + "$"] if word else []


def _is_toxic(word: str, stems: set[str]) -> bool:
    return any(s in stems for s in _stems(_bare(word)))


def _bare(word: str) -> str:
    """Lower-cased, without the punctuation around it."""
    return word.strip(".,;:!?\"'()[]*&%$#|-").lower()


def marks(model: crf.Crf, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, object]:
    """Largest marginal and expected number of toxic words of each text; the words' marginals; the words."""
    marginal, w = crf.predict(model, data, offsets)
    p = marginal[:, 1]
    n = len(offsets) - 1
    largest = np.zeros(n)
    some = w.counts > 0
    if some.any():
        largest[some] = np.maximum.reduceat(p, w.at[:-1][some])
    total = np.concatenate([[0.0], np.cumsum(np.where(p > COUNT_AT, p, 0.0))])
    return largest, total[w.at[1:]] - total[w.at[:-1]], p, w


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, taught: int = TAUGHT, fold: tuple[int, int] = FOLD, id_column: str = "doc_id", text_column: str = "text", rounds: int = 30) -> ToxicityModel:
    return fit_rows(*sample(docs, labelled(docs, labels, "toxic", fold), per_class, id_column=id_column, text_column=text_column), taught, rounds)


def fit_rows(rows: list[tuple[int, object, str]], counts: dict, taught: int = TAUGHT, rounds: int = 30, pull: float = PULL) -> ToxicityModel:
    """The model from (id, label, text) and the number of all rows of each label."""
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    prior = ToxicityModel(None, math.log(share / (1 - share)), 0.0, 0.0)
    bad = toxic_stems(rows) if len({label for _, label, _ in rows}) == 2 else set()
    if not bad:
        return prior
    texts, gold = [], []
    for wanted in (0, 1):
        for text in [t for _, label, t in rows if label == wanted][:taught]:
            parts = text.split()
            texts.append(" ".join(parts))
            gold += [int(wanted == 1 and _is_toxic(x, bad)) for x in parts]
    data, offsets = crf.joined(texts)
    # str.split also parts at blanks beyond the six, so the words are counted again
    if len(words(data, offsets).starts) != len(gold):
        raise AssertionError("training words and labels differ in number")
    field = crf.train(crf.Crf.zero([0, 1]), data, offsets, np.array(gold), rounds=rounds, pull=pull / len(gold))
    data, offsets = crf.joined([t for _, _, t in rows])
    largest, expected, _, _ = marks(field, data, offsets)
    y = np.array([float(label) for _, label, _ in rows])
    used = Counter(label for _, label, _ in rows)
    weight = np.array([counts[label] / used[label] for _, label, _ in rows])
    x = np.stack([np.ones(len(y)), largest, np.log1p(expected)], 1)
    theta = np.zeros(3)
    weight *= len(weight) / weight.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 0.05 * theta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        theta += np.linalg.solve(bend, slope)
    return ToxicityModel(field, *map(float, theta))


def tag(docs: DataFrame, model: ToxicityModel, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score, and spans: (start, end, marginal) of runs of toxic words, as offsets in characters."""
    shared = importable(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, spans = [], []
            for _, _, data, offsets in slices(batch.column(1)):
                n = len(offsets) - 1
                if m.field is None:
                    scores += m.score(np.zeros(n), np.zeros(n)).tolist()
                    spans += [[] for _ in range(n)]
                    continue
                largest, expected, p, w = marks(m.field, data, offsets)
                scores += m.score(largest, expected).tolist()
                spans += _spans(p, w, data, offsets)
            if scores:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "score", "spans"])

    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int,marginal:double>>")


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])


def _spans(p: np.ndarray, w, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    hot = np.flatnonzero(p >= SPAN_AT)
    if not len(hot):
        return out
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text = np.searchsorted(w.at, hot, "right") - 1
    for i, t in zip(hot.tolist(), text.tolist(), strict=True):
        start, end = int(characters[w.starts[i]] - characters[offsets[t]]), int(characters[w.ends[i]] - characters[offsets[t]])
        if out[t] and i > w.at[t] and p[i - 1] >= SPAN_AT:
            out[t][-1] = {"start": out[t][-1]["start"], "end": end, "marginal": max(out[t][-1]["marginal"], float(p[i]))}
        else:
            out[t].append({"start": start, "end": end, "marginal": float(p[i])})
    return out


def toxicity_report(docs: DataFrame, labels: DataFrame, *, fold: tuple[int, int] = FOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (start, end, marginal; offsets in characters) of every row."""
    found = tag(docs, fit(docs, labels, fold=fold, **options), **{k: v for k, v in options.items() if k in ("id_column", "text_column")})
    return found.select("doc_id", (remainder(F.col("doc_id"), fold[0]) == fold[1]).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
