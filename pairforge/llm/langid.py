"""Language of texts, and of each word in code-switched text, by a conditional random field.

The field's labels are the languages of labelled documents. It is trained on short passages of different languages set
one after another, so that it learns how seldom a language changes from word to word. A text's language is the one with
the largest sum of word marginals.

Fitting uses a bounded sample of rows (`per_class` documents of each language, whole texts); prediction reads whole texts.
Defined results: a null or empty text, a text without letters, and any text where nothing could be learned are `und` with
score 0; ties go to the language that sorts first; repeated rows are predicted each, a null id like any other; an empty
table gives no rows; a very long text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairforge.llm import crf
from pairforge.llm.common import importable
from pairforge.llm.kernel import slices
from pairforge.llm.training import remainder, sample

PER_CLASS = 100
#: Words of a training passage in one language.
PASSAGE = 12
FOLD = (4, 2)
UNKNOWN = "und"
HAS_ASCII_LETTER = np.zeros(256, bool)
HAS_ASCII_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def fit(docs: DataFrame, *, per_class: int = PER_CLASS, fold: tuple[int, int] = FOLD, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", rounds: int = 30, seed: int = 3) -> crf.Crf | None:
    """None where no document has a language."""
    known = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(lang_column).alias("label"))
    known = known.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), fold[0]) != fold[1]))
    rows, _ = sample(docs, known, per_class, id_column=id_column, text_column=text_column)
    passages = []
    for _, label, text in rows:
        parts = text.split()
        passages += [(label, " ".join(parts[k : k + PASSAGE])) for k in range(0, len(parts), PASSAGE)]
    if not passages:
        return None
    languages = sorted({p[0] for p in passages})
    order = np.random.default_rng(seed).permutation(len(passages))
    # six passages to a training text
    texts = [[passages[i] for i in order[k : k + 6]] for k in range(0, len(order), 6)]
    data, offsets = crf.joined([" ".join(p for _, p in t) for t in texts])
    gold = np.concatenate([np.full(len(_words(p)), languages.index(label)) for t in texts for label, p in t])
    return crf.train(crf.Crf.zero(languages), data, offsets, gold, rounds=rounds)


def _words(text: str) -> list[bytes]:
    return text.encode().translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ") if text else []


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    seen = np.concatenate([[0], np.cumsum(HAS_ASCII_LETTER[data])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for k in np.flatnonzero(~out):
        if offsets[k + 1] > offsets[k]:
            out[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode())
    return out


def predict(docs: DataFrame, model: crf.Crf | None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, and lang_words: how many words each language has by its marginals."""
    shared = importable(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for _, _, data, offsets in slices(batch.column(1)):
                out.append(_of(m, data, offsets))
            if out:
                langs, scores, shares = ([x for o in out for x in o[i]] for i in range(3))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "lang_words"])

    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double, lang_words map<string,double>")


def _of(model: crf.Crf | None, data: np.ndarray, offsets: np.ndarray) -> tuple[list, list, list]:
    n = len(offsets) - 1
    if model is None:
        return [UNKNOWN] * n, [0.0] * n, [[] for _ in range(n)]
    marginal, w = crf.predict(model, data, offsets)
    sums = np.concatenate([np.zeros((1, marginal.shape[1])), np.cumsum(marginal, 0)])
    of_text = sums[w.at[1:]] - sums[w.at[:-1]]
    best = of_text.argmax(1)
    share = np.clip(of_text[np.arange(n), best] / np.maximum(w.counts, 1), 0, 1)
    letters = _letters(data, offsets)
    langs = [model.labels[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
    return langs, np.where(letters, share, 0.0).tolist(), [list(zip(model.labels, row, strict=True)) if ok else [] for row, ok in zip(of_text.tolist(), letters, strict=True)]


def langid_report(docs: DataFrame, *, fold: tuple[int, int] = FOLD, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    found = predict(docs, fit(docs, fold=fold, **options))
    return found.select("doc_id", (remainder(F.col("doc_id"), fold[0]) == fold[1]).alias("held_out"), "lang_pred", "score")
