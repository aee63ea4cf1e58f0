"""Repeated passages, by parsing documents against earlier ones.

A word is removed if it lies in a window of 50 words whose words also begin somewhere in a document with a smaller id.

Documents are parsed greedily, in the manner of a relative Lempel-Ziv factorisation. The reference is all documents, cut
into blocks at anchors: runs of `ANCHOR` words whose hash is the least among those around it, so that every window holds
an anchor and equal text is cut alike wherever it stands. The index has, for each anchor's hash, its occurrence in the
smallest document, with the hash of the block from there to the next anchor. A document is read from anchor to anchor: as
long as its blocks equal the indexed ones, in one earlier document and in step, a factor grows. A factor of 50 words or
more is a duplicate span. Windows that hold an anchor shared with another document but lie in no such factor, which are
those at factors' boundaries, are checked one by one: their hashes are gathered from all documents, and a window is a
duplicate if the smallest document that has it comes earlier.

Only anchors, the words around shared ones, and texts of documents with shared anchors travel. Documents of equal text
are settled first, by the text's hash: the copies are duplicates throughout, and only the first is parsed.

Defined results: a null or empty text has no words; a null id comes after all ids, nothing is removed from it and it removes
nothing; equal rows are reported each; a very long text is read whole; an empty table gives no rows. Ids are to be unique
among different texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pairforge.llm.common import discard, importable, written
from pairforge.llm.kernel import U, Words, run_hashes, slices, words

SPAN = 50
ANCHOR = 12
GRAM_BASE, LINK_BASE, WINDOW_BASE = 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Ids that may be broadcast.
FEW = 2_000_000


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of `width` values."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def anchors(hashes: np.ndarray, span: int, anchor: int) -> np.ndarray:
    """First words of a text's anchors: in each window of `span` words the run of `anchor` words with the least hash, the last of equals."""
    runs = len(hashes) - anchor + 1
    per = span - anchor + 1
    if len(hashes) < span:
        return np.zeros(0, np.int64)
    starts = np.arange(runs)
    grams = run_hashes(hashes, starts, starts + anchor, GRAM_BASE)
    least = _least_of(grams, per)

    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    # for each window: among runs of that value, the last one inside the window
    lo = np.searchsorted(ranked, least, "left")
    hi = np.searchsorted(ranked, least, "right")
    one = hi - lo == 1
    out = np.zeros(runs, bool)
    out[order[lo[one]]] = True
    for k in np.flatnonzero(~one):
        inside = order[lo[k] : hi[k]]
        out[inside[np.searchsorted(inside, k + per) - 1]] = True
    return np.flatnonzero(out)


def _texts(w: Words, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, int, int]]:
    for k, (a, b) in enumerate(zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True)):
        yield k, h[a:b], a, b


def _joined_words(w: Words, a: int, b: int, keep: np.ndarray | None = None) -> bytes:
    """The words a to b of a batch, or those kept, joined by one blank."""
    starts, ends = w.starts[a:b], w.ends[a:b]
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return b""
    length = ends - starts + 1
    out = np.full(int(length.sum()) - 1, 0x20, np.uint8)
    at = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.repeat(starts - at, length - 1)
    target = np.repeat(at - np.concatenate([[0], np.cumsum(length - 1)[:-1]]), length - 1) + np.arange(int((length - 1).sum()))
    out[target] = w.data[place + target]
    return out.tobytes()


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's number of words, its joined words' sha256, and its text's identity (by words)."""
    for batch in batches:
        ids, counts, shas = [], [], []
        values = batch.column(0).to_pylist()
        for first, _, data, offsets in slices(batch.column(1)):
            w = words(data, offsets)
            for k, (a, b) in enumerate(zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True)):
                ids.append(values[first + k])
                counts.append(b - a)
                shas.append(hashlib.sha256(_joined_words(w, a, b)).digest())
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.binary())], names=["doc_id", "n_words", "sha"])


def _anchored(span: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[], [], [], []]
            values = batch.column(0).to_pylist()
            for first, _, data, offsets in slices(batch.column(1)):
                w = words(data, offsets)
                h = w.hashes()
                for k, own, _, _ in _texts(w, h):
                    at = anchors(own, span, anchor)
                    if len(at) and values[first + k] is not None:
                        parts[0].append(run_hashes(own, at, at + anchor, GRAM_BASE))
                        parts[1].append(np.full(len(at), values[first + k], np.int64))
                        parts[2].append(at)
                        # the block from this anchor to the end of the next one
                        parts[3].append(np.append(run_hashes(own, at[:-1], at[1:] + anchor, LINK_BASE), U(0)))
            if parts[0]:
                a, d, p, n = map(np.concatenate, parts)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(d), pa.array(p.astype(np.int32)), pa.array(n.view(np.int64))], names=["anchor", "doc_id", "pos", "link"])

    return run


def factors(at: list[dict], anchor: int) -> list[tuple[int, int]]:
    """Factors (first word, end) of a document from its shared anchors in order: greedy runs of blocks equal to one earlier document's, in step."""
    out, k = [], 0
    while k < len(at):
        x = at[k]
        if not x["earlier"]:
            k += 1
            continue
        start, end = x["pos"], x["pos"] + anchor
        # the block to the next anchor is equal, so the next anchor stands at the same distance in both
        while x["same_link"] and k + 1 < len(at) and x["next"] == at[k + 1]["pos"]:
            y = at[k + 1]
            end = y["pos"] + anchor
            k += 1
            if not (y["earlier"] and y["ref_doc"] == x["ref_doc"] and y["ref_pos"] - x["ref_pos"] == y["pos"] - x["pos"]):
                break
            x = y
        else:
            k += 1
        out.append((start, end))
    return out


def _open_windows(span: int, anchor: int):
    """From documents with their shared anchors: windows that hold one but lie in no long factor, and the long factors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, shared = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out: list[list[np.ndarray]] = [[], [], [], []]
            for first, _, data, offsets in slices(batch.column(1)):
                w = words(data, offsets)
                h = w.hashes()
                for k, own, _, _ in _texts(w, h):
                    rows = sorted(shared[first + k], key=lambda r: r["pos"])
                    at = anchors(own, span, anchor)
                    following = dict(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                    for r in rows:
                        r["next"] = following.get(r["pos"])
                    n = len(own) - span + 1
                    held = np.zeros(n + 1, np.int64)
                    for r in rows:  # the windows that hold the whole anchor
                        held[max(0, r["pos"] + anchor - span)] += 1
                        held[min(n, r["pos"] + 1)] -= 1
                    todo = np.cumsum(held[:-1]) > 0
                    long = [(a, b) for a, b in factors(rows, anchor) if b - a >= span]
                    for a, b in long:
                        todo[a : b - span + 1] = False
                    starts = np.flatnonzero(todo)
                    doc = values[first + k]
                    out[0].append(run_hashes(own, starts, starts + span, WINDOW_BASE))
                    out[1].append(np.full(len(starts) + len(long), doc, np.int64))
                    out[2].append(np.concatenate([starts, np.array([a for a, _ in long], np.int64)]))
                    out[3].append(np.concatenate([np.zeros(len(starts), np.int64), np.array([b for _, b in long], np.int64)]))
                    out[0].append(np.zeros(len(long), U))
            if out[0]:
                hs, ds, ps, es = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([pa.array(hs.view(np.int64)), pa.array(ds), pa.array(ps.astype(np.int32)), pa.array(es.astype(np.int32))], names=["window", "doc_id", "pos", "factor_end"])

    return run


def _cut(span: int):
    """Documents with their duplicate spans: how many words go, and the rest's sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, spans = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows = []
            for first, _, data, offsets in slices(batch.column(1)):
                w = words(data, offsets)
                for k, (a, b) in enumerate(zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True)):
                    cover = np.zeros(b - a + 1, np.int64)
                    for s in spans[first + k]:
                        cover[min(s["pos"], b - a)] += 1
                        cover[min(s["end"], b - a)] -= 1
                    keep = np.cumsum(cover[:-1]) == 0
                    left = _joined_words(w, a, b, keep)
                    rows.append((values[first + k], int((~keep).sum()), hashlib.sha256(left).hexdigest(), left.decode()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_removed", "kept_sha256", "kept"])

    return run


def duplicate_spans(docs: DataFrame, profiles: DataFrame, *, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, spans: array of (pos, end) in words) of first documents of each text that have any. docs: (doc_id, text); profiles: (doc_id, n_words, sha)."""
    firsts = written(profiles.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= span)).groupBy("sha").agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
    parsed = docs.join(F.broadcast(firsts) if firsts.count() <= FEW else firsts, "doc_id", "left_semi")
    found = written(parsed.mapInArrow(_anchored(span, anchor), "anchor long, doc_id long, pos int, link long"))
    # written, so that the join below may split an anchor that very many documents have
    index = written(found.groupBy("anchor").agg(F.min(F.struct("doc_id", "pos", "link")).alias("ref"), F.max("doc_id").alias("last")).where("ref.doc_id < last").select("anchor", "ref"))
    shared = found.join(index, "anchor").select(
        "doc_id",
        F.struct(
            "pos", (F.col("ref.doc_id") < F.col("doc_id")).alias("earlier"), F.col("ref.doc_id").alias("ref_doc"), F.col("ref.pos").alias("ref_pos"), ((F.col("link") == F.col("ref.link")) & (F.col("link") != 0)).alias("same_link")
        ).alias("at"),
    )
    # a document's anchors are fewer than its words
    by_doc = written(shared.groupBy("doc_id").agg(F.collect_set("at").alias("shared")))
    few = by_doc.count() <= FEW // 8
    texts = docs.join(by_doc.select("doc_id").distinct() if not few else F.broadcast(by_doc.select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    opened = written(texts.join(by_doc, "doc_id").select("doc_id", "text", "shared").mapInArrow(_open_windows(span, anchor), "window long, doc_id long, pos int, factor_end int"))
    windows = opened.where("factor_end = 0")
    # written, so that the join below may split a window that very many documents have
    first = written(windows.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("window", "first"))
    late = windows.join(first, "window").where("first < doc_id").select("doc_id", "pos", (F.col("pos") + span).alias("end"))
    spans = late.unionByName(opened.where("factor_end > 0").select("doc_id", "pos", F.col("factor_end").alias("end")))
    # overlapping spans as one, so that what a document collects is short
    order = Window.partitionBy("doc_id").orderBy("pos", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.when(reach >= F.col("pos"), 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("doc_id", "run").agg(F.min("pos").alias("pos"), F.max("end").alias("end"))
    out = written(merged.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "end")).alias("spans")))
    discard(firsts, found, index, by_doc, opened, first)
    return out


def remove_repeats(docs: DataFrame, *, span: int = SPAN, anchor: int = ANCHOR, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the text left, null where nothing went) of every row."""
    importable(docs.sparkSession)
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    profiles = written(slim.mapInArrow(_profile, "doc_id long, n_words long, sha binary"))
    spans = duplicate_spans(slim, profiles, span=span, anchor=anchor)
    few = spans.count() <= FEW // 8
    hit = slim.join(F.broadcast(spans.select("doc_id")) if few else spans.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    cut = hit.join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(_cut(span), "doc_id long, n_removed long, kept_sha256 string, kept string")
    first = profiles.where(F.col("doc_id").isNotNull()).groupBy("sha").agg(F.min("doc_id").alias("first"))
    named = profiles.join(first, "sha", "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= span)
    return named.join(cut, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
