"""Scores of texts by a bigram language model with Katz backoff.

P(w | v) = d c(v w) / c(v) for every pair that occurs, single ones too, else alpha(v) P(w), where alpha(v) makes the sum
over all words exactly 1; P(w) = d c(w) / N for a known word, and what the discounts leave is the probability of an unknown
one. The discounts d are Good-Turing's, by Katz: small counts only, from counts of counts. A history all of whose
pairs are frequent would leave nothing; it counts one more, and that one goes to backoff.

Texts are first written as blocks: the block's word hashes and its documents as numbers into them. What travels from there
is each block's distinct words and pairs as sorted packed hashes with their counts, dealt to ranges of hashes. A range adds
up its counts and answers each block for what it asked; so a word is looked up once for a block, not for each time it
occurs, and a frequent word or pair is one entry of each block. Probabilities' tables grow with the corpus and are never
gathered in one place: only counts of counts reach the driver. A block sends a row to each range that it has entries for,
so there are never more rows than entries, however many blocks and ranges there are. A kept pair's terms of alpha(v) are added by one block, which
its range names, and alpha goes back to the blocks that have v.

Defined results: a null or blank text is its end token alone; a null id is in no held-out fold; without training documents
every token is unknown with probability 1 and all scores are 0; equal rows are scored each; a very long text is read
whole, in a block of its own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pairforge.llm.common import discard, importable, written
from pairforge.llm.kernel import U, mixed, slices, words
from pairforge.llm.packing import pack, unpack
from pairforge.llm.training import remainder

FOLD = (7, 2)
#: Pairs that occur less often are left to backoff: at 1, none of those that occur. Counts above TOP are not discounted.
CUTOFF, TOP = 1, 5
#: A history whose pairs leave less than this has nothing for backoff.
FULL = 1e-9
#: Tokens of a block, and entries of a range.
BLOCK, RANGE = 1 << 20, 3 << 19
BEGIN, END = (U(x) for x in mixed(np.array([0xB06, 0xE0D], U)))

BLOCK_SCHEMA = "block long, tokens long, ids binary, nulls binary, held binary, ends binary, types binary, stream binary"
BLOCK_TYPES = [pa.int64(), pa.int64(), *[pa.binary()] * 6]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as blocks. Types are numbered by falling frequency, so that most numbers are small."""
    number = 0
    ids: list = []
    held: list = []
    parts: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal ids, held, parts, lengths, size, number
        hashes = np.concatenate(parts)
        types, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
        rank = np.argsort(-count, kind="stable")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        # sorted hashes travel as differences; the rank of each goes along
        tokens = pack(place[which])
        row = (
            (TaskContext.get().partitionId() << 32) + number,
            len(hashes),
            np.array([i or 0 for i in ids], np.int64).tobytes(),
            np.array([i is None for i in ids], bool).tobytes(),
            np.array(held, bool).tobytes(),
            pack(np.concatenate(lengths)),
            pack(np.diff(types, prepend=U(0))),
            len(tokens).to_bytes(8, "little") + tokens + pack(place),
        )
        ids, held, parts, lengths, size = [], [], [], [], 0
        number += 1
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, BLOCK_TYPES, strict=True)], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

    for batch in batches:
        values, fold = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for first, last, data, offsets in slices(batch.column(2)):
            w = words(data, offsets, lower=True)
            # every text's words, then its end
            out = np.full(len(w.starts) + last - first, END)
            ends = w.at[1:] + np.arange(1, last - first + 1)
            inner = np.ones(len(out), bool)
            inner[ends - 1] = False
            out[inner] = w.hashes()
            parts.append(out)
            lengths.append(w.counts + 1)
            ids += values[first:last]
            held += fold[first:last]
            size += len(out)
            if size >= BLOCK:
                yield flush()
    if ids:
        yield flush()


@dataclass
class Block:
    """A block, and the pairs in it: (history, word), where the history of a text's first token is its beginning."""

    row: dict
    bits: int
    hashes: np.ndarray = field(init=False)  #: of the types, sorted
    token: np.ndarray = field(init=False)  #: each token's type, as its place among the sorted hashes
    starts: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        r = self.row
        self.hashes = np.cumsum(unpack(r["types"]), dtype=U)
        n = int.from_bytes(r["stream"][:8], "little")
        place = unpack(r["stream"][8 + n :]).astype(np.int64)
        by_rank = np.empty(len(place), np.int64)
        by_rank[place] = np.arange(len(place))
        self.token = by_rank[unpack(r["stream"][8 : 8 + n]).astype(np.int64)]
        lengths = unpack(r["ends"]).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.lengths = lengths
        self.held = np.frombuffer(r["held"], bool)
        self.trains = np.repeat(~self.held, lengths)

    def histories(self) -> np.ndarray:
        """Each token's history: a type, or -1 for the beginning."""
        out = np.empty(len(self.token), np.int64)
        out[1:] = self.token[:-1]
        out[self.starts] = -1
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct pairs' shortened hashes, one token of each, and each token's pair."""
        of_history = np.append(self.hashes, BEGIN)[self.histories()]
        h = mixed(of_history * U(0x9E3779B97F4A7C15) + mixed(self.hashes[self.token] + U(0x7F4A7C159E3779B9))) >> U(64 - self.bits)
        return np.unique(h, return_index=True, return_inverse=True)


REQUEST = "range int, block long, kind int, n long, hashes binary, counts binary"


def _requests(bits: int, ranges: int):
    def deal(block: int, kind: int, width: int, values: np.ndarray, counts: np.ndarray) -> list[tuple]:
        cuts = _cuts(values, width, ranges)
        return [(r, block, kind, b - a, pack(np.diff(values[a:b], prepend=U(0))), pack(counts[a:b])) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                b = Block(row, bits)
                words_seen = np.bincount(b.token[b.trains], minlength=len(b.hashes))
                # the beginning is asked for like a word: it occurs once in each text
                types, at = np.append(b.hashes, BEGIN), np.append(words_seen, int((~b.held).sum()))
                order = np.argsort(types, kind="stable")
                rows = deal(row["block"], 1, 64, types[order], at[order])
                pairs, _, which = b.pairs()
                rows += deal(row["block"], 2, bits, pairs, np.bincount(which[b.trains], minlength=len(pairs)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=[c.split()[0] for c in REQUEST.split(", ")])

    return run


def _cuts(values: np.ndarray, width: int, ranges: int) -> list[int]:
    borders = np.array([-(-(r << width) // ranges) for r in range(ranges)], dtype=object).astype(U)
    return [*np.searchsorted(values, borders).tolist(), len(values)]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


ANSWER = "block long, kind int, range int, counts binary, home binary, stats binary"


def _answer(table: pa.Table) -> pa.Table:
    """Adds up one range. To each block: the counts of what it asked for, and the kept pairs of which it is the first to ask."""
    out = []
    for kind in (1, 2):
        rows = sorted((r for r in table.to_pylist() if r["kind"] == kind), key=lambda r: r["block"])
        if not rows:
            continue
        values = np.concatenate([np.cumsum(unpack(r["hashes"]), dtype=U) for r in rows])
        counts = np.concatenate([unpack(r["counts"]).astype(np.int64) for r in rows])
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.cumsum(first) - 1
        total = np.bincount(group, counts[order]).astype(np.int64)
        back = np.empty(len(order), np.int64)
        back[order] = group
        each = total[back]
        if kind == 2:
            each = np.where(each >= CUTOFF, each, 0)
        home = np.zeros(len(order), bool)
        home[order[first]] = True
        # all counts up to TOP + 1, and the sums over words other than the beginning
        word = ranked[first] != BEGIN if kind == 1 else np.ones(len(total), bool)
        stats = np.concatenate([[total[word].sum(), (total[word] > 0).sum()], np.bincount(np.minimum(total[word], TOP + 2), minlength=TOP + 3)[1 : TOP + 2]]).astype(np.int64)
        at = 0
        for k, r in enumerate(rows):
            part = slice(at, at + r["n"])
            at += r["n"]
            out.append((r["block"], kind, r["range"], pack(each[part]), np.packbits(home[part]).tobytes() if kind == 2 else None, None if k else stats.tobytes()))
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in ANSWER.split(", ")])


@dataclass(frozen=True)
class Counts:
    """The corpus as numbers: tokens, types, and how many words (pairs) occur 1 to TOP + 1 times."""

    tokens: int
    types: int
    words: tuple[int, ...]
    pairs: tuple[int, ...]

    def word_probability(self, c: np.ndarray) -> np.ndarray:
        """P(w) for counts c; for 0, that of the unknown word."""
        if not self.tokens:
            return np.ones(len(c))
        d = discounts(self.words)
        small = np.arange(1, TOP + 1)
        left = float((np.array(self.words[:TOP]) * small * (1 - d[1 : TOP + 1])).sum() / self.tokens)
        unknown = max(left, 1 / (self.tokens + 1))
        known = c / self.tokens * d[np.minimum(c, TOP + 1)] * ((1 - unknown) / (1 - left))
        return np.where(c > 0, known, unknown)

    def pair_discount(self, c: np.ndarray) -> np.ndarray:
        return discounts(self.pairs, CUTOFF)[np.minimum(c, TOP + 1)]


def discounts(n: tuple[int, ...], least: int = 1) -> np.ndarray:
    """Katz's Good-Turing factors for counts 0 to TOP + 1 (1 from there on) from n[r - 1], the number of things that occur r
    times. Where the counts of counts are too few to give a factor between 0 and 1, (r - 1/2) / r."""
    out = np.ones(TOP + 2)
    out[0] = 0
    share = (TOP + 1) * n[TOP] / n[0] if n[0] else 1.0
    for r in range(1, TOP + 1):
        d = ((r + 1) * n[r] / n[r - 1] / r - share) / (1 - share) if n[r - 1] and share < 1 else -1.0
        out[r] = d if 0.05 < d < 1 else (r - 0.5) / r
        if r < least:
            out[r] = 0
    return out


def _gathered(b: Block, answers: list[dict], ranges: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's answers put in order: counts of its types, of the beginning, of its pairs, which pairs are its to add, and its pairs' tokens."""
    types = np.sort(np.append(b.hashes, BEGIN))
    pairs, one, which = b.pairs()
    found = {(a["kind"], a["range"]): a for a in answers if a["kind"] in (1, 2)}

    def put(kind: int, values: np.ndarray, width: int):
        counts, home = np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        cuts = _cuts(values, width, ranges)
        for r, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if z > a:
                x = found[kind, r]
                counts[a:z] = unpack(x["counts"]).astype(np.int64)
                if kind == 2:
                    home[a:z] = np.unpackbits(np.frombuffer(x["home"], np.uint8), count=z - a).astype(bool)
        return counts, home

    of_types, _ = put(1, types, 64)
    of_pairs, home = put(2, pairs, b.bits)
    begin = int(of_types[np.searchsorted(types, BEGIN)])
    return of_types[types != BEGIN], begin, of_pairs, home, one, which


TERM = "word long, kept double, covered double, count long, block long, part int, hashes binary"


def _terms(counts: Counts, bits: int, ranges: int):
    """Each block's part of the sums for alpha, by history; and, in rows without sums, the histories whose alpha it needs."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = list(_rows(left.combine_chunks().to_batches()[0]))
        b = Block(row, bits)
        of_types, begin, of_pairs, home, one, _ = _gathered(b, right.to_pylist(), ranges)
        use = np.flatnonzero((of_pairs > 0) & home)
        history = b.histories()[one[use]]
        of_history = np.append(of_types, begin)[history]
        words_, at = np.unique(np.append(b.hashes, BEGIN)[history], return_inverse=True)
        seen = np.zeros(len(words_), np.int64)
        seen[at] = of_history
        kept = counts.pair_discount(of_pairs[use]) * of_pairs[use] / np.maximum(of_history, 1)
        covered = counts.word_probability(of_types[b.token[one[use]]])
        n, needs = len(words_), [(r, pack(np.diff(v, prepend=U(0)))) for r, v, _ in _needs(b, of_types, ranges)]
        sums = (words_.view(np.int64), np.bincount(at, kept, n), np.bincount(at, covered, n), seen)
        asks = ([row["block"]] * len(needs), [r for r, _ in needs], [h for _, h in needs])
        of_sums = [pa.concat_arrays([pa.array(c.astype(t.to_pandas_dtype()), t), pa.nulls(len(needs), t)]) for c, t in zip(sums, (pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)]
        of_asks = [pa.concat_arrays([pa.nulls(n, t), pa.array(c, t)]) for c, t in zip(asks, (pa.int64(), pa.int32(), pa.binary()), strict=True)]
        return pa.table(of_sums + of_asks, names=[c.split()[0] for c in TERM.split(", ")])

    return run


def _needs(b: Block, of_types: np.ndarray, parts: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(part, hashes, places) of a block's histories that may have a kept pair somewhere, sorted; the last place is the beginning's."""
    place = np.append(np.flatnonzero((of_types >= CUTOFF) & (b.hashes != END)), len(b.hashes))
    hashes = np.append(b.hashes, BEGIN)[place]
    order = np.argsort(hashes, kind="stable")
    hashes, place = hashes[order], place[order]
    part = hashes.view(np.int64) % parts
    return [(r, hashes[part == r], place[part == r]) for r in np.unique(part).tolist()]


def _tell(key: tuple, needs: pa.Table, alphas: pa.Table) -> pa.Table:
    """Answers of one part of the histories: to each block, which of those that it asked for have an alpha, its logarithm, and whether the history is full."""
    word = alphas["word"].to_numpy().view(U)
    order = np.argsort(word)
    word = word[order]
    log, full = np.log10(alphas["alpha"].to_numpy())[order], alphas["full"].to_numpy(zero_copy_only=False).astype(bool)[order]
    out = []
    for r in needs.to_pylist():
        asked = np.cumsum(unpack(r["hashes"]), dtype=U)
        at = np.minimum(np.searchsorted(word, asked), max(len(word) - 1, 0))
        has = word[at] == asked if len(word) else np.zeros(len(asked), bool)
        out.append((r["block"], 3, r["part"], log[at[has]].tobytes(), np.packbits(has).tobytes(), np.packbits(full[at[has]]).tobytes()))
    columns = list(zip(*out, strict=True)) or [[]] * 6
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in ANSWER.split(", ")])


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(counts: Counts, bits: int, ranges: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = list(_rows(left.combine_chunks().to_batches()[0]))
        b = Block(row, bits)
        answers = right.to_pylist()
        of_types, begin, of_pairs, _, _, which = _gathered(b, answers, ranges)
        told = {a["range"]: a for a in answers if a["kind"] == 3}
        log_alpha = np.zeros(len(b.hashes) + 1)
        one_more = np.zeros(len(log_alpha), np.int64)
        for r, v, place in _needs(b, of_types, ranges):
            if r in told:
                has = np.unpackbits(np.frombuffer(told[r]["home"], np.uint8), count=len(v)).astype(bool)
                log_alpha[place[has]] = np.frombuffer(told[r]["counts"], np.float64)
                one_more[place[has]] = np.unpackbits(np.frombuffer(told[r]["stats"], np.uint8), count=int(has.sum()))
        history = b.histories()
        c = of_types[b.token]
        pair = of_pairs[which]
        of_history = np.append(of_types, begin)[history]
        back = log_alpha[history] + np.log10(counts.word_probability(c))
        with np.errstate(divide="ignore"):
            direct = np.log10(counts.pair_discount(pair) * pair / np.maximum(of_history + one_more[history], 1))
        score = np.where(pair > 0, direct, back)
        base = np.log10((c + 1) / (counts.tokens + counts.types + 1))
        total = lambda v: np.add.reduceat(v, b.starts)
        ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["nulls"], bool))
        return pa.table({"doc_id": ids, "held_out": pa.array(b.held), "n_tokens": b.lengths, "n_known": total((c > 0).astype(np.int64)), "base_score": total(base), "score": total(score)})

    return run


def lm_scores(docs: DataFrame, *, fold: tuple[int, int] = FOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; documents outside the fold are learned from."""
    importable(docs.sparkSession)
    id_ = F.col(id_column).cast("long")
    slim = docs.select(id_.alias("doc_id"), (remainder(id_, fold[0]) == fold[1]).alias("held"), F.col(text_column).cast("string").alias("text"))
    blocks = written(slim.mapInArrow(_blocks, BLOCK_SCHEMA))
    total = blocks.agg(F.sum("tokens")).first()[0] or 0
    # room for the square of the number of pairs, so that two of them hardly ever meet; one range for so many entries
    bits, ranges = min(64, max(32, 2 * int(total).bit_length() + 2)), max(1, -(-int(total) // RANGE))
    answers = written(blocks.mapInArrow(_requests(bits, ranges), REQUEST).groupBy("range").applyInArrow(_answer, ANSWER))
    sums: dict[int, np.ndarray] = {}
    for r in answers.where("stats IS NOT NULL").select("kind", "stats").collect():  # a few numbers for each range
        sums[r.kind] = sums.get(r.kind, np.zeros(TOP + 3, np.int64)) + np.frombuffer(bytes(r.stats), np.int64)
    one, two = (sums.get(k, np.zeros(TOP + 3, np.int64)) for k in (1, 2))
    counts = Counts(int(one[0]), int(one[1]), tuple(map(int, one[2:])), tuple(map(int, two[2:])))
    replies = answers.withColumn("stats", F.lit(None).cast("binary"))
    terms = written(blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_terms(counts, bits, ranges), TERM))
    mass = terms.where("block IS NULL").groupBy("word").agg(F.sum("kept").alias("kept"), F.sum("covered").alias("covered"), F.max("count").alias("count"))
    # where the pairs use up everything, the history counts one more, and that one is left to backoff
    full = F.col("kept") > 1 - FULL
    alpha = mass.select(F.pmod("word", F.lit(ranges)).cast("int").alias("part"), "word", (F.when(full, 1 / (F.col("count") + 1)).otherwise(1 - F.col("kept")) / (1 - F.col("covered"))).alias("alpha"), full.alias("full"))
    needs = terms.where("block IS NOT NULL").select("part", "block", "hashes")
    # written, so that the sums and their shuffles are gone before the blocks travel again
    told = written(needs.groupBy("part").cogroup(alpha.groupBy("part")).applyInArrow(_tell, ANSWER))
    discard(terms)
    scored = blocks.groupBy("block").cogroup(replies.unionByName(told).groupBy("block")).applyInArrow(_scores(counts, bits, ranges), RESULT)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")
