"""Benchmark leaks, also with other numbers, names or units, by template windows.

Texts become templates: a number becomes a placeholder, so does a unit after a number and a name (a capitalised word);
other words are lower-cased without the punctuation around them, and words of punctuation alone go. Consecutive numbers
without punctuation between are one placeholder, and so are such names. A capitalised word that begins a sentence is a plain
word in one reading of a text and a name in another, and readings are matched like with like, so that an item is found
whatever precedes it. Windows more than half of which are placeholders are matched by their words as they are.

Windows of template words are hashed, and the windows of the documents are joined by hash with those of the benchmark items.
Matches of a document and an item are runs along diagonals; runs that follow each other in both, on nearby diagonals, are
a chain and cover a part of the item. The document leaks the item if the part is large enough and the slots agree: one value
of the item must always stand for one value of the document, and different values for different ones.

The benchmark is the hash table's side and is taken in blocks of bounded size, each against all documents.

Defined results: null and empty texts match nothing; items with fewer template words than a window are matched as a whole
if they have at least `MIN_WORDS` words, and otherwise never; where most words are slots, only equal values match; repeated rows of documents
are reported each; an item id that repeats with different texts is reported once for each text, with a null id kept as null; a very long text
is read whole; empty tables give no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairforge.llm.common import bounded, free_name, small_batches, written
from pairforge.llm.kernel import U, mixed, run_hashes, slices, words

#: Template words of a window; the least of an item that can be matched; how much of an item must be covered.
WINDOW = 8
MIN_WORDS = 4
COVERAGE = 0.5
#: Bounds of a block of the benchmark.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32 << 20
FILTER_BITS = 20
#: Bytes of texts that are read at once, and words whose kinds a worker remembers.
TEXT_BYTES, KINDS = 1 << 18, 1 << 14
#: Readings of a text: a capitalised word that begins a sentence as a plain word, and as a name; and all words as they are.
READINGS = 3

#: Units of measurement that may follow a number.
UNITS = frozenset(
    "kg g mg t km m cm mm mi ft yd lb lbs oz l ml cl h hr hrs min s sec ms kwh w kw v hz khz mhz ghz kb mb gb tb % usd eur gbp $ € £ "
    "gram grams kilogram kilograms kilo kilos ton tons tonnes meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters "
    "mile miles foot feet inch inches yard yards pound pounds ounce ounces liter liters litre litres gallon gallons cup cups "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees".split()
)
EDGE = ".,;:!?\"'`()[]{}<>*&%$#|_/\\=+~^-–—“”‘’«»¿¡…"
UNIT_BYTES = frozenset(u.encode() for u in UNITS)
NUMBER, UNIT, NAME = (int(x) for x in mixed(np.array([1, 2, 3], U)))


@dataclass
class Template:
    """Template words of consecutive texts in one reading. Consecutive numbers without punctuation between are one template word, and so are such names."""

    code: np.ndarray  #: hash of the template word
    raw: np.ndarray  #: hash of what stands there, for slots
    slot: np.ndarray
    at: np.ndarray  #: first template word of each text
    first: np.ndarray  #: first word of each template word, and the number of words at the end
    words_at: np.ndarray  #: first word of each text
    exact: bool = False  #: whether the code is that of the words themselves


@functools.lru_cache(KINDS)
def _kind(raw: bytes) -> tuple[bytes, bool, bool, bool, bool, bool]:
    """(lower-cased bare word, is a number, may be a unit, is capitalised, ends a sentence, ends in punctuation)."""
    if raw.isalpha() and raw.islower():  # most words: ASCII letters only
        return raw, False, raw in UNIT_BYTES, False, False, False
    word = raw.decode(errors="replace")
    bare = word.strip(EDGE)
    low = bare.lower()
    number = bool(bare) and bare[0].isdigit() and all(c.isdigit() or c in ".,:/-^" for c in bare)
    capital = len(bare) > 1 and bare[0].isupper() and not bare.isupper()
    return low.encode(), number, low in UNITS or word in UNITS, capital, word[-1:] in ".!?:" or word[-2:-1] in ".!?", word[-1:] in EDGE


def _reading(code: np.ndarray, raw: np.ndarray, slot: np.ndarray, at: np.ndarray, apart: np.ndarray) -> Template:
    joins = np.zeros(len(code), bool)
    joins[1:] = slot[1:] & slot[:-1] & (code[1:] == code[:-1]) & ~apart[1:]
    joins[at[:-1][np.diff(at) > 0]] = False
    first = np.append(np.flatnonzero(~joins), len(code))
    value = raw[first[:-1]]
    long = np.flatnonzero(np.diff(first) > 1)
    if len(long):
        value[long] = run_hashes(raw, first[long], first[long + 1])
    return Template(code[first[:-1]], value, slot[first[:-1]], np.searchsorted(first, at), first, at)


def template(data: np.ndarray, offsets: np.ndarray) -> list[Template]:
    """The texts' readings."""
    w = words(data, offsets)
    if not len(w.starts):
        return [Template(*[np.zeros(0, U)] * 2, np.zeros(0, bool), w.at, np.zeros(1, np.int64), w.at)] * READINGS
    distinct, one, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
    raw = data.tobytes()
    kinds = [_kind(raw[a:b]) for a, b in zip(w.starts[one].tolist(), w.ends[one].tolist(), strict=True)]
    low = [k[0] for k in kinds]
    length = np.array([len(x) for x in low])
    ends = np.cumsum(length)
    line = np.frombuffer(b"".join(low) or b" ", np.uint8).astype(U) + U(1)
    bare = run_hashes(line, ends - length, ends)
    number, unit, capital, stop, closed = (np.fromiter((k[i] for k in kinds), bool, len(kinds))[which] for i in range(1, 6))
    # a line break also ends a sentence; it stands between the words
    begins = np.ones(len(which), bool)
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
    begins[1:] = stop[:-1] | (breaks[w.starts[1:]] > breaks[w.ends[:-1]])
    begins[w.at[:-1][w.counts > 0]] = True
    after_number = np.zeros(len(which), bool)
    after_number[1:] = number[:-1]
    after_number[w.at[:-1][w.counts > 0]] = False
    bare = bare[which]
    measure = unit & after_number
    keep = (length[which] > 0) | measure
    at = np.concatenate([[0], np.cumsum(keep)])[w.at]
    raw_words = bare[keep]
    # a placeholder is not joined to one before punctuation; words of punctuation alone count too
    apart = np.ones(len(keep), bool)
    apart[1:] = closed[:-1]
    apart = apart[keep]
    out = []
    for name in (capital & ~begins, capital):
        code, slot = bare.copy(), (name | measure | number)[keep]
        code[name] = NAME
        code[measure] = UNIT
        code[number] = NUMBER
        out.append(_reading(code[keep], raw_words, slot, at, apart))
    # the words as they are, of which only windows crowded with slots are used: what the last reading leaves out
    out.append(Template(raw_words, raw_words, slot, at, np.arange(len(slot) + 1), at, True))
    return out


def windows(t: Template, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first words) of windows of `width` template words, at least half of which are no slots; of words as they are, of all other windows."""
    n = len(t.code)
    if n < width:
        return np.zeros(0, U), np.zeros(0, np.int64)
    starts = np.arange(n - width + 1)
    text_end = np.repeat(t.at[1:], np.diff(t.at))
    slots = np.concatenate([[0], np.cumsum(t.slot)])
    starts = starts[(starts + width <= text_end[starts]) & ((2 * (slots[starts + width] - slots[starts]) > width) == t.exact)]
    return run_hashes(t.code, starts, starts + width, 0xA0761D6478BD642F), starts


@dataclass
class Index:
    """Windows of a block of items, for each reading by width: sorted hashes with the first template word of each."""

    ids: list
    items: list[Template]
    tables: list[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]


def index(items: list[tuple[int | None, str | None]]) -> Index:
    raw = [(t or "").encode() for _, t in items]
    readings = template(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    tables = []
    for t in readings:
        # an item of enough words may have fewer template words
        sizes = np.where(np.diff(t.words_at) >= MIN_WORDS, np.diff(t.at), 0)
        tables.append({})
        for width in sorted({min(WINDOW, int(s)) for s in sizes if s}):
            hashes, starts = windows(t, width)
            item = np.searchsorted(t.at, starts, "right") - 1
            use = (sizes[item] >= WINDOW) if width == WINDOW else (sizes[item] == width)
            order = np.argsort(hashes[use], kind="stable")
            h = hashes[use][order]
            sieve = np.zeros(1 << FILTER_BITS, bool)
            sieve[(h >> U(64 - FILTER_BITS)).astype(np.int64)] = True
            if len(h):
                tables[-1][width] = (h, starts[use][order], sieve)
    return Index([i for i, _ in items], readings, tables)


#: Columns of a run of matching template words: text, item, words of the text from and to, words of the item from and to, reading, first template word in the text and in the item, template words.
TEXT, ITEM, T0, T1, P0, P1, READING, A, B, N = range(10)


def _runs(ix: Index, t: Template, reading: int, width: int) -> np.ndarray:
    """Matching windows of one width, joined where they overlap or touch on one diagonal."""
    hashes, place, sieve = ix.tables[reading][width]
    found, starts = windows(t, width)
    maybe = sieve[(found >> U(64 - FILTER_BITS)).astype(np.int64)]
    found, starts = found[maybe], starts[maybe]
    a, b = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
    n = b - a
    if not n.sum():
        return np.zeros((0, 10), np.int64)
    y = place[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
    x = np.repeat(starts, n)
    items = ix.items[reading]
    text, item = np.searchsorted(t.at, x, "right") - 1, np.searchsorted(items.at, y, "right") - 1
    order = np.lexsort((y, x - y, item, text))
    text, item, x, y = text[order], item[order], x[order], y[order]
    new = np.ones(len(y), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | ((x - y)[1:] != (x - y)[:-1]) | (y[1:] - y[:-1] > width)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(y)) - 1
    text, item = text[first], item[first]
    from_text, from_item = t.words_at[text], items.words_at[item]
    return np.stack([
        text, item, t.first[x[first]] - from_text, t.first[x[last] + width] - from_text, items.first[y[first]] - from_item, items.first[y[last] + width] - from_item,
        np.full(len(first), reading), x[first], y[first], y[last] + width - y[first],
    ], axis=1)


def _chains(runs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most words of the item that a chain ending in each run covers, and the run before it (-1: none). A chain's runs
    increase in the text and the item; its diagonal moves by at most half an item, or a window, from run to run. `runs` is
    sorted by place in the text."""
    t0, t1, p0, p1 = (runs[:, k] for k in (T0, T1, P0, P1))
    near = max(WINDOW, size // 2)
    best, before = p1 - p0, np.full(len(runs), -1)
    reach = np.maximum.accumulate(t1)
    for k in range(1, len(runs)):
        low = int(np.searchsorted(reach[:k], t0[k] - size - near))
        j = slice(low, k)
        overlap = np.maximum(0, np.maximum(p1[j] - p0[k], t1[j] - t0[k]))
        more = p1[k] - p0[k] - overlap
        fits = (p0[j] <= p0[k]) & (p1[j] < p1[k]) & (more > 0) & (abs((t1[j] - p1[j]) - (t0[k] - p0[k])) <= near)
        if fits.any():
            gain = np.where(fits, best[j] + more, 0)
            g = int(np.argmax(gain))
            if gain[g] > best[k]:
                best[k], before[k] = gain[g], low + g
    return best, before


def matches(ix: Index, readings: list[Template], coverage: float) -> list[tuple[int, int, int, int, int, bool, bool]]:
    """(text, item, words covered, words of the item, first word in the text, slots agree, values are the same), for each text and item the chain of runs that covers most, if possible one whose slots agree."""
    runs = np.concatenate([np.zeros((0, 10), np.int64), *[_runs(ix, readings[k], k, width) for k, tables in enumerate(ix.tables) for width in tables]])
    if not len(runs):
        return []
    runs = runs[np.lexsort((runs[:, P0], runs[:, T0], runs[:, ITEM], runs[:, TEXT]))]
    first = np.flatnonzero(np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)))
    last = np.append(first[1:], len(runs))
    sizes = np.diff(ix.items[0].words_at)[runs[first, ITEM]]
    out = []
    for g in np.flatnonzero(np.add.reduceat(runs[:, P1] - runs[:, P0], first) >= coverage * sizes).tolist():
        row = _leak(ix, readings, runs[first[g] : last[g]], int(sizes[g]), coverage)
        if row:
            out.append(row)
    return out


def _leak(ix: Index, readings: list[Template], runs: np.ndarray, size: int, coverage: float) -> tuple | None:
    found = None
    # all runs first, which can cover most; if their slots disagree, each diagonal alone
    diagonal = np.stack([runs[:, READING], runs[:, A] - runs[:, B]], axis=1)
    for part in (slice(None), *([(diagonal == d).all(axis=1) for d in np.unique(diagonal, axis=0)] if len(runs) > 1 else [])):
        some = runs[part]
        best, before = _chains(some, size)
        for end in np.argsort(-best, kind="stable").tolist():
            if best[end] < coverage * size:
                break
            chain, k = [], end
            while k >= 0:
                chain.append(some[k].tolist())
                k = int(before[k])
            agree, same = _slots(ix, readings, chain[::-1])
            row = (int(some[end, TEXT]), int(some[end, ITEM]), int(best[end]), size, chain[-1][T0], agree, same)
            if agree:
                return row
            found = found or row
    return found


def _slots(ix: Index, readings: list[Template], chain: list[list[int]]) -> tuple[bool, bool]:
    value: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], int] = {}
    agree = same = True
    done = 0
    for run in chain:
        t, items = readings[run[READING]], ix.items[run[READING]]
        base = int(items.words_at[run[ITEM]])
        for k in range(run[N]):
            a, b = run[B] + k, run[A] + k
            if items.slot[a] and items.first[a] - base >= done:
                x, y, kind = int(items.raw[a]), int(t.raw[b]), int(items.code[a])
                agree &= value.setdefault((kind, x), y) == y and back.setdefault((kind, y), x) == x
                same &= x == y
        done = max(done, run[P1])
    return agree, same


RESULT = "doc_id long, item_id long, covered int, item_words int, first_word int, slots_agree boolean, same_values boolean"


def leaks(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document and item that it leaks; words are counted before placeholders are merged, first_word from 0."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    n, size = bench.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    sc = small_batches(docs.sparkSession).sparkContext
    out = None
    for b in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        found = slim.mapInArrow(_finder(sc.broadcast(index(sorted(((r.item_id, r.text) for r in rows), key=repr))), coverage), RESULT)
        out = found if out is None else out.unionByName(found)
    return out.where("slots_agree")


def _finder(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            ids = batch.column(0)
            for first, _, data, offsets in slices(batch.column(1), TEXT_BYTES):
                got = matches(ix, template(data, offsets), coverage)
                if got:
                    columns = list(zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([first + k for k in columns[0]])), pa.array([ix.ids[k] for k in columns[1]], pa.int64()), *[pa.array(c, pa.int32()) for c in columns[2:5]], *[pa.array(c, pa.bool_()) for c in columns[5:]]],
                        names=["doc_id", "item_id", "covered", "item_words", "first_word", "slots_agree", "same_values"],
                    )

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that leak no item, with their columns. Rows without an id go by their text."""
    column, id_ = free_name(docs, "_leak"), F.col(options.get("id_column", "doc_id"))
    # a text is what leaks, so rows are told apart by both
    text = F.xxhash64(F.col(options.get("text_column", "text")).cast("string"))
    keyed = docs.withColumn(column, F.xxhash64(F.coalesce(id_.cast("long"), text), id_.isNull()))
    found = written(leaks(keyed, benchmark, **options | {"id_column": column}).select(F.col("doc_id").alias(column)).distinct())
    return keyed.join(bounded(found), column, "left_anti").drop(column)
