"""A linear-chain conditional random field over the words of a text.

A word's features are the hashed byte n-grams of the word with the blanks around it, which cover its prefixes and
suffixes, and the hash of the whole word, a learned lexicon. Each feature adds to the scores of the labels; learned
transitions join neighbouring words, and forward-backward gives each word's exact marginals.

All texts of a batch run as one chain in which a text's first word forgets what came before. The chain is cut into equal
stretches that advance together: products of transfer matrices carry the state from stretch to stretch, and the words
inside follow from there, so nothing is approximated at the cuts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pairforge.llm.kernel import IS_SPACE, U, Words, words

#: Byte n-grams, and the number of hash buckets of each order and of the lexicon.
ORDERS = (2, 3, 4)
BITS = 16
STRETCH = 192


@dataclass
class Crf:
    """Scores are relative to the first label, whose own are 0."""

    labels: list
    ngrams: np.ndarray  #: (orders, buckets, labels - 1)
    lexicon: np.ndarray  #: (buckets, labels - 1)
    bias: np.ndarray  #: (labels - 1)
    transitions: np.ndarray  #: (labels, labels)
    start: np.ndarray  #: (labels)

    @classmethod
    def zero(cls, labels: list, orders: int = len(ORDERS)) -> Crf:
        n = len(labels)
        return cls(list(labels), np.zeros((orders, 1 << BITS, n - 1), np.float32), np.zeros((1 << BITS, n - 1), np.float32), np.zeros(n - 1, np.float32), np.zeros((n, n)), np.zeros(n))


@dataclass
class Features:
    """Bucket numbers of each distinct word: of its n-grams, order by order, with each word's stretch of them; and of itself."""

    grams: list[np.ndarray]
    spans: list[np.ndarray]
    word: np.ndarray
    which: np.ndarray  #: the distinct word that each word is
    first: np.ndarray  #: whether the word begins a text


def features(data: np.ndarray, offsets: np.ndarray, lower: bool = True, orders: tuple[int, ...] = ORDERS) -> tuple[Features, Words]:
    w = words(data, offsets, lower)
    n = len(w.starts)
    first = np.zeros(n, bool)
    first[w.at[:-1][w.counts > 0]] = True
    distinct, one, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
    # distinct words in a row, each with blanks around it, so many that no n-gram of it reaches the next
    length = w.ends[one] - w.starts[one]
    gap = max(2, max(orders) - 2)
    after = np.cumsum(length + gap) + 1
    starts = after - length - gap
    line = np.full(int(after[-1]) + max(orders) if len(one) else max(orders), 0x20, np.uint32)
    place = np.repeat(starts - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) if len(one) else np.zeros(0, np.int64)
    line[place] = w.data[np.repeat(w.starts[one] - starts, length) + place] if len(one) else 0
    grams, spans = [], []
    for k in orders:
        size = len(line) - max(orders)
        code = np.zeros(size, np.uint32)
        for j in range(k):
            code = code * np.uint32(0x01000193) + line[j : j + size] + np.uint32(1)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        grams.append((code >> np.uint32(32 - BITS)).astype(np.int32))
        # from the blank before the word to the blank after it; a word shorter than that has one n-gram
        spans.append(np.stack([starts - 1, np.maximum(starts + length + 2 - k, starts)], 1))
    return Features(grams, spans, (distinct >> U(64 - BITS)).astype(np.int64), which, first), w


def emissions(model: Crf, f: Features) -> np.ndarray:
    """(words, labels)."""
    out = np.zeros((len(f.word), len(model.labels)))
    if len(f.word):
        for c in range(len(model.labels) - 1):
            for k, (grams, spans) in enumerate(zip(f.grams, f.spans, strict=True)):
                out[:, c + 1] += np.add.reduceat(model.ngrams[k, :, c][grams], np.minimum(spans.ravel(), len(grams) - 1))[::2]
            out[:, c + 1] += model.lexicon[:, c][f.word] + model.bias[c]
    return out[f.which]


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray, expect: bool = False):
    """Marginals (words, labels) by forward-backward; with `expect` also the log likelihood's normaliser gradients:
    expected transitions (labels, labels) and expected starts (labels)."""
    n, labels = scores.shape
    if not n:
        return (scores, np.zeros((labels, labels)), np.zeros(labels)) if expect else scores
    steps = min(STRETCH, max(1, int(np.sqrt(n))))
    rows = -(-n // steps)
    a = np.exp(transitions - transitions.max())
    s = np.exp(start - start.max())
    psi = np.ones((rows * steps, labels))
    psi[:n] = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -60))
    fresh = np.ones(rows * steps, bool)  # what fills up the last stretch forgets the words before it
    fresh[:n] = first
    psi = np.ascontiguousarray(psi.reshape(rows, steps, labels).transpose(1, 0, 2))
    fresh = np.ascontiguousarray(fresh.reshape(rows, steps).T)
    # products of each stretch's transfer matrices
    p = np.broadcast_to(np.eye(labels), (rows, labels, labels)).copy()
    for t in range(steps):
        q = (p.reshape(-1, labels) @ a).reshape(p.shape)
        if fresh[t].any():
            at = fresh[t]
            q[at] = p[at].sum(2)[:, :, None] * s
        q *= psi[t][:, None, :]
        if t % 8 == 7:  # often enough to stay within range: a factor of a step is at most `labels` and at least e^-120
            q /= q.reshape(rows, -1).max(1)[:, None, None]
        p = q
    into, outof = np.empty((rows, labels)), np.empty((rows, labels))
    x = np.full(labels, 1 / labels)
    for r in range(rows):
        into[r] = x
        x = x @ p[r]
        x /= x.sum()
    x = np.full(labels, 1 / labels)
    for r in range(rows - 1, -1, -1):
        outof[r] = x
        x = p[r] @ x
        x /= x.sum()
    forward = np.empty((steps, rows, labels))
    x = into
    for t in range(steps):
        y = x @ a
        if fresh[t].any():
            y[fresh[t]] = x[fresh[t]].sum(1, keepdims=True) * s
        y *= psi[t]
        y /= y.sum(1, keepdims=True)
        forward[t] = x = y
    out = np.empty((steps, rows, labels))
    beta = outof
    pairs, starts = np.zeros((labels, labels)), np.zeros(labels)
    valid = (np.arange(rows * steps) < n).reshape(rows, steps).T
    for t in range(steps - 1, -1, -1):
        m = forward[t] * beta
        m /= m.sum(1, keepdims=True)
        out[t] = m
        pb = psi[t] * beta
        if expect:
            before = forward[t - 1] if t else into
            inner = ~fresh[t] & valid[t]
            joint = before[inner][:, :, None] * a * pb[inner][:, None, :]
            pairs += (joint / joint.sum((1, 2))[:, None, None]).sum(0)
            starts += m[fresh[t] & valid[t]].sum(0)
        nxt = pb @ a.T
        if fresh[t].any():
            nxt[fresh[t]] = 1.0
        nxt /= nxt.sum(1, keepdims=True)
        beta = nxt
    flat = out.transpose(1, 0, 2).reshape(rows * steps, labels)[:n]
    return (flat, pairs, starts) if expect else flat


def predict(model: Crf, data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, Words]:
    f, w = features(data, offsets, lower)
    return marginals(emissions(model, f), f.first, model.transitions, model.start), w


def train(model: Crf, data: np.ndarray, offsets: np.ndarray, gold: np.ndarray, *, rounds: int = 40, rate: float = 0.3, pull: float = 1e-3, lower: bool = True) -> Crf:
    """Fits `model` in place to the label numbers `gold` of the words, by full-batch Adagrad on the log likelihood."""
    f, _ = features(data, offsets, lower)
    n, labels, kinds = len(f.which), len(model.labels), len(f.word)
    if not n:
        return model
    target = np.zeros((n, labels))
    target[np.arange(n), gold] = 1
    inner = np.flatnonzero(~f.first)
    seen_pairs = np.zeros((labels, labels))
    np.add.at(seen_pairs, (gold[inner - 1], gold[inner]), 1)
    seen_starts = target[f.first].sum(0)
    owners = []
    for spans in f.spans:
        length = spans[:, 1] - spans[:, 0]
        place = np.repeat(spans[:, 0] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        owners.append((np.repeat(np.arange(kinds), length), place))
    buckets = 1 << BITS
    squares = {k: np.full_like(getattr(model, k), 1e-6, dtype=np.float64) for k in ("ngrams", "lexicon", "bias", "transitions", "start")}

    def move(name: str, slope: np.ndarray) -> None:
        value = getattr(model, name)
        slope = slope - pull * value
        squares[name] += slope * slope
        value += (rate * slope / np.sqrt(squares[name])).astype(value.dtype)

    for _ in range(rounds):
        m, pairs, starts = marginals(emissions(model, f), f.first, model.transitions, model.start, expect=True)
        off = (target - m) / n
        grams, lexicon = np.zeros(model.ngrams.shape), np.zeros(model.lexicon.shape)
        for c in range(labels - 1):
            of_kind = np.bincount(f.which, off[:, c + 1], kinds)
            for k, (owner, place) in enumerate(owners):
                grams[k, :, c] = np.bincount(f.grams[k][place], of_kind[owner], buckets)
            lexicon[:, c] = np.bincount(f.word, of_kind, buckets)
        move("ngrams", grams)
        move("lexicon", lexicon)
        move("bias", off[:, 1:].sum(0))
        move("transitions", (seen_pairs - pairs) / n)
        move("start", (seen_starts - starts) / n)
    return model


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as bytes and offsets."""
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


