"""Substring dedup, the n-gram Jaccard join, components."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from pairforge.llm import jaccard, substrings
from pairforge.llm.components import components
from pairforge.llm.kernel import U

SCHEMA = "doc_id long, text string, pos long, a long, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], SCHEMA).repartition(3)


def repeats(rows, span):
    """Each row's words, those removed, and the hash of the rest."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(k for k in words if k is not None):
        for k in range(len(words[i]) - span + 1):
            first.setdefault(tuple(words[i][k : k + span]), i)
    out = {}
    for i, ws in words.items():
        gone = [False] * len(ws)
        for k in range(len(ws) - span + 1):
            if i is not None and first[tuple(ws[k : k + span])] < i:
                gone[k : k + span] = [True] * span
        rest = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out[i] = (len(ws), sum(gone), hashlib.sha256(rest.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed,kinds,span,anchor", [(1, 3, 6, 3), (2, 40, 8, 3), (3, 2, 5, 2), (4, 500, 50, 12)])
def test_repeats(spark, seed, kinds, span, anchor):
    r = random.Random(seed)
    blank = lambda: r.choice([" ", "\n", "\t ", "\x0b"])
    passages = [[f"w{r.randrange(kinds)}" for _ in range(r.randrange(span - 2, 4 * span))] for _ in range(6)]
    rows = []
    for k in range(60):
        ws = []
        for _ in range(r.randrange(1, 5)):
            ws += r.choice(passages)[r.randrange(3) :] if r.random() < 0.5 else [f"w{r.randrange(kinds)}" for _ in range(r.randrange(2 * span))]
        rows.append((k, "".join(w + blank() for w in ws)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, rows[3][1]), (104, rows[3][1].replace("\n", "  ")), (105, "é ü"), (None, rows[4][1]), (106, "same " * 300), (107, "same " * 200)]
    want = repeats(rows, span)
    rows.append(rows[7])
    got = substrings.remove_repeats(docs_of(spark, rows), span=span, anchor=anchor).collect()
    assert len(got) == len(rows)
    for x in got:
        assert (x.n_words, x.n_removed, x.kept_sha256) == want[x.doc_id], x.doc_id
        if x.kept is not None:
            assert hashlib.sha256(x.kept.encode()).hexdigest() == x.kept_sha256


def test_repeats_of_nothing(spark):
    assert substrings.remove_repeats(docs_of(spark, [(1, "a")]).where("doc_id > 1")).count() == 0


def shingles(text):
    ws = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def groups(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    name = {i: i for i in sets}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                name[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_groups(spark, seed):
    r = random.Random(seed)
    rows, next_id = [], iter(range(10_000))
    passage = [f"p{k}" for k in range(40)]
    for _ in range(25):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([3, 5, 6, 7, 8, 9, 12, 20, 40, 68, 90, 150, 300]))]
        if r.random() < 0.3:
            base += passage
        rows.append((next(next_id), " ".join(base)))
        for _ in range(r.randrange(6)):
            ws = list(base)
            for _ in range(max(1, int(len(ws) * r.choice([0.0, 0.01, 0.03, 0.05])))):
                ws[r.randrange(len(ws))] = f"v{r.randrange(3000)}"
            if r.random() < 0.5:
                ws += [f"v{r.randrange(3000)}" for _ in range(int(len(ws) * r.choice([0.05, 0.2, 0.3])))]
            rows.append((next(next_id), " ".join(ws)))
    rows += [(20_000, None), (20_001, ""), (20_002, " "), (20_003, "One Two"), (20_004, "one two"), (20_005, "a b c d e"), (20_006, "b b b b b b b b b b b")]
    r.shuffle(rows)
    want = groups(rows)
    rows += [rows[0], (None, rows[0][1]), (None, None)]
    got = jaccard.similar_groups(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None
        else:
            assert (x.n_shingles, x.component_id) == want[x.doc_id], x.doc_id
    kept = jaccard.keep_first(docs_of(spark, rows).withColumnRenamed("a", "_copy"))
    assert {x.doc_id for x in kept.collect() if x.doc_id is not None} == {i for i, (_, c) in want.items() if c == i}
    assert kept.columns == ["doc_id", "text", "pos", "_copy", "n"]


def test_blocks_in_rounds(spark, monkeypatch):
    """Many blocks of one family are copied a bounded part at a time, and no link is lost."""
    r = random.Random(4)
    base = [f"w{k}" for k in range(24)]
    rows = []
    for k in range(60):  # all share a passage; each third is a near copy of another
        own = [f"v{r.randrange(3000)}" for _ in range(12)] if k % 3 else rows[-1][1].split()[24:-1] + ["x"] if rows else []
        rows.append((k, " ".join(base + own)))
    sizes, compare = [], jaccard.written
    monkeypatch.setattr(jaccard, "BLOCK_WEIGHT", 1000)
    monkeypatch.setattr(jaccard, "ROUND_BYTES", 1)
    monkeypatch.setattr(jaccard, "written", lambda df: sizes.append(df.columns) or compare(df))
    # signatures alone link nothing here, so all of the family is left to the blocks
    monkeypatch.setattr(jaccard, "verify", lambda pairs, shingled: pairs.where("a < 0").select("a", "b"))
    got = jaccard.similar_groups(docs_of(spark, rows)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == groups(rows)
    assert sizes.count(["a", "b"]) > 4


def test_similar_groups_of_nothing(spark):
    assert jaccard.similar_groups(docs_of(spark, [(1, "a")]).where("doc_id > 1")).count() == 0


def test_sets_without_enough_signatures(spark):
    """Sets made to fill too few segments are marked, and found all the same."""
    mark = lambda s: jaccard.signatures(s, np.zeros(0, U))[1]
    words = [f"w{k}" for k in range(40_000)]
    text = " ".join(words)
    data = np.frombuffer(text.encode(), np.uint8)
    (pool,) = jaccard.sets(data, np.array([0, len(data)]))
    assert mark(pool[:7])
    # of six n-grams in one segment only two differences are covered, and three are needed
    (crowded,) = [v for v in (pool[(jaccard.mixed(pool ^ U(3)) % U(2)) == 0][:6],)]
    assert not mark(np.sort(crowded))


def test_signatures_meet():
    """Any two sets that are similar enough share a signature, in every band and at every border."""
    r = np.random.default_rng(5)
    none = np.zeros(0, U)
    for n in [*range(1, 70), 95, 96, 97, 127, 128, 129, 300, 1000]:
        for _ in range(8):
            s = np.unique(r.integers(0, 2**63, n).astype(U))
            drop = r.integers(0, n // 4 + 1)
            a = np.sort(r.permutation(s)[: max(1, n - drop)])
            add = r.integers(0, n // 4 + 1)
            b = np.unique(np.concatenate([r.permutation(s)[: max(1, n - r.integers(0, n // 8 + 1))], r.integers(0, 2**63, add).astype(U)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            for hot in (none, s[: n // 2]):
                (x, ok_x), (y, ok_y) = (jaccard.signatures(v, np.intersect1d(v, hot)) for v in (a, b))
                if ok_x and ok_y:
                    assert len(np.intersect1d(np.concatenate(x), np.concatenate(y))), n


def test_components(spark):
    r = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(100 + r.randrange(80), 100 + r.randrange(80)) for _ in range(50)]
    links = [(a, b) for a, b in links if a != b]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for i in sorted(near):
        if i in want:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = i
                todo += near[x]
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {x.node: x.component for x in got.collect()} == want
