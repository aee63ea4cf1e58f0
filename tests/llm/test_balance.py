"""Mixing and sharding."""

import random
import zlib
from collections import defaultdict

import pytest

from pairforge.llm import mix, shard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _id string, shard string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 1, "x", "y") for i, t, s in rows], SCHEMA)


def by_rounds(sizes, weights=(1.0, 2.0, 3.0), cap=3.0):
    """Targets as they are told: share, stop what is above its cap, share the excess anew."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            free.remove(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


def random_docs(seed, n=600):
    r = random.Random(seed)
    rows = [(k, " ".join(["w"] * r.choice([0, 1, 3, 10, 40, 200])), r.choice(["a", "a", "a", "b", "c", None, "tiny"] if k % 50 else ["z"])) for k in range(n)]
    rows = [(i, t, "tiny" if s == "tiny" and i < 60 else "a" if s == "tiny" else s) for i, t, s in rows]
    return rows + [rows[5]] * 7 + [(None, None, "b"), (None, "x y", None), (n + 1, "", "b"), (n + 2, "long " * 5000, "c")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = random_docs(seed)
    docs = docs_of(spark, rows)
    got = mix.mix_report(docs).collect()
    again = mix.mix_report(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = by_rounds(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    source = {i: s for i, _, s in rows if i is not None}
    for r in got:
        assert r.taken <= 3 * r.size and (r.taken % r.size == 0 if r.size else r.taken == 0)
        if r.doc_id is None:
            continue
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in taken:
        assert abs(taken[s] - want[s]) <= largest[s] + 6  # rows without an id also belong to their source


def test_mix_levels_and_expectation(spark):
    """Many levels of the tree, and each document taken as often as its source's rate says."""
    rows = [(k, "w " * (1 + k % 9), "ab"[k % 3 > 0]) for k in range(400)]
    docs, total = docs_of(spark, rows), defaultdict(float)
    for seed in range(6):
        for r in mix.mix_report(docs, block=4, seed=seed).collect():
            total[r.doc_id % 3 > 0] += r.taken / 6
    want = by_rounds({"a": sum(1 + k % 9 for k in range(0, 400, 3)), "b": sum(1 + k % 9 for k in range(400) if k % 3)})
    assert total[False] == pytest.approx(want["a"], abs=9) and total[True] == pytest.approx(want["b"], abs=9)


def test_mix_rows(spark):
    docs = docs_of(spark, random_docs(3))
    out = mix.mix(docs)
    assert out.columns == docs.columns
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert words == sum(r.taken for r in mix.mix_report(docs).collect())
    empty = docs.where("doc_id < -5")
    assert mix.mix(empty).count() == mix.mix_report(empty).count() == 0


def least_capacity(sizes, k):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, n, fill = (lo + hi) // 2, 1, 0
        for s in sizes:
            n, fill = (n, fill + s) if fill + s <= mid else (n + 1, s)
        lo, hi = (lo, mid) if n <= k else (mid + 1, hi)
    return lo


def test_shard(spark):
    r = random.Random(4)
    texts = ["é" * r.randrange(200) + str(k) for k in range(900)]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(2000 + k, texts[k % 5], "s") for k in range(60)] + [(None, None, None), (1, texts[1], "s"), (5000, "", "s")]
    docs = docs_of(spark, rows)
    got = shard.shard(docs, 10, slot_block=16).collect()
    assert len(got) == len(rows)
    by_text, slots, size = defaultdict(set), defaultdict(list), defaultdict(int)
    text = {i: t for i, t, _ in rows}
    for x in got:
        t = (text[x.doc_id] or "").encode()
        assert x.size == len(t) + 16 and x.law == "bytes" and x.grown_shard is None
        assert x.text_crc32 == (None if text[x.doc_id] is None else zlib.crc32(t))
        by_text[text[x.doc_id]].add(x.shard)
        slots[x.shard].append(x.slot)
        size[x.shard] += x.size
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(10))
    atoms = docs.selectExpr("shiftrightunsigned(xxhash64(text), 48) AS atom", "coalesce(octet_length(text), 0) + 16 AS b").groupBy("atom").sum("b").orderBy("atom").collect()
    assert max(size.values()) == least_capacity([a[1] for a in atoms], 10)
    assert shard.shard(docs.where("doc_id < -1"), 10).count() == 0


def test_shard_with_a_hot_text(spark):
    rows = [(k, "hot" * 50, "s") for k in range(500)] + [(1000 + k, f"text {k}", "s") for k in range(500)]
    got = shard.shard(docs_of(spark, rows), 8).collect()
    hot = {x.shard for x in got if x.doc_id < 1000}
    rest = defaultdict(int)
    for x in got:
        if x.doc_id >= 1000:
            rest[x.shard] += x.size
    assert len(hot) == 1 and not hot & set(rest) and len(rest) == 7
    assert max(rest.values()) < 1.3 * min(rest.values())
