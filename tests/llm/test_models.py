"""Language ID, quality, toxicity, decontamination, language model: held-out accuracy, brute force and odd inputs."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.llm import crf, decontaminate, langid, lm, quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(10**6, None, None, None), (10**6 + 1, "", "en", "s"), (10**6 + 2, " \n\t", None, None), (10**6 + 3, "123 $$$ 4.5", "en", None), (None, "the and of", "en", "s"), (10**6 + 4, "é" * 50_000, "fr", "s"), (10**6 + 5, "ﬂ 中文 ñ", None, "s")]
EXTRA = "score double, label int, _score string, _leak string, doc long"


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame(ODD + ODD[4:5], "doc_id long, text string, lang string, source string")
    return real.unionByName(odd).selectExpr("*", "0.5D AS score", "1 AS label", "'x' AS _score", "'y' AS _leak", "7L AS doc").repartition(4)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def remainder(i, m):
    return -1 if i is None else zlib.crc32(str(i).encode()) % m


def test_crf_marginals():
    r = np.random.default_rng(0)
    for n, starts in ((7, 3), (9, 1), (1, 1)):
        scores, move, start = r.normal(size=(n, 3)) * 2, r.normal(size=(3, 3)), r.normal(size=3)
        first = np.zeros(n, bool)
        first[[0, *r.choice(np.arange(1, max(n, 2)), starts - 1, replace=False)]] = True
        want, whole = np.zeros((n, 3)), 0.0
        for y in itertools.product(range(3), repeat=n):
            p = math.exp(sum(scores[i, y[i]] + (start[y[i]] if first[i] else move[y[i - 1], y[i]]) for i in range(n)))
            whole += p
            for i in range(n):
                want[i, y[i]] += p
        assert np.allclose(crf.marginals(scores, first, move, start), want / whole)


def test_crf_batches_do_not_matter():
    r = np.random.default_rng(1)
    model = crf.Crf.zero(["a", "b", "c"])
    model.ngrams += r.normal(size=model.ngrams.shape).astype(np.float32)
    texts = ["one two", "", "three four\tfive ", "x", " six"] * 30
    whole = crf.predict(model, *crf.joined(texts))[0]
    alone = np.concatenate([crf.predict(model, *crf.joined([t]))[0] for t in texts])
    assert np.allclose(whole, alone, atol=1e-5)


def test_langid(docs):
    got = langid.langid_report(docs).collect()
    assert len(got) == docs.count()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held if r.doc_id < 10**6]) > 0.97
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {10**6, 10**6 + 1, 10**6 + 2, 10**6 + 3}
    nothing = langid.langid_report(docs.withColumn("lang", F.lit(None).cast("string"))).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)
    assert langid.langid_report(docs.where("doc_id < -1")).count() == 0


def test_code_switching(docs, spark):
    model = langid.fit(docs)
    rows = {r.lang: r.text for r in docs.where("lang IN ('en', 'fr') AND length(text) > 2000").limit(60).collect()}
    half = " ".join(rows["en"].split()[:100] + rows["fr"].split()[:100])
    r = langid.predict(spark.createDataFrame([(1, half)], "doc_id long, text string"), model).first()
    assert abs(r.lang_words["en"] - 100) < 15 and abs(r.lang_words["fr"] - 100) < 15


def accuracy(got, labels, column, at):
    label = {r.doc_id: r[column] for r in labels.collect()}
    return np.mean([r.predicted == label[r.doc_id] for r in got if r.held_out and r.doc_id in label])


def test_quality(docs, labels):
    got = quality.quality_report(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (remainder(r.doc_id, 3) == 1) for r in got)
    assert accuracy(got, labels, "quality", 0.5) > 0.93
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0.75 < kept.count() / docs.count() < 0.95
    one = quality.quality_report(docs, labels.where("quality = 1")).first()
    assert one.score > 0.9
    assert quality.quality_report(docs, labels.where("doc_id < -1")).first().score == pytest.approx(0.5)
    assert quality.quality_report(docs.where("doc_id < -1"), labels).count() == 0


def test_toxicity(docs, labels, spark):
    model = toxicity.fit(docs, labels)
    got = toxicity.toxicity_report(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (remainder(r.doc_id, 4) == 2) for r in got)
    assert accuracy(got, labels, "toxic", 0.3) > 0.9
    r = toxicity.tag(spark.createDataFrame([(1, "Ünder the and you worthless idiot thon the")], "doc_id long, text string"), model).first()
    assert [(x.start, x.end) for x in r.spans] == [(18, 33)] and r.spans[0].marginal > 0.8
    assert any("idiot" in "Ünder the and you worthless idiot thon the"[s.start : s.end] for s in r.spans)
    assert toxicity.toxicity_report(docs, labels.where("doc_id < -1")).first().score == pytest.approx(0.5)
    assert toxicity.toxicity_report(docs.where("doc_id < -1"), labels).count() == 0


ITEM = "A train leaves Boston at 5 km per hour and then at 5 km again before Alice boards it with 12 heavy bags"


def test_templates(spark):
    texts = {
        1: "intro words here. " + ITEM + " trailing words.",
        2: ITEM.replace("5", "7").replace("12", "40").replace("Boston", "Denver").replace("Alice", "Mary").replace("km", "miles"),
        3: ITEM.replace("5 km per", "7 km per"),  # one value of the item stands for two
        4: "A train leaves Boston at nothing else in common with any of it",
        5: None,
        6: "",
        7: "short item here now",
        8: "Short ITEM, here now!",
    }
    rows = [(i, t, 0, "a", "b") for i, t in texts.items()] + [(1, texts[1], 0, "a", "b"), (None, texts[1], 0, "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, covered int, _leak string, item_id string")
    bench = spark.createDataFrame([(1, ITEM, 9), (2, "short item here now", 9), (3, None, 9), (4, "two", 9), (None, "nobody knows this", 9)], "item_id long, text string, doc_id long")
    got = decontaminate.leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got if r.doc_id is not None) == [(1, 1), (1, 1), (2, 1), (7, 2), (8, 2)]
    assert {r.doc_id: r.same_values for r in got}[2] is False and {r.doc_id: r.same_values for r in got}[1] is True
    kept = decontaminate.drop_leaks(docs, bench)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 6] and kept.columns == docs.columns
    assert decontaminate.leaks(docs, bench.where("item_id < 0")).count() == 0
    assert decontaminate.leaks(docs.where("doc_id < 0"), bench).count() == 0


def test_planted_benchmark(docs, spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.where("text IS NOT NULL AND doc_id IS NOT NULL").collect() for i, t in items.items() if t in r.text}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert want <= got and len(got - want) <= 0.05 * len(want)


def brute_lm(rows):
    lower = {c: c + 32 for c in range(65, 91)}
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [None]) for i, t in rows]
    one, two, begins = Counter(), Counter(), 0
    for i, ts in tokens:
        if remainder(i, 7) != 2:
            one.update(ts)
            two.update(zip([0, *ts[:-1]], ts, strict=True))
            begins += 1
    n = lambda c: tuple(sum(v == k for v in c.values()) for k in range(1, lm.TOP + 2))
    counts = lm.Counts(sum(one.values()), len(one), n(one), n(two))
    p = lambda w: float(counts.word_probability(np.array([one[w]]))[0])
    unknown = float(counts.word_probability(np.array([0]))[0])
    assert sum(map(p, one)) + unknown == pytest.approx(1)
    d = counts.pair_discount(np.arange(lm.TOP + 2))
    seen = lambda v: begins if v == 0 else one[v]
    pair = {k: d[min(c, lm.TOP + 1)] * c / seen(k[0]) for k, c in two.items() if c >= lm.CUTOFF}
    kept, covered = defaultdict(float), defaultdict(float)
    for (v, w), x in pair.items():
        kept[v] += x
        covered[v] += p(w)
    alpha = {}
    for v in kept:
        if kept[v] > 1 - lm.FULL:
            pair |= {k: x * seen(v) / (seen(v) + 1) for k, x in pair.items() if k[0] == v}
            alpha[v] = 1 / (seen(v) + 1) / (1 - covered[v])
        else:
            alpha[v] = (1 - kept[v]) / (1 - covered[v])
        assert sum(x for k, x in pair.items() if k[0] == v) + alpha[v] * (1 - covered[v]) == pytest.approx(1)
    out = []
    for i, ts in tokens:
        score = sum(math.log10(pair[k]) if k in pair else math.log10(alpha.get(k[0], 1) * p(k[1])) for k in zip([0, *ts[:-1]], ts, strict=True))
        base = sum(math.log10((one[t] + 1) / (counts.tokens + counts.types + 1)) for t in ts)
        out.append((i, remainder(i, 7) == 2, len(ts), sum(t in one for t in ts), counts.tokens, round(base, 6), round(score, 6)))
    return out


@pytest.mark.parametrize("block", [50, 10**6])
def test_language_model(spark, monkeypatch, block):
    r = np.random.default_rng(3)
    rows = [(k, " ".join(f"W{min(int(x), 60)}" for x in r.pareto(0.8, int(r.integers(0, 60))))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, " \x0b "), (None, "w1 w2"), (5, rows[5][1]), (300, "always follows " * 20)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, tokens int, block string").coalesce(1)
    monkeypatch.setattr(lm, "RANGE", 700)
    want = brute_lm(rows)
    got = [(x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6), round(x.score, 6)) for x in lm.lm_scores(docs.repartition(1 + (block == 50) * 3)).collect()]
    key = lambda x: (x[0] is None, x[0] or 0)
    for a, b in zip(sorted(want, key=key), sorted(got, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-4)


def test_language_model_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert lm.lm_scores(docs.where("doc_id > 1")).count() == 0
    held = next(k for k in range(99) if remainder(k, 7) == 2)
    (x,) = lm.lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) == (3, 0, 0, 0.0, 0.0)


def test_single_pairs_are_evidence(spark):
    """Against Katz's formulas over all pairs, without a cutoff."""
    r = np.random.default_rng(11)
    rows = [(k, " ".join(f"w{min(int(x), 80)}" for x in r.pareto(0.7, 40))) for k in range(120)]
    one, two, begins = Counter(), Counter(), 0
    for i, t in rows:
        if remainder(i, 7) != 2:
            ts = [*t.split(), None]
            one.update(ts)
            two.update(zip([0, *ts[:-1]], ts, strict=True))
            begins += 1
    n = [sum(c == k for c in two.values()) for k in range(1, 7)]
    share = 6 * n[5] / n[0]
    good_turing = [((k + 1) * n[k] / n[k - 1] / k - share) / (1 - share) for k in range(1, 6)]
    d = [0, *[g if 0.05 < g < 1 else (k - 0.5) / k for k, g in enumerate(good_turing, 1)], 1]
    assert 0 < d[1] < 1
    counts = lm.Counts(sum(one.values()), len(one), tuple(sum(c == k for c in one.values()) for k in range(1, 7)), tuple(n))
    p = lambda w: float(counts.word_probability(np.array([one[w]]))[0])
    seen = lambda v: begins if v == 0 else one[v]
    pair = {(v, w): d[min(c, 6)] * c / seen(v) for (v, w), c in two.items()}

    def score(v, w):
        if (v, w) in pair:
            return math.log10(pair[v, w])
        mine = [k for k in pair if k[0] == v]
        return math.log10(p(w) * ((1 - sum(pair[k] for k in mine)) / (1 - sum(p(k[1]) for k in mine)) if mine else 1))

    assert all(sum(x for k, x in pair.items() if k[0] == v) < 1 - lm.FULL for v, _ in pair)
    texts = {i: [*t.split(), None] for i, t in rows}
    hit = [two[k] for i, ts in texts.items() if remainder(i, 7) == 2 for k in zip([0, *ts[:-1]], ts, strict=True)]
    assert hit.count(1) >= 10
    for x in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        ts = texts[x.doc_id]
        assert x.score == pytest.approx(sum(score(v, w) for v, w in zip([0, *ts[:-1]], ts, strict=True)), abs=1e-6)
