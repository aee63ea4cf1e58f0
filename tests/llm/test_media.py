"""Copies of images: crops and edits of synthetic scenes are found, other scenes are left alone."""

import numpy as np

from pairforge.llm import media


def scene(r, size=120):
    a = np.full((size, size), 128.0)
    for _ in range(40):
        y, x = r.integers(0, size - 12, 2)
        a[y : y + r.integers(5, 25), x : x + r.integers(5, 25)] = r.integers(0, 255)
    return a


def edits(a, r):
    return [a[20:110, 15:105], a[5:100, 10:115], a * 0.7 + 20, np.clip(a + r.normal(0, 4, a.shape), 0, 255), np.rot90(a)]


def pgm(a):
    return b"P5\n# made here\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.clip(np.rint(a), 0, 255).astype(np.uint8).tobytes()


def test_recall_against_all_pairs(spark):
    r = np.random.default_rng(7)
    rows, scene_of = [], {}
    for k in range(12):
        a = scene(r)
        for j, e in enumerate([a, a, *edits(a, r)]):
            scene_of[100 * k + j] = k
            rows.append((100 * k + j, bytearray(pgm(e)), 1, "x"))
    rows += [(5000, None, 1, "x"), (5001, bytearray(b""), 1, "x"), (5002, bytearray(b"P5 garbage"), 1, "x"), (5003, bytearray(pgm(np.full((60, 60), 9.0))), 1, "x"), (5004, bytearray(pgm(np.zeros((2, 2)))), 1, "x"), (None, rows[0][1], 1, "x"), rows[3]]
    images = spark.createDataFrame(rows, "id long, data binary, bits int, first string").repartition(3)
    got = media.copy_groups(images, id_column="id", image_column="data").collect()
    assert len(got) == len(rows)
    group = {x.image_id: x.group_id for x in got if x.image_id is not None}
    assert all(x.group_id is None for x in got if x.image_id is None)
    assert all(group[i] == i for i in range(5000, 5005))
    pairs = [(i, j) for i in scene_of for j in scene_of if i < j]
    alike = [(i, j) for i, j in pairs if scene_of[i] == scene_of[j]]
    assert np.mean([group[i] == group[j] for i, j in alike]) >= 0.9
    assert not any(group[i] == group[j] for i, j in pairs if scene_of[i] != scene_of[j])
    # against comparing everything with everything
    described = {i: media.describe(media.decode(bytes(d))) for i, d, *_ in rows if i in scene_of}
    links = [(i, j) for i, j in pairs if media.linked(described[i], described[j])]
    assert np.mean([group[i] == group[j] for i, j in links]) >= 0.9


def test_crowded_buckets_and_equal_pixels(spark):
    """Longer keys where buckets are crowded, and small or flat pictures that are equal."""
    r = np.random.default_rng(9)
    mark, rows = scene(r, 24), []
    for k in range(8):  # different scenes with one mark
        a = scene(r, 160)
        a[100:124, 100:124] = mark
        rows += [(10 * k + j, bytearray(pgm(e))) for j, e in enumerate([a, np.clip(a + r.normal(0, 2, a.shape), 0, 255)])]
    flat, tiny = bytearray(pgm(np.full((60, 60), 9.0))), bytearray(pgm(np.arange(16.0).reshape(4, 4)))
    rows += [(900, flat), (901, flat), (902, tiny), (903, tiny)]
    images = spark.createDataFrame(rows, "id long, data binary")
    shown = {i: media.describe(media.decode(bytes(d))) for i, d in rows if i < 900}
    links = [(i, j) for i in shown for j in shown if i < j and media.linked(shown[i], shown[j])]
    assert len(links) >= 8
    for crowd in (1, 32):
        group = {x.image_id: x.group_id for x in media.copy_groups(images, id_column="id", image_column="data", crowd=crowd).collect()}
        assert np.mean([group[i] == group[j] for i, j in links]) >= 0.9
        assert {group[i] for i in shown} >= {i for i in shown if i not in {j for _, j in links}}
        assert [group[i] for i in range(900, 904)] == [900, 900, 902, 902]


def test_recall_of_the_query(spark):
    """Near copies of vectors, shown as pictures, against comparing everything with everything."""
    r = np.random.default_rng(2)
    base = r.normal(size=(30, 64))
    rows = [(k, (base[k % 30] + r.normal(0, 0.06, 64) * (k >= 30)).tolist()) for k in range(90)]
    got = {x.image_id: x.group_id for x in media.copy_groups(spark.createDataFrame(rows, "id long, v array<double>"), id_column="id", image_column="v", to_image=media.render).collect()}
    shown = {i: media.describe(media.render(v)) for i, v in rows}
    links = [(i, j) for i in shown for j in shown if i < j and media.linked(shown[i], shown[j])]
    assert len(links) >= 80 and all(i % 30 == j % 30 for i, j in links)
    assert np.mean([got[i] == got[j] for i, j in links]) >= 0.9


def _marked(r, n):
    """Pictures that share one descriptor's first two parts and nothing else of use; the first two are copies all the same."""
    described = []
    for k in range(n):
        bits = r.integers(0, 256, (12, 32), dtype=np.uint8)
        places = np.stack([r.uniform(0, 90, 12), r.uniform(0, 90, 12), np.zeros(12), np.zeros(12)], 1).astype(np.float32)
        described.append((bits, places))
    for b in range(12):  # of the copy every part but two of one corner has a bit changed, so that it meets its original there alone
        copy = described[0][0][b].copy()
        copy[0 if b else 8 :: 4] ^= 1
        described[1][0][b] = copy
    described[1][1][:] = described[0][1]
    for bits, _ in described:
        bits[0, :8] = described[0][0][0, :8]
    return described


def test_crowded_buckets_lose_no_pair(spark, monkeypatch):
    """A pair that meets in one crowded bucket only, by the shortest keys only."""
    shown = _marked(np.random.default_rng(11), 40)
    assert [(i, j) for i in range(40) for j in range(i) if media.linked(shown[i], shown[j])] == [(1, 0)]
    # the last picture, which comes first in the bucket, is no copy
    ids = {k: k + 1 for k in range(40)} | {39: 0}
    rows = [(ids[k], len(b), str(k).encode(), b.tobytes(), p.tobytes()) for k, (b, p) in enumerate(shown)]
    monkeypatch.setattr(media, "_describer", lambda to_image: lambda batches: (media._batch([rows[v] for v in b.column(1).to_pylist()], media.DESCRIBED) for b in batches if b.num_rows))
    images = spark.createDataFrame([(r[0], k) for k, r in enumerate(rows)], "id long, data int")
    group = {x.image_id: x.group_id for x in media.copy_groups(images, id_column="id", image_column="data", crowd=32).collect()}
    assert group == {i: 1 if i == 2 else i for i in range(40)} | {0: 0}


def test_blocks_report_no_more_links_than_join():
    """A hundred copies that were still apart give 99 links, not one for each pair."""
    bits, places = media.describe(scene(np.random.default_rng(3)))
    rows = [{"bucket": 1, "i": 0, "j": 0, "side": s, "image_id": k, "c": k, "bits": bits.tobytes(), "places": places.tobytes()} for k in range(100) for s in (0, 1)]
    got = media._compare_blocks(media.pa.Table.from_pylist(rows)).to_pylist()
    assert len(got) == 99 and {x for r in got for x in (r["a"], r["b"])} == set(range(100))


def test_no_images(spark):
    images = spark.createDataFrame([(1, bytearray(b"x"))], "id long, data binary")
    assert media.copy_groups(images.where("id > 1"), id_column="id", image_column="data").count() == 0


def test_render():
    assert media.render(None) is None and media.render([1.0] * 64) is None and media.render([1.0, 2.0]) is None and media.render([]) is None
    assert media.render([float("nan")] * 64) is None
    assert media.render(list(range(64))).shape == (48, 48)


def test_colour_pictures():
    grey = media.decode(b"P6 2 1 255\n" + bytes([0, 30, 60, 255, 255, 255]))
    assert grey.tolist() == [[30.0, 255.0]]


def test_strong_crops_of_large_pictures():
    r = np.random.default_rng(5)
    big = []
    for _ in range(2):
        a = np.full((600, 600), 128.0)
        for _ in range(350):
            y, x = r.integers(0, 580, 2)
            a[y : y + r.integers(8, 40), x : x + r.integers(8, 40)] = r.integers(0, 255)
        big.append(media.describe(a))
        crops = [media.describe(a[y : y + 200, x : x + 200]) for y, x in ((0, 0), (200, 200), (380, 150))]
        assert [media.linked(big[-1], c) for c in crops] == [True] * 3
    assert not media.linked(*big) and not media.linked(big[0], crops[0])
