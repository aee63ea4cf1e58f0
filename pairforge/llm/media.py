"""Cropped or edited copies of images, by local descriptors.

Corners are found at several scales of an image; each is described by 256 comparisons of smoothed grey values around it,
turned by the patch's own orientation, so that rotation and light don't matter. Descriptors meet through Hamming tables:
a descriptor is eight parts of 32 bits, and each two neighbouring parts, in a circle, are one table's key, so two
descriptors that differ in fewer than four bits share a bucket for certain. Images that meet are compared exactly:
descriptors are matched, each match proposes a shift, turn and scale, and the images are linked if enough matches agree on
one of them. Groups are the components of the links.

Images of equal pixels are one class, whatever they show. Of the first images of its buckets, a class is compared with the
one that it meets most often, so a large group of copies costs one comparison for each member. Then members of a bucket that
are still in different components are compared, in blocks of bounded size, and a block reports no more links than join its
components. A bucket that holds more than `CROWD` components waits: its descriptors meet first by keys that are one part
longer, up to the whole descriptor, which joins most of them, and then what it still holds in different components is
compared like any other, however many there are.

Defined results: null and undecodable images are groups of their own; flat or tiny ones have no corners, and they and such
as have fewer corners than a consensus needs have no links but to images of equal pixels; a null id is in no group; rows
that repeat an id must repeat its image; a large picture keeps all its corners; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairforge.llm.common import discard, importable, written
from pairforge.llm.components import components
from pairforge.llm.kernel import U, mixed

#: Scales; all corners above this share of the strongest are kept at each. Corners described at once, cells of a comparison.
SCALES = (1.0, 0.75, 0.5625)
LEAST_CORNER = 0.01
CORNERS, CELLS = 4096, 1 << 19
RADIUS = 6
TESTS = 256
#: Parts of a descriptor, and how many of them the shortest key has.
PARTS, KEY_PARTS = 8, 2
#: Components of a bucket from which on longer keys go first; images on a side of a block; bytes compared by one call, and those of a corner.
CROWD, SIDE, DEAL_BYTES, CORNER_BYTES = 32, 64, 16 << 20, TESTS // 8 + 16
#: Bits in which matching descriptors may differ; matches that must agree, and their share of the smaller image's corners.
MATCH_BITS = 48
AGREE, AGREE_SHARE = 6, 0.25
#: How far agreeing matches may be apart: in pixels, in the logarithm of scale, in radians.
NEAR_PIXELS, NEAR_SCALE, NEAR_TURN = 3.0, 0.2, 0.35
_spots = np.random.default_rng(256).normal(0, RADIUS / 2.2, (TESTS, 2, 2)).clip(-RADIUS + 1, RADIUS - 1)
_disc = np.stack(np.meshgrid(np.arange(-RADIUS, RADIUS + 1), np.arange(-RADIUS, RADIUS + 1)), -1).reshape(-1, 2)
_disc = _disc[(_disc**2).sum(1) <= RADIUS**2]


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM (P5) or PPM (P6) image of 8 bits; None for anything else."""
    if not data or data[:2] not in (b"P5", b"P6"):
        return None
    numbers, at = [], 2
    while len(numbers) < 3 and at < len(data):
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            return None
        numbers.append(int(data[at:end]))
        at = end
    if len(numbers) < 3 or not 0 < numbers[2] < 256:
        return None
    width, height, depth = numbers[0], numbers[1], 3 if data[:2] == b"P6" else 1
    pixels = np.frombuffer(data, np.uint8, offset=min(at + 1, len(data)))
    if not width * height or len(pixels) < width * height * depth:
        return None
    return pixels[: width * height * depth].reshape(height, width, depth).mean(2)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear."""
    h, w = image.shape
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    rows = image[y0] * (1 - fy) + image[y1] * fy
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def _blur(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2 r + 1; edges repeat. One image or a stack of them."""
    for axis in (-2, -1):
        n = a.shape[axis]
        p = np.take(a, np.clip(np.arange(-r - 1, n + r), 0, n - 1), axis)
        p = np.cumsum(p, axis)
        a = (np.take(p, np.arange(2 * r + 1, n + 2 * r + 1), axis) - np.take(p, np.arange(n), axis)) / (2 * r + 1)
    return a


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(descriptors: n x 32 bytes, places: n x (x, y, log scale, angle)) of an image's corners, strongest first at each scale."""
    bits, places = [], []
    for scale in SCALES:
        h, w = int(round(image.shape[0] * scale)), int(round(image.shape[1] * scale))
        edge = RADIUS + 2
        if min(h, w) <= 2 * edge + 2:
            break
        a = image.astype(float) if scale == 1 else resize(image, h, w)
        dy, dx = np.gradient(a)
        xx, yy, xy = _blur(np.stack([dx * dx, dy * dy, dx * dy]), 2)
        corner = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = corner[edge:-edge, edge:-edge]
        top = inner.max()
        if top <= 1e-9:
            continue
        around = np.max([corner[edge + i : h - edge + i, edge + j : w - edge + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], 0)
        y, x = np.nonzero((inner >= around) & (inner > LEAST_CORNER * top))
        order = np.lexsort((x, y, -inner[y, x]))
        ys, xs = y[order] + edge, x[order] + edge
        smooth = _blur(a, 1)
        for k in range(0, len(ys), CORNERS):
            y, x = ys[k : k + CORNERS], xs[k : k + CORNERS]
            patch = smooth[y[:, None] + _disc[:, 1], x[:, None] + _disc[:, 0]]
            patch = patch - patch.mean(1, keepdims=True)
            angle = np.arctan2((patch * _disc[:, 1]).sum(1), (patch * _disc[:, 0]).sum(1))
            c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            px = np.rint(c * _spots[None, :, :, 0] - s * _spots[None, :, :, 1]).astype(int) + x[:, None, None]
            py = np.rint(s * _spots[None, :, :, 0] + c * _spots[None, :, :, 1]).astype(int) + y[:, None, None]
            v = smooth[py.clip(0, h - 1), px.clip(0, w - 1)]
            bits.append(np.packbits(v[:, :, 0] < v[:, :, 1], axis=1))
            places.append(np.stack([(x + 0.5) / scale, (y + 0.5) / scale, np.full(len(x), -np.log(scale)), angle], 1))
    if not bits:
        return np.zeros((0, TESTS // 8), np.uint8), np.zeros((0, 4), np.float32)
    return np.concatenate(bits), np.concatenate(places).astype(np.float32)


def consensus(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least_of_use: float = 1) -> int:
    """The largest number of matches between two images that agree on one shift, turn and scale; 0 where there are fewer matches than are of use."""
    if not len(a[0]) or not len(b[0]):
        return 0
    best, least, other = np.zeros(len(a[0]), np.int64), np.zeros(len(a[0]), np.int32), np.full(len(b[0]), TESTS + 1, np.int32)
    rows = max(1, CELLS // len(b[0]))
    for k in range(0, len(a[0]), rows):
        apart = sum(np.bitwise_count(a[0].view(U)[k : k + rows, None, word] ^ b[0].view(U)[None, :, word]).astype(np.int32) for word in range(TESTS // 64))
        best[k : k + rows], least[k : k + rows] = apart.argmin(1), apart.min(1)
        other = np.minimum(other, apart.min(0))
    i = np.flatnonzero(least <= MATCH_BITS)
    j = best[i]
    # the match must be the best from either side
    keep = other[j] == least[i]
    i, j = i[keep], j[keep]
    if len(i) < least_of_use:
        return 0
    p, q = a[1][i].astype(float), b[1][j].astype(float)
    grow, turn = q[:, 2] - p[:, 2], q[:, 3] - p[:, 3]
    spots = [(round(u / 4), round(v / 4)) for u, v in p[:, :2].tolist()]
    most, rows = 0, max(1, CELLS // len(i))
    for k in range(0, len(i), rows):
        own = slice(k, k + rows)
        # where each match's transform puts all matched corners of a
        c, s = np.exp(grow[own]) * np.cos(turn[own]), np.exp(grow[own]) * np.sin(turn[own])
        dx, dy = p[None, :, 0] - p[own, None, 0], p[None, :, 1] - p[own, None, 1]
        x = q[own, None, 0] + c[:, None] * dx - s[:, None] * dy
        y = q[own, None, 1] + s[:, None] * dx + c[:, None] * dy
        off = np.hypot(x - q[None, :, 0], y - q[None, :, 1])
        swing = np.abs((turn[None, :] - turn[own, None] + np.pi) % (2 * np.pi) - np.pi)
        agree = (off <= NEAR_PIXELS) & (np.abs(grow[None, :] - grow[own, None]) <= NEAR_SCALE) & (swing <= NEAR_TURN)
        # one corner found at several scales is one witness
        most = max(most, *(len({spots[m] for m in np.flatnonzero(row).tolist()}) for row in agree), 0)
    return most


def linked(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    most = consensus(a, b, AGREE)
    return most >= AGREE and most >= AGREE_SHARE * min(len(np.unique(np.rint(x[1][:, :2] / 4) @ [1, 1 << 20])) for x in (a, b))


def _from_bytes(bits: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(bits, np.uint8).reshape(-1, TESTS // 8), np.frombuffer(places, np.float32).reshape(-1, 4)


DESCRIBED = "image_id long, n_corners long, pixels binary, bits binary, places binary"
PAIRS = "a long, b long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), types, strict=True)], names=names)


def _describer(to_image):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = to_image(value)
                if image is None:
                    rows.append((i, 0, None, b"", b""))
                    continue
                bits, places = describe(image)
                pixels = hashlib.sha256(repr(image.shape).encode() + image.astype(np.float64).tobytes()).digest()
                rows.append((i, len(bits), pixels, bits.tobytes(), places.tobytes()))
            if rows:
                yield _batch(rows, DESCRIBED)

    return run


MET = "bucket long, image_id long, spot int, start int"


def _keys(parts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n parts of each descriptor, in a circle, by the part that they start at."""
    out = np.broadcast_to(np.arange(PARTS, dtype=U) + U(PARTS * n), parts.shape)
    for k in range(n):
        out = mixed(out * U(0x9E3779B97F4A7C15) + np.roll(parts, -k, axis=1).astype(U))
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each descriptor's buckets by the shortest keys, once for each image."""
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for i, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys, one = np.unique(_keys(np.frombuffer(bits, "<u4").reshape(-1, PARTS), KEY_PARTS), return_index=True)
            for x, v in zip(out, (keys.view(np.int64), np.full(len(one), i), one // PARTS, one % PARTS), strict=True):
                x.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["bucket", "image_id", "spot", "start"])


def _meet_again(n: int):
    """Buckets by keys of n parts that hold the given shorter one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, spot, start, bits in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                keys = _keys(np.frombuffer(bits, "<u4").reshape(-1, PARTS)[spot : spot + 1], n)[0]
                # the whole descriptor is one key, wherever it starts
                rows += [(int(keys[at].view(np.int64)), i, spot, at) for at in ({0} if n == PARTS else {start, (start - 1) % PARTS})]
            if rows:
                yield _batch(rows, MET)

    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(6)]
        good = [(a, b) for a, b, x, p, y, q in zip(*columns, strict=True) if linked(_from_bytes(x, p), _from_bytes(y, q))]
        if good:
            yield _batch(good, PAIRS)


def _verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    left = pairs.join(classes.select(F.col("image_id").alias("a"), F.col("bits").alias("x"), F.col("places").alias("p")), "a")
    both = left.join(classes.select(F.col("image_id").alias("b"), F.col("bits").alias("y"), F.col("places").alias("q")), "b")
    return both.select("a", "b", "x", "p", "y", "q").mapInArrow(_agreeing, PAIRS)


def _compare_blocks(table: pa.Table) -> pa.Table:
    """Links between the two sides of each block, as many as join the components that are linked: what is joined already needs no comparison."""
    images: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sides: dict[tuple, tuple[list, list]] = {}
    above: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := above.get(c, c)) != c:
            above[c] = c = above.get(up, up)
        return c

    for r in table.to_pylist():
        images.setdefault(r["image_id"], _from_bytes(r["bits"], r["places"]))
        sides.setdefault((r["bucket"], r["i"], r["j"]), ([], []))[r["side"]].append((r["image_id"], r["c"]))
    pairs = {(min((a, p), (b, q)), max((a, p), (b, q))) for left, right in sides.values() for a, p in left for b, q in right if p != q}
    found = []
    for (a, p), (b, q) in sorted(pairs):
        if (p := top(p)) != (q := top(q)) and linked(images[a], images[b]):
            above[max(p, q)] = min(p, q)
            found.append((a, b))
    return pa.Table.from_batches([_batch(found, PAIRS)])


def _apart(members: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of buckets that hold several components, with the bucket's plan; and the plans."""
    placed = members.join(found, F.col("image_id") == F.col("node"), "left").drop("node").withColumn("c", F.coalesce("component", "image_id")).drop("component")
    parts = placed.groupBy("bucket", "c").agg(F.count("*").alias("n"))
    plans = written(
        parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("core")).where("parts > 1")
        .select("bucket", "parts", F.col("core.c").alias("core"), F.ceil((F.col("n") - F.col("core.n")) / SIDE).alias("rows"), F.ceil(F.col("n") / SIDE).alias("columns"))
    )
    return written(placed.join(plans, "bucket")), plans


def _between(apart: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between different components of a bucket: those outside its largest component against all, block by block."""
    at = apart.withColumns({"i": F.pmod(F.xxhash64("image_id"), "rows"), "j": F.pmod(F.xxhash64("image_id", F.lit(1)), "columns")})
    outer = at.where("c <> core").withColumns({"j": F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)), "side": F.lit(0)})
    inner = at.withColumns({"i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)), "side": F.lit(1)})
    keys = ("bucket", "i", "j", "side", "image_id", "c")
    sides = outer.select(*keys).unionByName(inner.select(*keys))
    times = sides.groupBy("image_id").agg(F.count("*").alias("times"))
    corners = times.join(classes.select("image_id", "n_corners"), "image_id").agg(F.sum(F.col("times") * F.col("n_corners"))).first()[0] or 0
    deal = F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(max(1, -(-corners * CORNER_BYTES // DEAL_BYTES)))).alias("deal")
    dealt = sides.join(classes.select("image_id", "bits", "places"), "image_id")
    return written(dealt.groupBy(deal).applyInArrow(_compare_blocks, PAIRS).distinct())


def copy_groups(images: DataFrame, *, id_column: str, image_column: str, to_image=decode, crowd: int = CROWD) -> DataFrame:
    """image_id, n_corners, class_id (the smallest id of the same pixels) and group_id (the smallest id of its group) of every row."""
    importable(images.sparkSession)
    described = written(images.select(F.col(id_column).cast("long").alias("image_id"), F.col(image_column).alias("image")).mapInArrow(_describer(to_image), DESCRIBED))
    firsts = described.where("image_id IS NOT NULL AND pixels IS NOT NULL").groupBy("pixels").agg(F.min("image_id").alias("class_id"))
    same = written(firsts)
    classes = written(described.where(F.col("n_corners") >= AGREE).join(same.select(F.col("class_id").alias("image_id")), "image_id", "left_semi").dropDuplicates(["image_id"]).select("image_id", "n_corners", "bits", "places"))

    met = written(classes.select("image_id", "bits").mapInArrow(_meet, MET))
    shared = written(met.groupBy("bucket").agg(F.min("image_id").alias("first"), F.max("image_id").alias("last")).where("first < last").select("bucket", "first"))
    members = written(met.join(shared, "bucket"))
    votes = members.where("first < image_id").groupBy("image_id", "first").agg(F.count("*").alias("votes"))
    best = votes.groupBy(F.col("image_id").alias("b")).agg(F.max_by("first", F.struct("votes", -F.col("first"))).alias("a"))
    links = written(_verified(best.select("a", "b"), classes))
    found = components(links)
    discard(met, shared)

    todo, n = members.drop("first"), KEY_PARTS
    used, waiting = [members], None
    while True:
        apart, plans = _apart(todo, found)
        last = n == PARTS
        some = _between(apart if last else apart.where(F.col("parts") <= crowd), classes)
        links = written(links.unionByName(some))
        found = components(links)
        used += [apart, plans, some]
        if last or plans.where(F.col("parts") > crowd).isEmpty():
            break
        n += 1
        # whoever meets by a longer key meets by the shortest, so its crowded buckets hold all that is left
        waiting = apart.where(F.col("parts") > crowd).select(*todo.columns) if waiting is None else waiting
        crowded = apart.where(F.col("parts") > crowd).select("image_id", "spot", "start").join(classes.select("image_id", "bits"), "image_id")
        todo = written(crowded.select("image_id", "spot", "start", "bits").mapInArrow(_meet_again(n), MET).dropDuplicates(["bucket", "image_id"]))
        used.append(todo)
    if waiting is not None:
        apart, plans = _apart(waiting, found)
        some = _between(apart, classes)
        found = components(written(links.unionByName(some)))
        used += [apart, plans, some]
    discard(*used)

    named = described.select("image_id", "n_corners", "pixels").join(same, "pixels", "left").withColumn("class_id", F.when(F.col("image_id").isNotNull(), F.coalesce("class_id", "image_id")))
    return named.join(found, F.col("class_id") == F.col("node"), "left").select("image_id", "n_corners", "class_id", F.coalesce("component", "class_id").alias("group_id"))


def render(vector: list[float] | None, side: int = 48) -> np.ndarray | None:
    """A vector as a grey image: each number weighs a fixed texture of its own, so that it has a say everywhere. None for nulls and vectors without contrast or of under four numbers."""
    if vector is None or len(vector) < 4:
        return None
    v = np.array([np.nan if x is None else x for x in vector], float)
    if not np.isfinite(v).all() or v.max() <= v.min():
        return None
    grey = np.tensordot(v / np.abs(v).max(), _textures(len(v), side), 1)
    return (grey - grey.min()) / (grey.max() - grey.min()) * 255


@functools.cache
def _textures(n: int, side: int) -> np.ndarray:
    """Smoothed noise, the same everywhere."""
    noise = np.random.default_rng(64).normal(size=(n, side + 8, side + 8))
    return _blur(_blur(noise, 1), 1)[:, 4:-4, 4:-4]
