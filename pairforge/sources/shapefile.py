"""Shapefiles, by the published ESRI description: shapes, attribute rows, and shapes turned into regions.

A .shp holds a 100 byte header and records whose headers are big endian and whose contents are little endian. Files are
read by Spark (`binaryFile`), so any store will do; each file is parsed by one task.
"""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairforge.functions.regions import region_items

#: Fixed values of the format: the plain kind of each shape type, and which types carry z and m.
KINDS = {0: "null", 1: "point", 3: "polyline", 5: "polygon", 8: "multipoint", 11: "point", 13: "polyline", 15: "polygon", 18: "multipoint", 21: "point", 23: "polyline", 25: "polygon", 28: "multipoint", 31: "multipatch"}
WITH_Z = {11, 13, 15, 18, 31}
WITH_M = WITH_Z | {21, 23, 25, 28}
FILE_CODE, VERSION = 9994, 1000
NO_M = -1e39
#: Ids of regions: shape and part share one long.
FIRST_SHAPE, PARTS_PER_SHAPE = 10**10, 10**6
MOST_FILES = 900

SHAPE_SCHEMA = "path string, record int, shape_type int, parts array<int>, x array<double>, y array<double>, z array<double>, m array<double>"


def parse_shape(content: bytes) -> dict:
    """One record's content."""
    kind = struct.unpack_from("<i", content)[0]
    if kind not in KINDS:
        raise ValueError(f"no shape type {kind}")
    out: dict = {"shape_type": kind, "parts": None, "x": [], "y": [], "z": None, "m": None}
    if kind == 0:
        return out
    if KINDS[kind] == "point":
        numbers = struct.unpack_from(f"<{(len(content) - 4) // 8}d", content, 4)
        out |= {"x": [numbers[0]], "y": [numbers[1]]}
        if kind in WITH_Z:
            out["z"] = [numbers[2]]
        if kind in WITH_M and len(numbers) > 2 + (kind in WITH_Z):
            out["m"] = [numbers[-1]]
        return out
    at = 4 + 32
    n_parts = 0
    if KINDS[kind] != "multipoint":
        n_parts, n_points = struct.unpack_from("<2i", content, at)
        at += 8
        out["parts"] = list(struct.unpack_from(f"<{n_parts}i", content, at))
        at += 4 * n_parts * (2 if kind == 31 else 1)
    else:
        n_points = struct.unpack_from("<i", content, at)[0]
        at += 4
    points = struct.unpack_from(f"<{2 * n_points}d", content, at)
    out |= {"x": list(points[::2]), "y": list(points[1::2])}
    at += 16 * n_points
    for name, has in (("z", WITH_Z), ("m", WITH_M)):
        if kind in has and len(content) >= at + 16 + 8 * n_points:
            out[name] = list(struct.unpack_from(f"<{n_points}d", content, at + 16))
            at += 16 + 8 * n_points
    return out


def parse_shp(data: bytes) -> Iterator[dict]:
    if len(data) < 100 or struct.unpack_from(">i", data)[0] != FILE_CODE:
        raise ValueError("not a shapefile")
    at = 100
    while at + 8 <= len(data):
        number, words = struct.unpack_from(">2i", data, at)
        yield {"record": number - 1} | parse_shape(data[at + 8 : at + 8 + 2 * words])
        at += 8 + 2 * words


def parse_shx(data: bytes) -> list[int]:
    """The byte offset of each record."""
    n = (len(data) - 100) // 8
    return [2 * words for words in struct.unpack_from(f">{2 * n}i", data, 100)[::2]]


def parse_fields(data: bytes) -> list[tuple[str, str, int, int]]:
    """(name, type, length, decimals) of a .dbf's fields."""
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    return fields


def field_type(kind: str, length: int, decimals: int) -> str:
    """The SQL type of a field."""
    if kind in "NF":
        return "bigint" if kind == "N" and not decimals and length <= 18 else "double"
    return {"D": "date", "L": "boolean"}.get(kind, "string")


def parse_dbf(data: bytes) -> Iterator[tuple[int, dict[str, str | None]]]:
    """(record, {field: text}) of the rows that are not deleted; numbers and dates as text, `?` as null."""
    count, head, width = struct.unpack_from("<IHH", data, 4)
    fields = parse_fields(data)
    for k in range(count):
        row = data[head + k * width : head + (k + 1) * width]
        if row[:1] == b"*":
            continue
        out, at = {}, 1
        for name, kind, length, _ in fields:
            text = row[at : at + length].decode("latin-1").strip(" \0")
            at += length
            if kind == "D":
                text = datetime.datetime.strptime(text, "%Y%m%d").date().isoformat() if text.strip("0") else ""
            elif kind == "L":
                text = {"Y": "true", "T": "true", "N": "false", "F": "false"}.get(text.upper(), "")
            elif kind in "NF":
                text = text if any(c.isdigit() for c in text) else ""
            out[name] = text or None
        yield k, out


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Every shape of the .shp files under `path`; `record` counts from 0 in each file."""

    def parse(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = pd.DataFrame([{"path": name} | r for r in parse_shp(bytes(data))])
                yield rows if len(rows) else pd.DataFrame(columns=[c.split()[0] for c in SHAPE_SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path)
    return files.select("path", "content").mapInPandas(parse, SHAPE_SCHEMA)


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, attributes) of the .dbf files under `path`; cast the attributes to what the table holds."""

    def parse(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(name, k, row) for k, row in parse_dbf(bytes(data))], columns=["path", "record", "attributes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dbf").load(path)
    return files.select("path", "content").mapInPandas(parse, "path string, record int, attributes map<string,string>")


def read_fields(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, SQL type) of the fields of the .dbf files under `path`; a field of several types is a string."""

    def parse(batches):
        for pdf in batches:
            for data in pdf["content"]:
                yield pd.DataFrame([(k, f[0], field_type(*f[1:])) for k, f in enumerate(parse_fields(bytes(data)))], columns=["place", "name", "type"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dbf").load(path)
    rows = files.select("content").mapInPandas(parse, "place int, name string, type string")
    one = F.when(F.min("type") == F.max("type"), F.min("type")).otherwise("string")
    # a row for each name of a field
    return [(r.name, r.type) for r in rows.groupBy("name").agg(F.min("place").alias("place"), one.alias("type")).orderBy("place", "name").collect()]


def read_table(spark: SparkSession, path: str, fields: list[tuple[str, str]] | None = None) -> DataFrame:
    """(path, record, attributes), the attributes a struct of typed fields; values that their type cannot hold are null.

    `fields` as `read_fields` gives them saves reading the headers first.
    """
    fields = read_fields(spark, path) if fields is None else fields
    typed = [F.col("attributes").getItem(name).try_cast(kind).alias(name) for name, kind in fields]
    return read_attributes(spark, path).select("path", "record", F.struct(*typed).alias("attributes"))


def _bytes(spark: SparkSession, path: str, at: int, n: int) -> bytes | None:
    """`n` bytes of a file from `at` on, None without the file; by Hadoop's file systems, as Spark's own readers."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(file):
        return None
    stream = fs.open(file)
    try:
        stream.seek(at)
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def read_shape(spark: SparkSession, path: str, i: int) -> dict:
    """Shape `i` of one .shp file, from the end if negative: by the .shx beside it, else from a scan of the file."""
    index = path[: -len(".shp")] + ".shx"
    if (head := _bytes(spark, index, 24, 4)) is None:
        shapes = read_shapes(spark, path).drop("path")
        found = shapes.where(F.col("record") == (i if i >= 0 else shapes.count() + i)).first()
        if found is None:
            raise IndexError(i)
        return found.asDict()
    count = (2 * struct.unpack(">i", head)[0] - 100) // 8
    record = i if i >= 0 else count + i
    if not 0 <= record < count:
        raise IndexError(i)
    at = 2 * struct.unpack(">i", _bytes(spark, index, 100 + 8 * record, 4))[0]
    words = struct.unpack(">i", _bytes(spark, path, at + 4, 4))[0]
    return {"record": record} | parse_shape(_bytes(spark, path, at + 8, 2 * words))


def shape_records(shapes: DataFrame, attributes: DataFrame) -> DataFrame:
    """Shapes with the attribute row of the same file and record."""
    stem = lambda c: F.regexp_replace(c, r"\.[A-Za-z]+$", "")
    a = shapes.withColumn("stem", stem(F.col("path")))
    b = attributes.select(stem(F.col("path")).alias("stem"), "record", "attributes")
    return a.join(b, ["stem", "record"], "left").drop("stem")


def shape_regions(shapes: DataFrame) -> DataFrame:
    """Each part of each shape as a region item; shapes without parts give none.

    Ids number the file (in the order of paths), the shape and the part, so that they are unique over several files.
    """
    # a row a file
    order = Window.orderBy("path")
    files = shapes.select("path").distinct().select("path", (F.row_number().over(order) - 1).cast("long").alias("file"))
    fits = F.when((F.col("file") >= MOST_FILES) | (F.col("record") >= FIRST_SHAPE), F.raise_error(F.lit("too many shapefiles for the ids")).cast("long")).otherwise(F.col("file"))
    part = shapes.where(F.size("parts") > 0).join(files, "path").select(fits.alias("file"), "record", "parts", "x", "y", F.posexplode("parts").alias("part", "start"))
    end = F.when(F.col("part") + 1 < F.size("parts"), F.get("parts", F.col("part") + 1)).otherwise(F.size("x"))
    n = end - F.col("start")
    too_many = F.when(F.size("parts") >= PARTS_PER_SHAPE, F.raise_error(F.lit("a shape has too many parts for its ids")).cast("long")).otherwise(F.lit(0).cast("long"))
    return region_items(
        part.where(n > 0).select(
            ((F.lit(FIRST_SHAPE) * (F.col("file") + 1) + F.col("record")) * PARTS_PER_SHAPE + F.col("part") + too_many).alias("id"),
            n.cast("int").alias("num_points"),
            F.slice("x", F.col("start") + 1, n).alias("x"),
            F.slice("y", F.col("start") + 1, n).alias("y"),
        )
    )


def _box(x: list[float], y: list[float]) -> bytes:
    return struct.pack("<4d", min(x), min(y), max(x), max(y))


def _span(values: list[float]) -> bytes:
    return struct.pack("<2d", min(values), max(values)) if values else bytes(16)


def _content(shape: dict, kind: int) -> bytes:
    """One record's content; a shape without points is a null, missing z are 0 and missing m say so."""
    x, y = shape.get("x") or [], shape.get("y") or []
    if not x:
        return struct.pack("<i", 0)
    extra = [shape.get(name) or [default] * len(x) for name, has, default in (("z", WITH_Z, 0.0), ("m", WITH_M, NO_M)) if kind in has]
    if any(len(e) != len(x) for e in extra):
        raise ValueError("a shape needs as many z and m as points")
    if KINDS[kind] == "point":
        if len(x) != 1:
            raise ValueError("a point has one place")
        return struct.pack(f"<i{2 + len(extra)}d", kind, x[0], y[0], *(e[0] for e in extra))
    body = struct.pack("<i", kind) + _box(x, y)
    if KINDS[kind] == "multipoint":
        body += struct.pack("<i", len(x))
    else:
        parts = shape.get("parts") or [0]
        body += struct.pack(f"<2i{len(parts)}i", len(parts), len(x), *parts)
    body += struct.pack(f"<{2 * len(x)}d", *(v for point in zip(x, y, strict=True) for v in point))
    return body + b"".join(_span(e) + struct.pack(f"<{len(e)}d", *e) for e in extra)


def encode_shp(shapes: list[dict], kind: int) -> tuple[bytes, bytes]:
    """The bytes of a .shp and its .shx, of any type but multipatches; z and m where the type has them."""
    if kind not in KINDS or KINDS[kind] == "multipatch":
        raise ValueError(f"shapes of type {kind} cannot be written")
    records, index, at = [], [], 100
    for k, shape in enumerate(shapes):
        body = _content(shape, kind)
        records.append(struct.pack(">2i", k + 1, len(body) // 2) + body)
        index.append(struct.pack(">2i", at // 2, len(body) // 2))
        at += 8 + len(body)
    of = lambda name: [v for s in shapes for v in s.get(name) or []]
    xs, ys = of("x"), of("y")
    box = (_box(xs, ys) if xs else bytes(32)) + (_span(of("z")) if kind in WITH_Z else bytes(16)) + (_span(of("m")) if kind in WITH_M else bytes(16))
    head = lambda size: struct.pack(">7i", FILE_CODE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i", VERSION, kind) + box
    return head(at) + b"".join(records), head(100 + 8 * len(index)) + b"".join(index)


def encode_dbf(fields: list[tuple[str, str, int, int]], rows: list[dict]) -> bytes:
    """The bytes of a .dbf; a field is (name, type, length, decimals)."""
    width = 1 + sum(f[2] for f in fields)
    out = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(fields), width)
    for name, kind, length, decimals in fields:
        out += struct.pack("<11sc4xBB14x", name.encode("latin-1")[:10], kind.encode(), length, decimals)
    out += b"\r"
    for row in rows:
        out += b" "
        for name, kind, length, decimals in fields:
            v = row.get(name)
            if v is None:
                text = "?" if kind == "L" else ""
            elif kind in "NF":
                text = f"{v:.{decimals}f}"
            elif kind == "D":
                text = v.strftime("%Y%m%d")
            elif kind == "L":
                text = "T" if v else "F"
            else:
                text = str(v)
            out += (text.rjust(length) if kind in "NF" else text.ljust(length)).encode("latin-1")[:length]
    return out + b"\x1a"
