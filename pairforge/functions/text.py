"""Text forms of boxes, regions, items and partition ids, for dumps and exchange files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

__all__ = ["dump_to_region_text", "id_pair_text", "item_text", "mbr_text", "parse_id_pair", "parse_partition_id", "partition_id_text", "region_line", "region_text"]

#: Fixed value: the sub id that stands for a whole partition.
WHOLE = 0x7FFFFFFFFFFFFFFF


def mbr_text(signature: Column) -> Column:
    return F.format_string("%f,%f,%f,%f", signature.x_min, signature.x_max, signature.y_min, signature.y_max)


def _points(payload: Column) -> Column:
    return F.arrays_zip(payload.x.alias("x"), payload.y.alias("y"))


def region_text(payload: Column) -> Column:
    """`[n],(x,y),...`."""
    points = F.transform(_points(payload), lambda p: F.format_string("(%f,%f)", p.x, p.y))
    return F.concat_ws(",", F.format_string("[%d]", payload.num_points), points)


def item_text(id_: Column, payload: Column | None = None, signature: Column | None = None) -> Column:
    """`[IPS],,{id},,{payload},,{signature}` with the absent parts left out of both the tag and the text."""
    tag = "I" + "P" * (payload is not None) + "S" * (signature is not None)
    parts = [id_.cast("string")] + [x for x in (payload, signature) if x is not None]
    return F.concat_ws(",,", F.lit(f"[{tag}]"), *[F.concat(F.lit("{"), p, F.lit("}")) for p in parts])


def region_line(id_: Column, payload: Column) -> Column:
    """The exchange line `id,n,x1,y1,...`."""
    points = F.transform(_points(payload), lambda p: F.format_string("%f,%f", p.x, p.y))
    return F.concat_ws(",", id_.cast("string"), payload.num_points.cast("string"), points)


def dump_to_region_text(dump: Column) -> Column:
    """An item dump that carries its payload, back as an exchange line. For looking at: `%f` has lost digits."""
    parts = F.split(dump, ",,", -1)
    return F.concat_ws(",", F.translate(parts[1], "{}", ""), F.translate(parts[2], "{}[]()", ""))


def partition_id_text(cell: Column, sub: Column | None = None) -> Column:
    return F.format_string("%016X-%016X", cell.cast("long"), F.lit(WHOLE) if sub is None else sub.cast("long"))


def _hex_to_long(text: Column) -> Column:
    """16 hexadecimal digits as a signed long."""
    high, low = F.conv(F.substring(text, 1, 8), 16, 10).cast("long"), F.conv(F.substring(text, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def parse_partition_id(text: Column) -> Column:
    """struct(cell, sub)."""
    return F.struct(_hex_to_long(F.substring(text, 1, 16)).alias("cell"), _hex_to_long(F.substring(text, 18, 16)).alias("sub"))


def id_pair_text(left: Column, right: Column) -> Column:
    return F.concat_ws(",", left, right)


def parse_id_pair(df: DataFrame, column: str = "value") -> DataFrame:
    """Lines `idHex,idHex` as (cell_l, sub_l, cell_r, sub_r)."""
    side = F.split(F.col(column), ",")
    ids = df.select(parse_partition_id(side[0]).alias("l"), parse_partition_id(side[1]).alias("r"))
    return ids.select(F.col("l.cell").alias("cell_l"), F.col("l.sub").alias("sub_l"), F.col("r.cell").alias("cell_r"), F.col("r.sub").alias("sub_r"))
