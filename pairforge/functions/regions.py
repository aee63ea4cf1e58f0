"""Regions: points as a payload, the bounding box as a signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

__all__ = ["mbr", "parse_region", "region_items", "usable_regions"]


def mbr(x: Column, y: Column) -> Column:
    """The bounding box of the points; nulls for a region without points."""
    return F.struct(
        F.array_min(x).alias("x_min"), F.array_max(x).alias("x_max"), F.array_min(y).alias("y_min"), F.array_max(y).alias("y_max")
    )


def region_items(df: DataFrame) -> DataFrame:
    """Columns id, num_points, x and y as items (id, payload, signature)."""
    return df.select(
        "id", F.struct(F.col("num_points"), F.col("x"), F.col("y")).alias("payload"), mbr(F.col("x"), F.col("y")).alias("signature")
    )


def parse_region(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text `id,n,x1,y1,...,xn,yn` as items.

    Fields past the n-th point are ignored. A line with too few fields, or a field that is no number, fails the query.
    """
    cut = lines.select(F.split(F.col(column), ",", -1).alias("f"))
    n = F.col("f")[1].cast("int")
    points = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    # element_at with an index past the end raises under ANSI mode, which is what a short line should do
    return region_items(
        cut.select(
            F.col("f")[0].cast("long").alias("id"),
            n.alias("num_points"),
            F.transform(points, lambda k: F.element_at("f", 2 * k + 1).cast("double")).alias("x"),
            F.transform(points, lambda k: F.element_at("f", 2 * k + 2).cast("double")).alias("y"),
        )
    )


def usable_regions(items: DataFrame) -> DataFrame:
    """Items that can overlap anything: at least one point and no NaN in the box."""
    s = F.col("signature")
    bad = F.isnan(s.x_min) | F.isnan(s.x_max) | F.isnan(s.y_min) | F.isnan(s.y_max)
    return items.where((F.col("payload.num_points") > 0) & ~bad)
