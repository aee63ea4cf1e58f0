"""A uniform grid over the items' extent, which turns an overlap join into an equality join on the cell."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Strips on each axis, and the share of the width and height added on each side.
DEFAULT_STRIPS = 3
PADDING = 0.001


def extent(items: DataFrame, strips: int = DEFAULT_STRIPS) -> DataFrame:
    """One row (strips, x_min, x_max, y_min, y_max), padded, of the finite coordinates; 0 where an axis has none. All null but strips for no items."""
    s = F.col("signature")

    def end(of, low: Column, high: Column) -> Column:
        # the other end of a box that is open at one side is still a place
        finite = [F.when(F.abs(v) < F.lit(float("inf")), v) for v in (low, high)]
        return F.coalesce(of(F.least(*finite) if of is F.min else F.greatest(*finite)), F.when(F.count(low) > 0, F.lit(0.0)))

    raw = items.agg(end(F.min, s.x_min, s.x_max).alias("a"), end(F.max, s.x_min, s.x_max).alias("b"), end(F.min, s.y_min, s.y_max).alias("c"), end(F.max, s.y_min, s.y_max).alias("d"))
    w, h = (F.col("b") - F.col("a")) * PADDING, (F.col("d") - F.col("c")) * PADDING
    return raw.select(
        F.lit(strips).alias("strips"), (F.col("a") - w).alias("x_min"), (F.col("b") + w).alias("x_max"), (F.col("c") - h).alias("y_min"), (F.col("d") + h).alias("y_max")
    )


@dataclass(frozen=True)
class Grid:
    """The index as plain numbers: five values, whatever the size of the data."""

    strips: int
    x_min: float
    x_max: float
    y_min: float
    y_max: float

    @classmethod
    def of(cls, items: DataFrame, strips: int = DEFAULT_STRIPS) -> Grid | None:
        """Reads one aggregated row; None for no items."""
        row = extent(items, strips).first()
        return None if row.x_min is None else cls(*row)

    @classmethod
    def from_text(cls, line: str) -> Grid:
        n, *bounds = line.strip().split(",")
        return cls(int(n), *map(float, bounds))

    def to_text(self) -> str:
        return ",".join(map(str, (self.strips, self.x_min, self.x_max, self.y_min, self.y_max)))

    def save(self, spark: SparkSession, path: str) -> None:
        """One line in a text folder, by Spark's writer, so any store will do."""
        spark.createDataFrame([(self.to_text(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Grid:
        return cls.from_text(spark.read.text(path).first().value)

    def _index(self, v: Column, low: float, high: float) -> Column:
        """Column or row of a coordinate, clamped, so items outside the extent, also infinite ones, share the outermost cells."""
        if high == low:
            return F.lit(0)
        v = F.least(F.greatest(v, F.lit(low)), F.lit(high))
        at = ((v - F.lit(low)) * F.lit(float(self.strips)) / F.lit(high - low)).cast("int")
        return F.least(F.greatest(at, F.lit(0)), F.lit(self.strips - 1))

    def column(self, x: Column) -> Column:
        return self._index(x, self.x_min, self.x_max)

    def row(self, y: Column) -> Column:
        return self._index(y, self.y_min, self.y_max)

    def cell(self, x: Column, y: Column) -> Column:
        """Row-major from the bottom left."""
        return (self.row(y) * self.strips + self.column(x)).cast("long")

    def cells(self, signature: Column) -> Column:
        """Every cell that the box touches, as array<bigint>."""
        columns = F.sequence(self.column(signature.x_min), self.column(signature.x_max))
        rows = F.sequence(self.row(signature.y_min), self.row(signature.y_max))
        return F.flatten(F.transform(rows, lambda j: F.transform(columns, lambda i: (j * self.strips + i).cast("long"))))

    def reference_cell(self, left: str, right: str) -> Column:
        """The one cell in which two overlapping boxes are reported: that of the lower left corner of what they share."""
        a, b = F.col(f"{left}.signature"), F.col(f"{right}.signature")
        return self.cell(F.greatest(a.x_min, b.x_min), F.greatest(a.y_min, b.y_min))


def cell_pairs(spark: SparkSession, strips: int = DEFAULT_STRIPS) -> DataFrame:
    """The cells to compare: each with itself, its right neighbour and its upper neighbour (3n^2 - 2n pairs)."""
    n = strips
    to = F.array(
        F.col("id"),
        F.when(F.col("id") % n < n - 1, F.col("id") + 1),
        F.when(F.col("id") < n * (n - 1), F.col("id") + n),
    )
    return spark.range(n * n).select(F.col("id").alias("cell_l"), F.explode(F.array_compact(to)).alias("cell_r"))
