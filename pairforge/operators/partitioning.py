"""Assigning items to cells, their statistics, splitting large cells, and what comparing them costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def replicate(items: DataFrame, cells: Column) -> DataFrame:
    """One row for each item and cell. Items with no cell go."""
    return items.withColumn("cell", F.explode(cells))


def partition_counts(replicas: DataFrame, *, sub: str | None = None) -> DataFrame:
    """(cell[, sub], n_records)."""
    return replicas.groupBy("cell", *[sub] * (sub is not None)).agg(F.count("*").alias("n_records"))


def salted(replicas: DataFrame, k: int, salt: Column | None = None) -> DataFrame:
    """Splits every cell into k parts by `salt` (a hash of the id by default)."""
    return replicas.withColumn("sub", F.pmod(F.xxhash64("id") if salt is None else salt, F.lit(k)).cast("long"))


def split_sizes(counts: DataFrame, target: int, slop: float = 1.1) -> DataFrame:
    """`counts` with n_splits: parts of `target` rows, of which the last may hold up to `slop` times as many."""
    return counts.withColumn("n_splits", F.greatest(F.lit(1), F.ceil(F.col("n_records") / F.lit(target) - F.lit(slop - 1))).cast("long"))


def salted_by_size(replicas: DataFrame, splits: DataFrame, *, keep: bool = False) -> DataFrame:
    """Splits each cell into the number of parts that `split_sizes` gives it, so that small cells stay whole. With `keep` n_splits stays."""
    out = replicas.join(splits.select("cell", "n_splits"), "cell").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("n_splits")))
    return out if keep else out.drop("n_splits")


def split_pairs(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Expands pairs of cells into pairs of their parts; pairs that name a cell without items go.

    A cell with itself gives each unordered pair of parts once, two cells give the full product. `pairs` and `parts` are
    statistics, with a row for each compared pair and for each part.
    """
    left = parts.select(F.col("cell").alias("cell_l"), F.col("sub").alias("sub_l"), F.col("n_records").alias("n_l"))
    right = parts.select(F.col("cell").alias("cell_r"), F.col("sub").alias("sub_r"), F.col("n_records").alias("n_r"))
    return pairs.join(left, "cell_l").join(right, "cell_r").where((F.col("cell_l") != F.col("cell_r")) | (F.col("sub_l") <= F.col("sub_r"))).select(
        "cell_l", "sub_l", "cell_r", "sub_r", "n_l", "n_r"
    )


def pair_costs(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows read and comparisons made for each pair of cells."""
    left = counts.select(F.col("cell").alias("cell_l"), F.col("n_records").alias("n_l"))
    right = counts.select(F.col("cell").alias("cell_r"), F.col("n_records").alias("n_r"))
    own = F.col("cell_l") == F.col("cell_r")
    return pairs.join(left, "cell_l").join(right, "cell_r").select(
        "cell_l",
        "cell_r",
        F.when(own, F.col("n_l")).otherwise(F.col("n_l") + F.col("n_r")).alias("io_cost"),
        F.when(own, F.expr("n_l * (n_l - 1) div 2")).otherwise(F.col("n_l") * F.col("n_r")).alias("cpu_cost"),
    )
