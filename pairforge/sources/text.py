"""Text, partition and statistics files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairforge.functions.regions import parse_region
from pairforge.functions.text import id_pair_text, item_text, mbr_text, parse_id_pair, partition_id_text, region_text

#: Where a partition lies, with the types.
SUMMARY = {"file": "string", "start": "long", "length": "long"}


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return parse_region(spark.read.text(path))


def write_pairs(pairs: DataFrame, left: str, right: str, path: str) -> None:
    """Two text columns as `left TAB right` lines."""
    pairs.select(F.concat_ws("\t", left, right).alias("value")).write.text(path)


def write_partitions(replicas: DataFrame, path: str) -> None:
    """Parquet with a folder for each cell."""
    replicas.repartition("cell").write.partitionBy("cell").parquet(path)


def dump_partition(spark: SparkSession, path: str, to: str | None = None) -> DataFrame:
    """The items of partitions stored under `path` as item text in a column `value`; with `to` also written there as text."""
    items = spark.read.parquet(path)
    payload = region_text(F.col("payload")) if "payload" in items.columns else None
    signature = mbr_text(F.col("signature")) if "signature" in items.columns else None
    text = items.select(item_text(F.col("id"), payload, signature).alias("value"))
    if to is not None:
        text.write.text(to)
    return text


def partition_files(spark: SparkSession, path: str) -> DataFrame:
    """(cell, file, start, length, n_records) of the files that `write_partitions` left under `path`."""
    rows = spark.read.parquet(path).select("cell", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length"))
    whole = rows.groupBy("cell", "file").agg(F.max("length").alias("length"), F.count("*").alias("n_records"))
    return whole.select("cell", "file", F.lit(0).cast("long").alias("start"), "length", "n_records")


def write_summary(counts: DataFrame, path: str) -> None:
    """Statistics as CSV with a header: id, where they are known file, start and length, and n_records."""
    where = [c for c in SUMMARY if c in counts.columns]
    counts.select(partition_id_text(F.col("cell")).alias("id"), *where, "n_records").write.csv(path, header=True)


def read_summary(spark: SparkSession, path: str, *, folder: str | None = None) -> DataFrame:
    """What `write_summary` wrote; with `folder`, files that are not absolute are looked for there by their last name."""
    raw = spark.read.csv(path, header=True)
    where = [F.col(c).cast(kind).alias(c) for c, kind in SUMMARY.items() if c in raw.columns]
    rows = raw.select("id", *where, F.col("n_records").cast("long").alias("n_records"))
    if folder is None or "file" not in rows.columns:
        return rows
    beside = F.concat(F.lit(folder.rstrip("/") + "/"), F.substring_index("file", "/", -1))
    return rows.withColumn("file", F.when(F.col("file").rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), F.col("file")).otherwise(beside))


def write_cell_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select(id_pair_text(partition_id_text(F.col("cell_l")), partition_id_text(F.col("cell_r"))).alias("value")).write.text(path)


def read_cell_pairs(spark: SparkSession, path: str) -> DataFrame:
    return parse_id_pair(spark.read.text(path)).select("cell_l", "cell_r")


def records_by_split(df: DataFrame) -> DataFrame:
    """Rows in each input partition."""
    return df.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("n_records"))
