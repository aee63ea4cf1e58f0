"""A generator of region lines: triangles whose ids begin anew in every split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def synthetic_regions(spark: SparkSession, splits: int = 3, records: int = 10) -> DataFrame:
    """(key, value) with key -1 and lines `k,3,0,0,1,0,1,1`."""
    rows = spark.range(0, splits * records, 1, splits)
    return rows.select(F.lit(-1).cast("long").alias("key"), F.concat((F.col("id") % records).cast("string"), F.lit(",3,0,0,1,0,1,1")).alias("value"))
