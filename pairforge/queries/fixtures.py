"""Items that the queries join, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairforge.functions.regions import region_items


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1: regions of 3 to 8 points, from embeddings."""
    raw = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS id",
        "3 + CAST(vec_id % 6 AS INT) AS num_points",
        "transform(sequence(1, 3 + CAST(vec_id % 6 AS INT)), k -> CAST(embedding[2*k-2] AS DOUBLE) + (vec_id % 25)*0.25D) AS x",
        "transform(sequence(1, 3 + CAST(vec_id % 6 AS INT)), k -> CAST(embedding[2*k-1] AS DOUBLE) + (label  % 5)*0.25D) AS y",
    )
    return region_items(raw)


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: boxes, from part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.expr("struct(CAST(3 + p_partkey % 4 AS INT) AS num_points)").alias("payload"),
        F.expr(
            "struct(p_retailprice - (p_partkey % 7) AS x_min, p_retailprice + 1 + (p_partkey % 5) AS x_max,"
            " p_size - 0.5D * (p_partkey % 3) AS y_min, p_size + 0.5D + 0.5D * (p_partkey % 4) AS y_max)"
        ).alias("signature"),
    )


def text_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 with two points and coordinates in halves, which six decimals hold exactly."""
    return region_items(
        table(spark, sf_dir, "part").selectExpr(
            "p_partkey AS id", "2 AS num_points",
            "array(CAST(p_partkey % 100 AS DOUBLE), (p_partkey % 100) + 1.5D) AS x",
            "array(p_size - 0.5D * (p_partkey % 3), p_size + 0.5D + 0.5D * (p_partkey % 4)) AS y",
        )
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("payload"), F.col("c_nationkey").alias("signature"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("payload"), F.struct("lang", "n_chars").alias("signature"))
