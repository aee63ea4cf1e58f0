"""The queries of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairforge.llm import decontaminate, jaccard, langid, lm, media, mix, quality, shard, substrings, toxicity
from pairforge.llm.common import table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_report(table(spark, sf_dir, "documents"))


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard(table(spark, sf_dir, "documents"), 40)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.langid_report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the given tables hold no images, so the vectors of `embeddings` stand in as mixtures of fixed textures
    groups = media.copy_groups(table(spark, sf_dir, "embeddings"), id_column="vec_id", image_column="embedding", to_image=media.render)
    return groups.withColumnRenamed("image_id", "vec_id")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix, op2_shard, op3_substrings, op4_langid, op5_quality, op6_decontaminate, op7_toxicity, op8_media, op9_lm, op10_jaccard, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {}
