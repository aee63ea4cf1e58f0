"""Staged execution: each stage is written as Parquet and skipped when a finished one of the same plan over the same input is found."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairforge.operators.join import refine
from pairforge.plans.spec import JoinSpec, join_items


def stage_name(name: str, number: int, what: str) -> str:
    return f"{name}-Stage-{number:02d}-{what}"


class StagedRun:
    """Stages live under `workdir`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, workdir: str, spec: JoinSpec):
        self.spark, self.workdir, self.spec = spark, workdir.rstrip("/"), spec.plan()
        self.ran: list[str] = []
        self.digest = self.spec.digest()

    def stage(self, number: int, what: str, make) -> DataFrame:
        path = f"{self.workdir}/{stage_name(self.spec.name, number, what)}"
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_plan")
        fs = done.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not (fs.exists(done) and self.spark.read.text(f"{path}/_plan/digest").first().value == self.digest):
            fs.delete(done, True)
            make().write.mode("overwrite").parquet(f"{path}/data")
            # written last: without it the stage does not count as finished
            self._line(f"{path}/_plan/spec", json.dumps(self.spec.describe(), sort_keys=True))
            self._line(f"{path}/_plan/digest", self.digest)
            self.ran.append(what)
        return self.spark.read.parquet(f"{path}/data")

    def _line(self, path: str, text: str) -> None:
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def run(self, df: DataFrame) -> DataFrame:
        spec, items = self.spec, self.spec.build(df)
        self.digest = spec.digest(df)
        if spec.algorithm == "clone" or spec.handler is not None:
            return self.stage(1, "PartitionJoin", lambda: join_items(items, spec, "clone"))
        candidates = self.stage(1, "PartitionJoin", lambda: join_items(items, spec, "signature"))
        return self.stage(2, "RefinementJoin", lambda: refine(candidates, items, spec.accept_payload, with_payload=spec.with_payload))


def stage_report(replicas: DataFrame) -> DataFrame:
    """Rows for each cell and their share, largest first."""
    counts = replicas.groupBy("cell").agg(F.count("*").alias("n_records"))
    total = counts.agg(F.sum("n_records")).first()[0] or 0
    return counts.withColumn("share", F.col("n_records") / F.lit(max(total, 1))).orderBy(F.desc("n_records"), "cell")
