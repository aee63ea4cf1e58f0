"""What a task holds of the texts at once does not depend on how many there are."""

import os

import pyarrow as pa
import pytest

from pairforge.llm import decontaminate, jaccard, quality
from pairforge.llm.common import FREED, HELD, small_batches

BENCH, LABELS = "item_id long, text string", "doc_id long, quality int"
OPERATORS = {
    "decontaminate": lambda spark, docs: decontaminate.leaks(docs, spark.createDataFrame([(1, "one two three four five")], BENCH)),
    "jaccard": lambda spark, docs: jaccard.similar_groups(docs),
    "quality": lambda spark, docs: quality.keep_good(docs, spark.createDataFrame([(1, 1)], LABELS)),
}


def held(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([os.environ.get("MALLOC_MMAP_THRESHOLD_")])], names=["bytes", "freed"])


@pytest.mark.parametrize("name", OPERATORS)
def test_small_batches(spark, name):
    for key in HELD:
        spark.conf.unset(key)
    OPERATORS[name](spark, spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"))
    texts = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text")  # 30 MB in one partition
    got = texts.mapInArrow(held, "bytes long, freed string").collect()
    assert max(r.bytes for r in got) < 5 << 20 and sum(r.bytes for r in got) > 30_000_000
    assert {r.freed for r in got} == {FREED["MALLOC_MMAP_THRESHOLD_"]}


def test_smaller_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "1m")
    small_batches(spark)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)
