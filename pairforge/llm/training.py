"""Bounded samples of labelled documents, on which models are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairforge.llm.common import uniform


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, column: str, fold: tuple[int, int], id_column: str = "doc_id") -> DataFrame:
    """(doc_id, label) of rows that may be learned from: label 0 or 1, and the id not in the held-out fold."""
    rows = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return rows.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), fold[0]) != fold[1]))


def sample(docs: DataFrame, rows: DataFrame, per_class: int, *, id_column: str = "doc_id", text_column: str = "text") -> tuple[list[tuple[int, object, str]], dict]:
    """At most `per_class` documents of each label as (doc_id, label, whole text), and each label's count.

    rows: (doc_id, label). The choice depends on ids alone, so reruns agree. The rows that reach the driver are bounded by
    `per_class` and the number of labels. Copies of a text count once; null texts are not chosen; an empty table gives no rows.
    """
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], {}
    # each label's share, a little more than what is wanted, by a draw from the id
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == F.lit(label), F.lit(min(1.0, 1.1 * per_class / n + 10 / n))).otherwise(share)
    draw = uniform(F.lit(5), F.col("doc_id"))
    picked = rows.withColumn("draw", draw).where(F.col("draw") < share)
    picked = picked.orderBy("draw", "doc_id", "label").limit(int(len(counts) * (1.5 * per_class + 60)))
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).where(F.col("text").isNotNull())
    # the sample's ids are bounded by the parameters
    got = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text", "draw").collect()
    out, seen, used = [], set(), dict.fromkeys(counts, 0)
    for r in sorted(got, key=lambda r: (r.draw, r.doc_id, str(r.label), r.text)):
        if used[r.label] < per_class and (r.label, r.text) not in seen:  # copies teach nothing new
            seen.add((r.label, r.text))
            used[r.label] += 1
            out.append((r.doc_id, r.label, r.text))
    return out, counts
