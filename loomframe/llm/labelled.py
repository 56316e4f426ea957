"""Bounded samples of labelled rows, with the held-out rule that both classifiers share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import scratch


def remainder(id_col: str, folds: int):
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds))


def sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, y, text of at most `rows` labelled documents outside the held-out fold, chosen by the hash of their id.

    Null labels and ids don't count; of repeated labels of an id the largest holds, and of rows that share an id the
    text of smallest hash, so there is one row an id. Null text counts as empty. Written once to scratch.
    """
    known = labels.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"),
    ).where("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.where(remainder("doc_id", folds) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")  # at most `rows` rows of two numbers
    one = found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return scratch(one.select("doc_id", "y", F.col("least.text").alias("text")), f"labelled-{label}")
