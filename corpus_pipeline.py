"""Corpus pipeline: quality, toxicity, boilerplate lines, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; all but
the last return the columns of documents. Between stages the rows are written as Parquet and read again.

In every stage a null text counts as empty (and stays null), rows whose id is null or repeated are rows like others
except where a stage says so, columns beside doc_id, text, source and n_chars pass through unread whatever their names,
and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import line_dedup, near_copies, packing, quality, simhash, toxicity
from loomframe.llm.common import drop_scratch, scratch, scratch_tables, table, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.7) go. Equal texts have equal scores."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go. Equal texts have equal scores."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), threshold=0.5)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of their source's documents go; every document stays, with its new length.

    Null sources are one source. A document that loses all its lines stays with an empty text.
    """
    lines, dropped = unused(docs.columns, "__n_lines", "__n_dropped")
    cleaned = line_dedup.drop_boilerplate(docs, host_col="source", ratio=0.1, added=(lines, dropped))
    return cleaned.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more over five-word shingles the smallest id stays.

    Candidates come from Golay keys of a SimHash and of a fingerprint of least shingles. Texts without words are one group. Of rows that share an
    id and stay, one stays; rows with a null id stay.
    """
    return simhash.keep_one_of_each(docs, groups=near_copies.near_copies)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, packed into sequences; an empty text is its end id alone."""
    return packing.pack(docs, capacity=1024, end_id=2)


STAGES = [
    ("quality_classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("best_fit_packing", packing_stage),
]

#: Tokenisation, learned models and Golay keys have no SQL; tests hold each stage's result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table. What a stage has written is deleted once the next one's rows are."""
    docs = table(spark, sf_dir, "documents")
    before = len(scratch_tables(spark))
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
        drop_scratch(spark, since=before, keep=scratch_tables(spark)[-1:])
    return STAGES[-1][1](spark, docs, sf_dir)
