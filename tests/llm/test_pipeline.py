"""The pipeline: run() against the stages in plain Python, and each stage on awkward rows."""

from collections import Counter

import corpus_pipeline
import plain
import pytest
from pyspark.sql import functions as F

from loomframe.llm import packing, quality, simhash, toxicity


def test_run_against_plain_python(spark, data):
    from tokenizers import Tokenizer

    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    known = {r.doc_id: r for r in labels.collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.fit(docs, labels)
    good = [i for i, r in rows.items() if plain.quality_score(model, r.text) >= 0.7]
    scores = plain.toxicity_scores({i: rows[i].text for i in good}, {i: r.toxic for i, r in known.items() if r.toxic is not None})
    assert not any(tie and abs(score - 0.5) < 0.1 for score, _, tie in scores.values())
    clean = sorted(i for i in good if scores[i][0] < 0.5)
    texts = dict(zip(clean, (t for t, _, _ in plain.drop_lines([(rows[i].source, rows[i].text) for i in clean])), strict=True))
    kept = plain.near_copies(list(texts.items()))
    assert len(rows) > len(good) >= len(clean) > len(kept) > 50
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    want = sorted(p for i in kept for p in plain.pieces(tokenizer, i, texts[i]))
    packed = corpus_pipeline.run(spark, data).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(p[3] for p in want) // 1024) * 1.02 + 1
    judged = [r for i, r in known.items() if i in rows and r.quality == 1 and r.toxic == 0]
    assert sum(r.doc_id in set(clean) for r in judged) > 0.95 * len(judged)  # clean documents stay


EXTRA = "score AS score", "doc_id AS __id", "doc_id AS component_id", "source AS host", "text AS line", "1 AS n_lines", "2 AS n_dropped", "3 AS rid", "4 AS __DROP", "5 AS length", "6 AS __lines", "7 AS __n_dropped"


@pytest.fixture(scope="module")
def awkward(spark, data):
    """Nulls in every column, empty and long texts, repeated rows, clashing names, beside documents."""
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 60")
    odd = [
        (None, None, None, None, None),
        (1000, None, "en", "x", 0),
        (1001, "", None, "x", 0),
        (1002, " \n\t", "en", None, 3),
        (1003, "word " * 30000, "en", "x", 150000),
    ]
    odd += [(1004, "only\nlines\n\nhere", "en", "x", 16)] * 3 + [(None, "text of no id that is long enough", "en", "x", 33)] * 2 + [(None, None, None, None, None)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    return rows.withColumn("score", F.lit(1)).selectExpr("*", *EXTRA[1:])


def _bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, data, awkward, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, awkward, data)
    empty = stage(spark, awkward.limit(0), data)
    assert empty.count() == 0
    if name == "best_fit_packing":
        assert out.columns == empty.columns and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
        assert out.select("doc_id").distinct().count() == awkward.select("doc_id").distinct().count()
        return
    assert out.columns == awkward.columns == empty.columns
    key = ["doc_id", "source", "lang", *(["text", "line"] if name != "line_dedup" else ["line"])]
    if name == "line_dedup":
        assert out.count() == awkward.count()
        texts = {(r.doc_id, r.line): r for r in out.collect()}
        assert texts[1000, None].text is None and texts[1001, ""].text == "" and texts[1002, " \n\t"].n_chars == 3
        assert all(r.n_lines == 1 and r.n_dropped == 2 and r.host == r.source for r in texts.values())
    assert not _bag(out.select(*key)) - _bag(awkward.select(*key))  # rows pass unchanged
    if name == "simhash_near_dedup":
        assert out.where("doc_id = 1004").count() == 1  # of rows that share an id one stays
        assert out.where("doc_id IS NULL").count() == awkward.where("doc_id IS NULL").count()
        assert out.where("doc_id IN (1000, 1001, 1002)").count() == 1  # texts without words are one group


def test_filters_on_odd_tables(spark, awkward, data):
    """keep_good, keep_clean and keep_one_of_each: no labels, null labels, repeated labels; equal texts go together."""
    labels = spark.createDataFrame(
        [(1, None, None), (2, 1, 0), (2, 0, 1), (None, 1, 1), (99999, 1, 0)], "doc_id long, quality int, toxic int",
    )
    for some in (labels, labels.limit(0), spark.read.parquet(f"{data}/labels.parquet")):
        for keep in (quality.keep_good, toxicity.keep_clean):
            out = keep(awkward, some)
            assert out.columns == awkward.columns and out.where("doc_id = 1004").count() in (0, 3)
            assert not _bag(out) - _bag(awkward)
            assert keep(awkward.limit(0), some).count() == 0
    one = simhash.keep_one_of_each(awkward)
    assert one.columns == awkward.columns and not _bag(one) - _bag(awkward) and one.where("doc_id = 1004").count() == 1
    assert one.where("doc_id IS NULL").count() == awkward.where("doc_id IS NULL").count()
    assert simhash.keep_one_of_each(awkward.limit(0)).count() == 0
