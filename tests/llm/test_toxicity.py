"""Toxicity: the index and the whole query against brute force, calibration, evidence."""

import math
from collections import Counter

import numpy as np
import plain
import pytest

from loomframe.llm import toxicity
from loomframe.llm.toxicity import BlockMaxIndex, Vectors


def _vectors(counts):
    starts = np.concatenate(([0], np.cumsum([len(c) for c in counts], dtype=np.int64)))
    return Vectors(starts, np.array([t for c in counts for t in c], np.int32), np.array([n for c in counts for n in c.values()], np.int32))


def _unit(counts, weight):
    v = {t: (1 + math.log(n)) * weight[t] for t, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in v.values()))
    return {t: w / norm for t, w in v.items()}


@pytest.mark.parametrize("patience", [0, 6, 10_000])
def test_nearest_is_exact_by_blocks_and_by_all(patience):
    rng = np.random.default_rng(4)
    examples = [Counter(rng.integers(0, 60, rng.integers(0, 9)).tolist()) for _ in range(700)]
    weight = rng.uniform(0.05, 3, 60)
    index = BlockMaxIndex(np.arange(700), rng.integers(0, 2, 700), _vectors(examples), weight, block=16)
    every = {i: _unit(c, weight) for i, c in enumerate(examples) if c}
    texts = [Counter(rng.integers(0, 60, rng.integers(0, 9)).tolist()) for _ in range(80)]
    for c, (at, dots) in zip(texts, index.nearest(_vectors(texts), 10, patience), strict=True):
        own = _unit(c, weight) if c else {}
        want = {i: sum(w * v.get(t, 0) for t, w in own.items()) for i, v in every.items()}
        best = sorted((s for s in want.values() if s > 0), reverse=True)[:10]
        assert dots.tolist() == pytest.approx(best, abs=1e-9)
        assert [want[i] for i in index.ids[at]] == pytest.approx(best, abs=1e-9)


def test_query_against_brute_force(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = plain.toxicity_scores(texts, {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None})
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert got.keys() == texts.keys()
    for i, (score, similarities, tie) in want.items():
        assert got[i].similarities == pytest.approx(similarities, abs=1e-9)
        assert got[i].held_out == (plain.fold(i, 5) == 0)
        if not tie:  # a tie at the last place may fall either way
            assert got[i].score == pytest.approx(score, abs=1e-9) and got[i].predicted == (score >= 0.5)
    assert sum(bool(similarities) for _, similarities, _ in want.values()) > 0.9 * len(texts)


def test_scores_are_calibrated_and_explained(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    out = toxicity.toxicity_scores(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id", "left").collect()
    assert sum(bool(r.neighbours) for r in out) > 0.99 * len(out) == 9900
    held = [r for r in out if r.held_out and r.toxic is not None]
    for low, high in ((0.0, 0.2), (0.2, 0.8), (0.8, 1.01)):  # reliability: mean score against share of label 1
        part = [r for r in held if low <= r.score < high]
        if len(part) >= 10:
            assert abs(np.mean([r.score for r in part]) - np.mean([r.toxic for r in part])) < 0.15
    assert np.mean([(r.score - r.toxic) ** 2 for r in held]) < 0.03  # Brier score; the base rate alone gives 0.10
    caught = [r for r in held if r.toxic and r.predicted]
    assert len(caught) >= 85 and sum(r.predicted for r in held if not r.toxic) <= 15
    assert all(r.evidence and set(r.evidence) <= set(toxicity.words_of(t)) for r, t in zip(caught, _texts(docs, caught), strict=True))


def _texts(docs, rows):
    known = {r.doc_id: r.text for r in docs.where(docs.doc_id.isin([r.doc_id for r in rows])).collect()}
    return [known[r.doc_id] for r in rows]


def test_sample_has_one_row_an_id(spark):
    docs = spark.createDataFrame(
        [(1, "a"), (1, "b"), (1, None), (2, "c"), (None, "d"), (3, None)] + [(1, "a")] * 50, "doc_id long, text string",
    )
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (None, 1), (4, None), (9, 1)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, "toxic", 10_000, 1, 3)
    assert got.count() <= 3 and got.count() == got.select("doc_id").distinct().count()
    whole = {r.doc_id: (r.y, r.text) for r in toxicity.sample(docs, labels, "toxic", 10_000, 1, 100).collect()}
    assert whole.keys() == {1, 2, 3} and whole[1][0] == 1 and whole[2] == (0, "c") and whole[3] == (1, "")
