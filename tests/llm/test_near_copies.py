"""The pipeline's near-duplicate stage against every pair of shingle sets."""

import random

import corpus_pipeline
import numpy as np
import plain
import pyarrow as pa
import pytest
from loomframe.llm import near_copies


def _rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    passage = rng.choices(words, k=30)
    texts = [None, "", " ", "one two", "One  two", "one two three four five"]
    for size in (8, 40, 150):
        for _ in range(5):
            base = rng.choices(words, k=size)
            for edits in (0, 0, 1, 2, 3, 5):
                own = list(base)
                for _ in range(edits):
                    own[rng.randrange(size)] = rng.choice(words)
                texts.append(" ".join(own))
    texts += [" ".join(passage + rng.choices(words, k=k % 40)) for k in range(60)]  # one common passage
    crowd = rng.choices(words, k=120)
    for _ in range(70):
        own = list(crowd)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(own))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_against_brute_force(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain.near_copies(rows)
    assert 60 < len(want) < len(rows) - 60
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == want
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def _edited(rng, words, size, kind):
    """A text and a copy, edited as far as a similarity of 0.8 allows or a little less."""
    base = rng.choices(words, k=size)
    shingles, at = max(1, size - 4), rng.randrange(size)
    if kind == "end":
        return base, base + rng.choices(words, k=shingles // 4)
    if kind == "inserted":
        return base, base[:at] + rng.choices(words, k=max(0, shingles // 4 - 8)) + base[at:]
    if kind == "cut":
        return base, base[: size - shingles // 5]
    if kind == "head":
        return base, base[shingles // 5 :]
    own = list(base)
    if kind == "changed":
        own[size - max(1, shingles // 9) :] = rng.choices(words, k=max(1, shingles // 9))
    else:
        for _ in range(max(1, shingles // 45)):
            own[rng.randrange(size)] = rng.choice(words)
    return base, own


def test_recall_of_every_kind_of_edit(spark):
    """Added, inserted, cut and scattered edits of 8 to 5,000 words: nearly all pairs of 0.8 or more are joined, no other."""
    rng, rows, pairs = random.Random(11), [], []
    words = [f"w{k}" for k in range(20_000)]
    for size, many in ((8, 25), (16, 25), (60, 25), (120, 25), (300, 20), (1000, 8), (5000, 3)):
        for kind in ("end", "inserted", "cut", "head", "changed", "scattered"):
            for _ in range(many):
                one, two = _edited(rng, words, size, kind)
                sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (one, two)]
                similar = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
                pairs.append((len(rows), kind, size, similar))
                rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    component = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    wrong = [p for p in pairs if p[3] < 0.8 and component[p[0] + 1] != p[0] + 1]
    due = [p for p in pairs if p[3] >= 0.8]
    missed = [p for p in due if component[p[0] + 1] != p[0]]
    assert not wrong and len(due) > 450 and len(missed) <= 0.03 * len(due)
    for kind in {p[1] for p in due}:
        own = [p for p in due if p[1] == kind]
        assert sum(p in missed for p in own) <= 0.05 * len(own), kind


def test_null_and_repeated_ids(spark):
    base = [f"a{k}" for k in range(60)]
    bridge, far = base[:58], base[:50]
    rows = [(3, " ".join(base)), (None, " ".join(bridge)), (7, " ".join(far)), (7, "else"), (9, "else"), (None, "else"), (1, None)]
    out = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == [1, 3] and sum(r.doc_id is None for r in out) == 2


@pytest.mark.parametrize("together, size", [(4, 3), (4, 7), (256, 100)])
def test_near_members_of_sorted_keys(together, size):
    """Batches cut keys anywhere; members with a near one are kept with their nearest, and all of keys too long for one go."""
    rng = np.random.default_rng(size)
    base = rng.integers(-(2**62), 2**62, (6, 2))
    rows = sorted((int(k), i, *(int(w) for w in base[rng.integers(6)] ^ (1 << rng.integers(0, 60, 2)))) for i, k in enumerate(rng.integers(0, 12, 90)))
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows[a : a + size]], pa.int64()) for c in range(4)], names=["key", "node", "w0", "w1"],
        ) for a in range(0, 90, size)
    ]
    got = {(r["key"], r["node"]): r for b in near_copies._near(together)(iter(batches)) for r in b.to_pylist()}
    distance = lambda x, y: sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(x[2:], y[2:], strict=True))
    for r in rows:
        mates = [m for m in rows if m[0] == r[0] and m is not r]
        near = sorted((distance(r, m), m[1]) for m in mates if distance(r, m) <= near_copies.NEAR)
        if len(mates) + 1 <= together:
            assert ((r[0], r[1]) in got) == bool(near)
            if near:
                assert sorted(
                    zip(got[r[0], r[1]]["distances"], got[r[0], r[1]]["others"], strict=True)
                )[: len(near)] == near[: near_copies.FEW]
        else:
            assert (r[0], r[1]) in got and set(got[r[0], r[1]]["others"]) <= {n for _, n in near}


@pytest.mark.parametrize("together", [2, 16])
def test_stage_with_cut_keys(spark, together, monkeypatch):
    """Keys gone through in small parts lose no link."""
    monkeypatch.setattr(near_copies, "TOGETHER", together)
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == plain.near_copies(rows)
