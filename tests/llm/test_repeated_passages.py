"""Repeated passages against a dictionary of all strings of the length."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomframe.llm import queries, repeated_passages


def plain(texts, length):
    """(bytes, removed, spans, digest) of each text by looking at every string."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df, **options):
    rows = repeated_passages.remove_repeats(df, with_kept=True, **options).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)
    return [(r.doc_id, r.n_bytes, sum(e - s for s, e in zip(r.starts, r.ends, strict=True)), len(r.starts), r.kept_sha256) for r in rows]


def test_covers_hold_every_difference():
    for period, cover in repeated_passages.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("length, hot", [(400, repeated_passages.HOT), (400, 0), (40, 3000), (25, repeated_passages.HOT)])
def test_against_every_string(spark, length, hot):
    rng = random.Random(length + hot)
    word = lambda: "".join(rng.choice("abcdeé\n ") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randrange(length // 8, length // 2)) for _ in range(8)]
    texts = [prose(rng.randrange(0, length // 3)) + "".join(rng.choice([rng.choice(passages), prose(9)]) for _ in range(rng.randrange(5))) for _ in range(60)]
    for _ in range(15):  # near copies: a byte less, more or another
        t = rng.choice(texts)
        k = rng.randrange(len(t) + 1)
        texts.append(t[:k] + rng.choice(["", "#", "# "]) + t[k + rng.randrange(2) :])
    texts += [None, None, "", "a" * (3 * length), "ab" * length, "x" * length, "y" + "x" * length, "z" * (length - 1), texts[0], texts[0], passages[0] * 3]
    texts += [c + passages[1] * 2 + c for c in "uvw"] + ["-" * 30 + " \n" * length + p for p in passages]
    rows = [(None if k % 7 == 0 else k // 2, t, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string").selectExpr("*", "1 AS kept", "2 AS starts", "3 AS bucket").repartition(5)
    want = [(i, *w) for (i, _, _), w in zip(rows, plain(texts, length), strict=True)]
    assert sorted(map(str, found(df, length=length, hot=hot))) == sorted(map(str, want))
    assert sum(w[2] for w in want) > 0.2 * sum(w[1] for w in want)
    assert found(df.limit(0), length=length) == []
    assert len(found(df.where("text = ''"), length=length)) == 1


def test_stretches_of_long_texts(spark, monkeypatch):
    """A text is laid a stretch at a time, and chunks are handed on, wherever the cuts fall."""
    rng = np.random.default_rng(1)
    base = bytes(rng.integers(97, 123, 30_000).astype(np.uint8)).decode()
    texts = [base, base[5_000:21_000] + "!" + base[21_000:], "".join(reversed(base)), base[:100] + base[200:900]]
    for name, value in (("LAID", 2_000), ("CHUNK", 500), ("CHUNK_BYTES", 3_000), ("TOGETHER", 2_000)):
        monkeypatch.setattr(repeated_passages, name, value)
    rows = {k: t.encode() for k, t in enumerate(texts)}
    import pyarrow as pa

    own = pa.RecordBatch.from_pydict({"rid": list(rows), "text": list(rows.values())})
    handed = [r for b in repeated_passages._sample(400, 3)([own]) for r in b.to_pylist()]
    handed.sort(key=lambda r: r["bucket"])
    some = pa.RecordBatch.from_pylist(handed, schema=repeated_passages.BUCKETED)
    places: dict = {}
    for b in repeated_passages._repeated([some]):
        for r in b.to_pylist():
            places.setdefault(r["rid"], []).append(r["at"])
    keys = sorted(places)
    given = pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array([rows[k] for k in keys], pa.binary()), pa.array([sorted(places[k]) for k in keys], pa.list_(pa.int32()))], names=["rid", "text", "at"]
    )
    out = sorted((r for b in repeated_passages._stretches(400)([given]) for r in b.to_pylist()), key=lambda r: r["bucket"])
    runs: dict = {}
    for b in repeated_passages._compare(400)([pa.RecordBatch.from_pylist(out, schema=repeated_passages.STRETCHES)]):
        for r in b.to_pylist():
            runs.setdefault(r["rid"], set()).update(range(r["first"], r["last"] + 1))
    count = Counter(d[i : i + 400] for d in rows.values() for i in range(len(d) - 399))
    assert runs == {k: s for k, d in rows.items() if (s := {i for i in range(len(d) - 399) if count[d[i : i + 400]] > 1})}


def test_query_on_documents(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = queries.op11_repeated_passages(spark, data).collect()
    want = [(i, *w) for (i, _), w in zip(docs, plain([t for _, t in docs], 400), strict=True)]
    assert sorted(map(tuple, got)) == sorted(want)
