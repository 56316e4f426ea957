"""Vectors, sharding, packing, classifiers, the pipeline and the registered queries."""

import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import grid_order_join, packing, quality, queries, resharding, toxicity


def test_grid_order_join_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(6):
        center = rng.normal(size=16)
        for _ in range(60):
            rows.append((len(rows), (center + rng.normal(size=16) * rng.choice([0.1, 0.3, 0.6])).astype(np.float32).tolist(), c % 3))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(5)]  # copies
    n = len(rows)
    odd = [
        (n, None, 1),
        (n + 1, [0.0] * 16, 1),
        (n + 2, [float("nan")] * 16, 1),
        (n + 3, rows[0][1], None),
        (n + 4, [1.0, None] + [0.0] * 14, 1),
        (n + 5, [], 0),
        (n + 6, [1.0, 2.0], 0),
        (n + 7, [2.0, 4.0], 0),
        (n + 8, [float("inf")] * 16, 1),
    ]
    df = spark.createDataFrame(
        rows + odd, "vec_id long, embedding array<float>, label int",
    ).selectExpr("*", "1 AS n", "2 AS rid", "3 AS component")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in grid_order_join.near_vectors(df, block_rows=50).collect()}
    v = np.array([r[1] for r in rows])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    labels = np.array([r[2] for r in rows])
    hit = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(hit, False)
    comp = np.arange(n)
    while True:
        new = np.minimum(comp, np.where(hit, comp[None, :], n).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    assert hit.sum() > 500
    assert all(got[i] == (hit[i].sum(), comp[i], comp[i] == i) for i in range(n))
    assert all(got[n + k] == (0, n + k, True) for k in (0, 1, 2, 3, 4, 5, 8)) and got[n + 7] == (1, n + 6, False)
    assert grid_order_join.near_vectors(df.limit(0)).count() == 0


def test_grid_order_join_in_double_precision(spark):
    """Double components stay double: pairs on both sides of the limit by less than a float can tell, huge and tiny ones."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    base /= np.linalg.norm(base)
    other = rng.normal(size=8)
    other -= (other @ base) * base
    other /= np.linalg.norm(other)
    rows = []
    for c in (0.93 + 2e-12, 0.93 - 2e-12):
        label = len(rows)
        rows += [(len(rows), base.tolist(), label), (len(rows) + 1, (c * base + np.sqrt(1 - c * c) * other).tolist(), label)]
    rows += [(4, [1e300, 1e300, 0.0], 9), (5, [1.0, 1.0, 0.0], 9), (6, [1e-200, 1e-200, 0.0], 9), (7, [0.0, 0.0, 1e300], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in grid_order_join.near_vectors(df).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (0, 3), 4: (2, 4), 5: (2, 4), 6: (2, 4), 7: (0, 7)}


def test_gradient_by_differences():
    """Each step of training moves the parameters by minus the rate times the loss's slope, here measured by differences."""
    buckets, dim, rate, seed = 12, 8, 0.01, 11
    rows, counts, y = np.array([1, 4, 7]), np.array([2, 1, 3]), 1
    table = np.random.default_rng(seed).uniform(-1 / dim, 1 / dim, (buckets, dim))
    out, bias = np.zeros((2, dim)), np.log([1.0, 2.0])
    for k in range(8):
        lr = rate * (1 - k / 8)
        by_table = np.zeros_like(table)
        by_out = np.zeros_like(out)
        loss = lambda t, o: -np.log((e := np.exp(o @ ((counts / counts.sum()) @ t[rows]) + bias))[y] / e.sum())  # noqa: B023, E731
        for a, g in ((table, by_table), (out, by_out)):
            for i in range(a.size):
                held = a.flat[i]
                a.flat[i] = held + 1e-6
                high = loss(table, out)
                a.flat[i] = held - 1e-6
                g.flat[i] = (high - loss(table, out)) / 2e-6
                a.flat[i] = held
        table -= lr * by_table
        out -= lr * 0.25 * by_out
    model = quality.train([(rows, counts, y)], buckets, dim, epochs=8, least_steps=0, rate=rate, seed=seed)
    assert np.allclose(model.weights, table @ (out[1] - out[0]), rtol=2e-3, atol=1e-9) and np.abs(model.weights).max() > 1e-5


def _check_shards(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards)) and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_resharding(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").selectExpr("*", "1 AS shard", "2 AS slot").unionByName(
        spark.createDataFrame([(None, None), (1, "x"), (1, "x")], "doc_id long, text string"), allowMissingColumns=True,
    )
    out = resharding.reshard_documents(docs).collect()
    assert len(out) == docs.count()
    _check_shards(out, 24)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.doc_id == 1 or (r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id])) for r in out)
    assert resharding.reshard_documents(docs.limit(0)).count() == 0
    _check_shards(resharding.reshard_documents(docs.limit(5)).collect(), 24)


def test_grid_order_join_null_and_repeated_ids(spark):
    """Rows with null or repeated ids are rows like others; a null id is a component_id only where there is no other."""
    one, other = [1.0, 0.0, 0.5], [0.0, 1.0, -0.5]
    rows = [(None, one, 1), (5, one, 1), (5, one, 1), (None, other, 1), (None, other, 1), (7, other, 2), (None, None, None), (7, None, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "*", "label AS component", "vec_id AS rid", "1 AS links",
    )
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in grid_order_join.near_vectors(df).collect())
    want = [
        (None, 2, 5, False),
        (5, 2, 5, True),
        (5, 2, 5, True),
        (None, 1, None, False),
        (None, 1, None, False),
        (7, 0, 7, True),
        (None, 0, None, False),
        (7, 0, 7, True),
    ]
    assert got == sorted((str(i), n, str(c), k) for i, n, c, k in want)
    assert grid_order_join.near_vectors(df.limit(0)).count() == 0


def test_plan_moves_the_fewest_bytes():
    blocks = {0: [(10.0, 50), (100.0, 50)], 1: [(5.0, 20), (50.0, 20)], 2: [(1.0, 1)]}
    p = resharding.plan(blocks, 3)
    assert p.sizes == {0: 47, 1: 47, 2: 47} and p.moves == {(0, 1): 7, (0, 2): 46} and p.affected() == [0, 1, 2]
    q = resharding.plan({0: [(1.0, 5)], 1: [(1.0, 4)]}, 2)
    assert not q.moves and q.stays == {0: 5, 1: 4}
    shrunk = resharding.plan({0: [(1.0, 5)], 1: [(1.0, 4)], 2: [(3.0, 3)]}, 2)
    assert sum(shrunk.sizes.values()) == 12 and set(shrunk.sizes.values()) == {6} and sum(n for (a, _), n in shrunk.moves.items() if a == 2) == 3


def _fewest_bytes(sizes, shards):
    """By trying every choice of the shards that hold one row more; the smallest rows of a shard move."""
    total = sum(map(len, sizes.values()))
    least, more = divmod(total, shards)
    best = None
    for bigger in combinations(range(shards), more):
        moved = 0
        for i, own in sizes.items():
            room = least + (i in bigger) if i < shards else 0
            moved += sum(sorted(own)[: max(0, len(own) - room)])
        best = moved if best is None else min(best, moved)
    return best


def test_plan_against_every_choice():
    rng = random.Random(3)
    for _ in range(150):
        shards = rng.randint(1, 5)
        sizes = {i: [rng.choice([1, 2, 3, 50, 60, 70]) for _ in range(rng.randrange(12))] for i in range(rng.randint(1, 6))}
        blocks = {i: sorted(Counter(map(float, own)).items()) for i, own in sizes.items()}
        p = resharding.plan(blocks, shards)
        moved = 0
        for i, own in sizes.items():
            out = sum(n for (a, _), n in p.moves.items() if a == i)
            moved += sum(sorted(own)[:out])
            assert out + p.stays.get(i, 0) == len(own)
        assert moved == _fewest_bytes(sizes, shards)
        assert sum(p.sizes.values()) == sum(map(len, sizes.values())) and max(p.sizes.values()) - min(p.sizes.values()) <= 1


def test_reshard_rows_against_brute_force(spark):
    """Every row once, law and slots hold, and no fewer bytes could move; nulls, repeated rows, clashing names."""
    rng = random.Random(4)
    rows = [(i, rng.randrange(5), "x" * rng.randrange(60)) for i in range(300)] + [(7, 1, "same")] * 90 + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "id long, old int, text string").selectExpr(
        "*", "old AS shard", "text AS size", "id AS __rid", "id AS slot",
    )
    got = resharding.reshard(
        df, F.col("old"), 4, F.octet_length(F.coalesce("text", F.lit(""))) + 8, {"id": F.col("id"), "text": F.col("text")}, group_rows=20,
    ).collect()
    assert Counter((r.id, r.old_shard, r.text) for r in got) == Counter((i, old or 0, t) for i, old, t in rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 4
    assert {s: sorted(r.slot for r in got if r.shard == s) for s in counts} == {s: list(range(n)) for s, n in counts.items()}
    sizes = {i: [len(t or "") + 8 for _, old, t in rows if (old or 0) == i] for i in range(5)}
    assert sum(r["size"] for r in got if r.shard != r.old_shard) == _fewest_bytes(sizes, 4)
    assert resharding.reshard(df.limit(0), F.col("old"), 4, F.lit(1), {"id": F.col("id")}).count() == 0


@pytest.mark.parametrize("shards", [4, 2, 7])
def test_rewrite_replaces_only_affected_files(spark, tmp_path, shards, monkeypatch):
    folder = str(tmp_path / "table")
    start = spark.createDataFrame([(i, 0 if i < 30 else i % 4, f"t{i}") for i in range(60)], "id long, shard int, text string")
    before = resharding.write_shards(start, folder)
    stamps = {f: f.stat().st_mtime_ns for f in (tmp_path / "table").rglob("*.parquet")}
    table = resharding.read_shards(spark, folder)
    placed = resharding.reshard(table, F.col("shard"), shards, F.lit(10), {"id": F.col("id")})
    ids = lambda: sorted((r.id, r.text) for r in resharding.read_shards(spark, folder).collect())
    whole = [(i, f"t{i}") for i in range(60)]
    append = resharding.commits.append
    monkeypatch.setattr(resharding.commits, "append", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):  # half way: files are there, the manifest isn't
        resharding.rewrite(placed, folder, table, "id")
    monkeypatch.setattr(resharding.commits, "append", append)
    assert resharding.current_shards(spark, folder) == before and ids() == whole
    written = resharding.rewrite(placed, folder, table, "id")
    after = resharding.current_shards(spark, folder)
    assert ids() == whole and set(after) == set(range(shards))
    counts = Counter(r.shard for r in resharding.read_shards(spark, folder).collect())
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all((after[s] == before.get(s)) == (s not in written) for s in after) and all(f.stat().st_mtime_ns == t for f, t in stamps.items())
    again = resharding.reshard(resharding.read_shards(spark, folder), F.col("shard"), shards, F.lit(10), {"id": F.col("id")})
    assert resharding.rewrite(again, folder, resharding.read_shards(spark, folder), "id") == [] and resharding.current_shards(spark, folder) == after
    assert resharding.read_shards(spark, str(tmp_path / "none")) is None


def test_packing_is_whole_and_tight(spark, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(None, None), (-1, ""), (-2, "word " * 6000)], "doc_id long, text string")
    ).selectExpr("*", "1 AS length", "2 AS offset")
    out = packing.pack(docs).collect()
    ids = {r.doc_id: np.array(t.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4") for r in docs.collect()}
    seen, places = Counter(), {}
    for r in out:
        assert 0 < r.length <= 1024 and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert len(ids[r.doc_id]) > 1024 or r.length == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {k: len(v) for k, v in ids.items()}
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(seen.values()) // 1024) * 1.01 + 1
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.pack(docs.where("doc_id < 5"), with_ids=True).where("size(ids) != length").count() == 0


def _least_bins(counts, size):
    """A lower bound: large pieces sit alone, medium ones share only with small ones."""
    best = 0
    for least in [1, *(s for s in counts if s <= size // 2)]:
        large = sum(n for s, n in counts.items() if s > size - least)
        medium = {s: n for s, n in counts.items() if size / 2 < s <= size - least}
        room = sum((size - s) * n for s, n in medium.items())
        small = sum(s * n for s, n in counts.items() if least <= s <= size / 2)
        best = max(best, large + sum(medium.values()) + max(0, -(-(small - room) // size)))
    return best


def test_local_search_empties_bins():
    b = packing.Bins(10)
    b.bins = Counter({(2, 6): 1, (3, 4): 1, (5,): 1})
    b.improve()
    assert b.bins == {(4, 6): 1, (2, 3, 5): 1}
    rng = np.random.default_rng(0)
    counts = Counter(int(x) for x in rng.integers(1, 1025, 3000))
    bins = packing.solve(counts, 1024)
    assert Counter(x for p, n in bins.items() for x in p * n) == counts and all(sum(p) <= 1024 for p in bins)
    assert sum(bins.values()) <= _least_bins(counts, 1024) * 1.005
    middle = Counter(int(x) for x in rng.integers(200, 420, 1000))
    greedy = packing.Bins(1024)
    greedy.best_fit(middle)
    assert sum(packing.solve(middle, 1024).values()) < sum(greedy.bins.values())


def _accuracy(df, labels, label):
    both = df.where("held_out").join(labels.select("doc_id", label), "doc_id").where(f"{label} IS NOT NULL")
    return both.agg(F.avg((F.col("predicted") == F.col(label)).cast("double")), F.count("*")).first()


def test_classifiers_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    q, n = _accuracy(quality.quality_scores(docs, labels), labels, "quality")
    assert n > 500 and q > 0.98
    t, n = _accuracy(toxicity.toxicity_scores(docs, labels), labels, "toxic")
    assert n > 500 and t > 0.95


@pytest.mark.parametrize("run, label", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_classifiers_awkward(spark, run, label):
    docs = spark.createDataFrame(
        [
            (i, "bad idiot words " * 3 if i % 2 else "fine plain words here", "x", 1) for i in range(60)
        ] + [(None, None, None, None), (100, "", "x", 1), (101, "é" * 4000, "x", 1), (100, "", "x", 1)],
        "doc_id long, text string, score string, held_out int",
    )
    labels = spark.createDataFrame(
        [(i, i % 2, 1) for i in range(60)] + [(None, 1, 1), (3, None, 1), (5, 1, 2)], f"doc_id long, {label} int, y int",
    )
    out = run(docs, labels)
    assert out.count() == 64 and out.where("score < 0 OR score > 1 OR score IS NULL OR predicted IS NULL OR held_out IS NULL").count() == 0
    assert {r.score for r in out.where("doc_id = 100").collect()}.__len__() == 1
    assert run(docs.limit(0), labels).count() == 0
    assert run(docs, labels.limit(0)).count() == 64


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, data, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = queries.queries()[name](spark, data)
    cols = sorted(got.columns)
    want = sorted(map(str, c.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()))
    assert sorted(str(tuple(r)) for r in got.select(*cols).collect()) == want
