import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from loomframe.functions import text as T
from loomframe.functions.geometry import Box
from loomframe.operators import dedup, improve, labels, metrics, monitor, profile, quality, review, scans, split, temporal
from loomframe.plans import dedup_queries, review_queries


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_nearest_asof(spark):
    frames = spark.createDataFrame([(f"f{i}", i, i * 500.0) for i in range(5)], "frame_path string, frame_index int, frame_ts double")
    events = spark.createDataFrame([(1, 0.0), (2, 480.0), (3, 250.0), (4, 9000.0), (5, None), (1, 0.0)], "event_id int, ts double")
    out = temporal.nearest_asof(events, frames, "ts", "frame_ts", "frame_index", 250.0)
    assert rows(out.select("event_id", "frame_index")) == [(1, 0), (1, 0), (2, 1), (3, 0)]
    assert temporal.nearest_asof(events, frames.limit(0), "ts", "frame_ts", "frame_index", 250.0).count() == 0


def test_interval_join_bounds(spark):
    a = spark.createDataFrame([("u", 1000.0)], "k string, t double")
    b = spark.createDataFrame([("u", t) for t in (699.0, 700.0, 1000.0, 1300.0, 1301.0)], "k string, f double")
    assert [r.f for r in temporal.interval_join(a, b, "t", "f", 300, 300, ["k"]).orderBy("f").collect()] == [700, 1000, 1300]


def test_throttle_looks_at_emitted(spark):
    e = spark.createDataFrame([("a", float(t), t) for t in (0, 200, 260, 400, 520)], "k string, t double, o int")
    assert [r.emitted for r in temporal.throttle(e, "k", "t", "o", 250.0).orderBy("emitted").collect()] == [0, 260, 520]


def test_gestures(spark):
    raw = [
        ("s", 0, "press", 0, 0, "left"),
        ("s", 50, "release", 0, 0, "left"),
        ("s", 200, "press", 1, 1, "left"),
        ("s", 250, "release", 1, 1, "left"),
        ("s", 1000, "press", 0, 0, "left"),
        ("s", 1400, "release", 0, 0, "left"),
        ("s", 2000, "press", 0, 0, "right"),
        ("s", 2500, "release", 0, 0, "right"),
        ("s", 3000, "press", 0, 0, "left"),
        ("s", 3100, "release", 30, 0, "left"),
    ]
    df = spark.createDataFrame(
        [(a, float(t), k, float(x), float(y), b, i) for i, (a, t, k, x, y, b) in enumerate(raw)],
        "src string, ts double, kind string, x double, y double, button string, o int",
    )
    assert [
        r.action for r in temporal.gestures(df, "src", "ts", "o").orderBy("ts").collect()
    ] == ["click", "double_click", "hold", "right_click", "drag"]


@pytest.mark.parametrize("most", [7, 8, 20])
def test_greedy_leaders_against_sequence(spark, most):
    rng = random.Random(most)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    hashes = []
    for _ in range(90):
        h = rng.choice(seeds)
        for _ in range(rng.randint(0, 6)):
            h ^= 1 << rng.randrange(64)
        hashes.append(h)
    hashes[7] = None
    want, leaders = {}, []
    for i, h in enumerate(hashes):
        found = None if h is None else next((j for j in leaders if hashes[j] is not None and bin(hashes[j] ^ h).count("1") <= most), None)
        want[i] = i if found is None else found
        if found is None:
            leaders.append(i)
    df = spark.createDataFrame([(i, None if h is None else h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)], "o int, h long")
    assert dict(rows(dedup.greedy_leaders(df, "h", "o", most))) == want
    ids = {r.o: r for r in dedup.cluster_ids(df, "h", "o", most + 1).collect()}
    assert ids[7].cluster_id == "missing" and ids[7].is_representative
    assert dedup.deduplicate(df, "h", "o", most + 1).count() == len(leaders) - 1


def test_leaders_of_many_copies(spark):
    """Copies never make pairs: 20,000 rows of three hashes are three hashes of work."""
    df = spark.range(20_000).selectExpr("id AS o", "CASE WHEN id % 3 = 0 THEN 0L WHEN id % 3 = 1 THEN 7L ELSE -1L END AS h")
    assert rows(dedup.greedy_leaders(df, "h", "o", 3).groupBy("leader").count()) == [(0, 13_334), (2, 6_666)]


@pytest.mark.parametrize("most", [0, 3, 7, 11, 15, 20])
def test_close_pairs_against_brute_force(spark, most):
    rng = random.Random(most)
    hashes = [rng.getrandbits(64) for _ in range(25)]
    for h in list(hashes):
        for n in (1, most, most + 1, 16):
            for k in rng.sample(range(64), n):
                h ^= 1 << k
            hashes.append(h)
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    want = [(i, j, bin(a ^ b).count("1")) for j, b in enumerate(hashes) for i, a in enumerate(hashes[:j]) if bin(a ^ b).count("1") <= most]
    df = spark.createDataFrame(list(enumerate(signed)), "o int, h long")
    assert rows(dedup.close_pairs(df, "h", "o", most)) == sorted(want)


def test_pairs_of_vectors_with_nulls(spark, tmp_path):
    """Absent and null vectors have the hash 0 and are paired; a null component is over no median and sorts last."""
    v = [float(k * 37 % 64) for k in range(64)]
    vectors = [None, None, [0.0] * 64, v, [*v[:5], None, *v[6:]], [None, *v[1:]], [], [1.0, 2.0], [*v, 9.0], v[:60]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    df.write.parquet(str(tmp_path / "embeddings.parquet"))

    def bits(v):
        v = [*(v or []), *[None] * 64][:64]
        held = sorted(x for x in v[1:] if x is not None)
        return [len(held) > 31 and x is not None and x > held[31] for x in v]

    apart = lambda a, b: sum(x != y for x, y in zip(bits(vectors[a]), bits(vectors[b]), strict=True))
    want = [(a, b, apart(a, b)) for b in range(10) for a in range(b) if apart(a, b) <= 15]
    assert rows(dedup_queries.hamming_pairs(spark, str(tmp_path))) == sorted(want) and {(0, 1, 0), (0, 2, 0), (3, 8, 0)} <= set(want)


def test_no_band_hides_a_pair(spark):
    """15 bits spread so that the nearest of the four bands is as far off as it can be, and in other ways."""
    rng = random.Random(4)
    spreads = [*sorted(set(permutations((4, 4, 4, 3)))), (15, 0, 0, 0), (5, 5, 5, 0), (3, 3, 3, 6)]
    flips = [sum(1 << k for band, n in enumerate(s) for k in rng.sample(range(16 * band, 16 * band + 16), n)) for s in spreads for _ in range(20)]
    hashes = [h for f in flips for g in [rng.getrandbits(64)] for h in (g, g ^ f)]
    df = spark.createDataFrame([(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)], "o int, h long")
    want = [(i, j, d) for j, b in enumerate(hashes) for i, a in enumerate(hashes[:j]) if (d := (a ^ b).bit_count()) <= 15]
    assert rows(dedup.close_pairs(df, "h", "o", 15)) == sorted(want) and len(want) >= len(flips)


def test_variants_of_hashes_are_never_broadcast(spark):
    """2,000 hashes look like 16 KB before they are exploded, and are a million rows after."""
    df = spark.range(2000).select(F.xxhash64("id").alias("h"))
    for most in (3, 15):
        plan = dedup.close_hashes(df, most)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_scans_of_hot_keys(spark):
    """One key with nearly all rows is spread over ranges, with the result of one window."""
    rng = random.Random(6)
    data = [("hot" if k % 50 else rng.choice(["a", "b", None]), float(rng.randrange(4000)), k, rng.random() < 0.01, rng.random() if k % 7 else None) for k in range(3000)]
    df = spark.createDataFrame(data, "k string, t double, o int, flag boolean, v double").repartition(4)
    place = F.struct("t", "o")
    df = df.withColumn("at", place)
    parts = scans.parted(df, ["k"], ["t", "o"], ranges=9)
    assert parts.where("k = 'hot'").select(scans.PART).distinct().count() >= 7
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same = lambda f: sorted(map(str, f(True).collect())) == sorted(map(str, f(False).collect()))
        assert same(lambda s: monitor.latch(df, "flag", "at", "k", spread=s))
        for n in (1, 2, 100, 2900):
            assert same(lambda s: monitor.confidence_window(df, "v", "at", "k", n=n, spread=s).withColumn("window_mean", F.round("window_mean", 9)))
        assert same(lambda s: temporal.double_clicks(df, "k", "t", "o", "v", "t", within_ms=2.0, spread=s))
        probes, frames = df.where("o % 3 = 0").select("k", "t", "o"), df.where("o % 3 = 1 AND o < 900").select("k", F.col("t").alias("f"))
        assert same(lambda s: temporal.nearest_unbounded(probes, frames, "t", "f", ["k"], spread=s))
        assert scans.crowded(df, ["k"], 2000) and not scans.crowded(df, ["k"])
        assert monitor.latch(df.limit(0), "flag", "at", "k", spread=True).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_far_pairs_in_tiles(spark, monkeypatch):
    """Beyond 15 bits blocks meet in tiles, never in a nested loop, and groups too far apart don't meet."""
    rng = random.Random(5)
    centers = [rng.getrandbits(64) for _ in range(6)]
    hashes = {c ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(9))) for c in centers for _ in range(120)}
    signed = sorted(h - (1 << 64) if h >> 63 else h for h in hashes)
    df = spark.createDataFrame([(h,) for h in [*signed, None]], "h long")
    for block, pivots in ((37, 256), (4096, 1)):
        monkeypatch.setattr(dedup, "BLOCK", block)
        monkeypatch.setattr(dedup, "PIVOTS", pivots)
        for most in (17, 20):
            got = dedup.close_hashes(df, most)
            assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
            found = {(r.h, r.g): r.distance for r in got.collect()}
            unsigned = [h % (1 << 64) for h in signed]
            want = {(signed[i], signed[j]): d for j in range(len(signed)) for i in range(j) if (d := (unsigned[i] ^ unsigned[j]).bit_count()) <= most}
            assert found == want and len(want) > 20_000
    assert dedup.close_hashes(df.limit(0), 20).count() == 0


def test_throttle_over_keys_and_nulls(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *map(float, range(0, 900, 7))]), i) for i in range(400)]
    want = []
    for key in ("a", "b", None):
        last = None
        for _, t, _ in sorted((r for r in data if r[0] == key and r[1] is not None), key=lambda r: r[1:]):
            if last is None or t - last >= 50:
                want.append((key, t))
                last = t
    got = temporal.throttle(spark.createDataFrame(data, "k string, t double, o int"), "k", "t", "o", 50.0)
    assert sorted(map(str, got.collect())) == sorted(f"Row(k={k!r}, emitted={t})" for k, t in want)


def test_ranked_pairs_stop_at_the_first_small_gap(spark):
    j = spark.createDataFrame([(i, s) for i, s in enumerate([0.9, 0.5, 0.45, 0.3, 0.3])], "id int, s double")
    walked = rows(improve.ranked_pairs(j, "id", "s", "id", 0.1).select("chosen", "rejected"))
    assert walked == [(0, 1), (0, 2), (0, 3), (0, 4), (2, 3), (2, 4)]  # 1 is 0.05 above 2, so it has none
    assert rows(improve.margin_pairs(j, "id", "s", "id", 0.1).select("chosen", "rejected")) == sorted([*walked, (1, 3), (1, 4)])
    assert improve.ranked_pairs(j.limit(0), "id", "s", "id").count() == 0


def _judged(spark, monkeypatch):
    """Rows with ties, no scores and gaps, in blocks of a few rows; and their order by score."""
    monkeypatch.setattr(improve, "LEAST_BLOCK", 7)
    rng = random.Random(8)
    data = [(i, None if i % 41 == 0 else rng.randrange(25) / 20) for i in range(150)]
    rng.shuffle(data)
    placed = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    return spark.createDataFrame(data, "id int, s double").repartition(3), placed


def _first_step(df):
    """The join or exchange that makes the rows of a result."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return next(line for line in plan.splitlines() if "Join" in line or "Exchange" in line or "Cartesian" in line)


@pytest.mark.parametrize("margin", [0.1, 0.0, -0.2, 9.0])
def test_margin_pairs_in_tiles(spark, monkeypatch, margin):
    judged, placed = _judged(spark, monkeypatch)
    got = improve.margin_pairs(judged, "id", "s", "id", margin)
    assert "SortMergeJoin [__a" in _first_step(got)
    far = lambda a, b: a is not None and b is not None and a - b >= margin
    want = [(i, a, j, b) for k, (i, a) in enumerate(placed) for j, b in placed[k + 1 :] if far(a, b)]
    assert rows(got.select("chosen", "chosen_score", "rejected", "rejected_score")) == sorted(want) and (want or margin == 9)


def test_top_bottom_pairs_in_tiles(spark, monkeypatch):
    judged, placed = _judged(spark, monkeypatch)
    scored = [r for r in placed if r[1] is not None]
    for share, margin in ((0.3, 0.1), (0.9, -0.5), (0.001, 0.1)):
        df = judged.where("s IS NOT NULL")
        got = improve.top_bottom_pairs(df, "id", "s", "id", share, margin)
        assert "SortMergeJoin [__a" in _first_step(got)
        k = max(1, int(len(scored) * share))
        want = [(i, a, j, b) for i, a in scored[:k] for j, b in scored[-k:] if a - b >= margin]
        assert want and rows(got.select("chosen", "chosen_score", "rejected", "rejected_score")) == sorted(want)


def test_bytes_of_a_pair_do_not_grow_with_the_blocks(spark, tmp_path, monkeypatch):
    """A pair took 0.88 bytes in a block of 2,500 when whole blocks were laid out in turn."""
    monkeypatch.setattr(improve, "LEAST_BLOCK", 2500)
    judged = spark.range(5000).selectExpr("id", "CASE WHEN id < 2500 THEN 2.0D ELSE 0.0D END + (id * 37 % 101) / 101.0D AS s")
    pairs = improve.top_bottom_pairs(judged, "id", "s", "id", 0.5)
    pairs.write.option("compression", "snappy").parquet(str(tmp_path / "pairs"))
    got = spark.read.parquet(str(tmp_path / "pairs"))
    assert rows(got.agg(F.count("*"), F.sum("chosen"), F.sum("rejected"))) == [(6_250_000, 2500 * sum(range(2500)), 2500 * sum(range(2500, 5000)))]
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.25 * 6_250_000


def test_records_are_joined_before_the_pairs_are_made(spark, data, monkeypatch):
    judged, _ = _judged(spark, monkeypatch)
    known = spark.range(150).where("id % 3 != 0").selectExpr("cast(id AS int) AS id", "CASE WHEN id % 2 = 0 THEN '' ELSE 't' END AS p", "array(id) AS b", "'f' AS f")
    known = known.union(known.where("id < 40"))
    cols = [f"{a}{b}" for a in ("chosen", "rejected") for b in ("", "_score", "_prompt", "_bbox", "_image_path")]
    want = improve.pair_records(improve.top_bottom_pairs(judged, "id", "s", "id", 0.5), known, "id", "p", "b", "f")
    got = improve.top_bottom_records(judged, known, "id", "s", "id", "p", "b", "f", 0.5)
    assert rows(got.select(*cols)) == rows(want.select(*cols)) != []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin [__a" in _first_step(review_queries.preference_records(spark, data))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranks_of_equal_scores(spark):
    j = spark.range(5000).selectExpr("id", "CASE WHEN id < 10 THEN 1.0D ELSE 0.5D END AS s")
    got = improve.ranked(j, "s", "id")
    assert got.where("rank != id + 1").count() == 0


def test_propagation_blocks(spark):
    m = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "o int, leader int")
    v = spark.createDataFrame([(1, "x"), (3, None)], "o int, value string")
    assert rows(dedup.propagate(m, v, "o", "value").select("o", "status")) == [(1, "own"), (2, "copied"), (3, "blocked")]


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a"), ("b", "b")], "p string, t string")
    assert metrics.macro_f1(df, "p", "t").first()[0] == pytest.approx((0.8 + 2 / 3) / 2)
    assert metrics.accuracy(df, "p", "t").first()[0] == 0.75 and metrics.accuracy(df.limit(0), "p", "t").first()[0] == 0
    v = spark.createDataFrame([("k", float(i)) for i in range(8)], "k string, v double")
    assert metrics.nearest_rank(v, "v", ["k"]).first().p == 7.0
    a, b = spark.createDataFrame([(1, "x")], "k int, p string"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, t string")
    with pytest.raises(Exception, match="length"):
        metrics.zipped(a, b, "k").collect()


def test_effective_label(spark):
    kind = f"id int, label {labels.LABEL}, status string, corrections string"
    e = ("e1", 1.0, 1.0, 2.0, 2.0, "old", None, "fn", [], [], "enabled", None, True, 0.5, None)
    label = (("map", "sit", [], 0.8), (None,) * 8 + (None,), [e], None, 0.7, False)
    cases = [
        (1, label, "edited", '{"semantic_id":"new","screen_type":null}'),
        (2, label, "pending", '{"semantic_id":"new"}'),
        (3, None, "edited", "{}"),
        (4, label, "edited", '{"page":{"screen_type":"city"},"elements":[]}'),
        (5, label, "edited", None),
        (6, label, "edited", "{}"),
    ]
    df = labels.effective_label(spark.createDataFrame(cases, kind), status="status", name="l")
    got = {r.id: r.l for r in df.collect()}
    assert got[1].page.screen_type is None and got[1].elements[0].semantic_id == "new" and got[1].route_label.primitive_id == "fn"
    assert got[2].elements[0].semantic_id == "old" and got[3] is None and got[5] == got[2] == got[6]
    assert got[4].page.screen_type == "city" and got[4].page.confidence == 0 and got[4].elements == [] and got[4].confidence == 0.7


def test_flags_and_score(spark):
    df = spark.createDataFrame([(["quality_issue", "missing_primitive_id"],), ([],), (list(quality.PENALTIES),)], "f array<string>")
    assert [round(r[0], 6) for r in df.select(quality.score(F.col("f"))).collect()] == [0.4, 1.0, 0.0]
    merged = spark.createDataFrame(
        [(["a", quality.DUPLICATE], ["a", "b"], True), (None, None, False)], "o array<string>, n array<string>, r boolean",
    ).select(quality.merge_flags(F.col("o"), F.col("n"), F.col("r"))).collect()
    assert [r[0] for r in merged] == [["a", "b"], [quality.DUPLICATE]]


def test_review_priority_and_ambiguity(spark):
    none = F.lit(None)
    p = review.priority(
        F.lit(0.9),
        F.array(F.lit("candidate_conflict")),
        F.lit(True),
        F.lit(False),
        F.lit(9),
        none.cast("boolean"),
        F.lit(False),
        F.array(F.lit(0.5), F.lit(0.45)),
    )
    assert spark.range(1).select(p).first()[0] == pytest.approx(0.9 - 0.15 - 0.10 - 0.20 - 0.20)
    b = spark.createDataFrame(
        [(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 1.0, 10.0, 10.0, 0.3), (1, 3, 50.0, 50.0, 60.0, 60.0, 0.8)],
        "g int, o int, x1 double, y1 double, x2 double, y2 double, s double",
    )
    assert {r.o: r.uncertainty for r in review.ambiguity(b, "g", "o", "s").collect()} == {1: 0.3, 2: 0.9, 3: 0.2}


def test_heuristic_judge(spark):
    j = improve.heuristic(Box.cols(), F.col("x"), F.col("y"), F.col("c"), F.lit(1000), F.lit(1000))
    df = spark.createDataFrame(
        [(10.0, 10.0, 60.0, 60.0, 20.0, 20.0, 0.9), (5.0, 5.0, 5.0, 9.0, 5.0, 5.0, 0.9), (0.0, 0.0, 100.0, 5.0, 500.0, 0.0, 0.1)],
        "x1 double, y1 double, x2 double, y2 double, x double, y double, c double",
    )
    a, b, c = [r[0] for r in df.select(j).collect()]
    assert a.score == 1 and a.penalties == [] and b.score == 0 and "degenerate_bbox" in b.penalties
    assert c.score == pytest.approx(0.3) and c.penalties == ["extreme_aspect_ratio", "click_outside_bbox", "low_confidence"]


def test_pairs_and_history(spark):
    j = spark.createDataFrame([(i, s) for i, s in enumerate([0.9, 0.9, 0.5, 0.2])], "id int, s double")
    assert [(r.id, r["rank"]) for r in improve.ranked(j, "s", "id").orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert rows(improve.top_bottom_pairs(j, "id", "s", "id").select("chosen", "rejected")) == [(0, 3)]
    assert rows(improve.margin_pairs(j, "id", "s", "id", 0.4).select("chosen", "rejected")) == [(0, 2), (0, 3), (1, 2), (1, 3)]
    h = spark.createDataFrame([(1, 0.5), (2, 0.6), (3, 0.6), (4, 0.4)], "i int, s double")
    assert [r.trend for r in improve.trends(h, "s", "i").orderBy("i").collect()] == [" ", "^", "=", "v"]
    assert improve.best_iteration(h, "s", "i").first().best == 2 and improve.last_best(h, "s", "i").first().epoch == 3
    assert [r.improved for r in improve.improved(h, "s", "i").orderBy("i").collect()] == [True, True, False, False]
    assert improve.stalled(h, "s", "i", 2, 0.01).first().stalled and not improve.stalled(h, "s", "i", 4, 0.01).first().stalled


def test_split_of_more_than_a_million_rows(spark):
    """Numbers of seven digits stay whole: cut to six, the last rows would fall among those of 100,000 and on."""
    numbered = spark.range(999_900, 1_000_100).select("id", F.lit("s").alias("session"), T.sample_id(F.col("id")).alias("sid"))
    got = split.by_session(numbered, "session", "sid", T.numeric_suffix(F.col("sid")))
    assert rows(got.where("split = 'val'").select("id", "sid")) == [(i, f"sample_{i}") for i in range(1_000_080, 1_000_100)]


def test_splits(spark):
    one = spark.createDataFrame([("s", f"sample_{i:06d}") for i in range(11)], "session string, id string")
    from loomframe.functions.text import numeric_suffix

    out = split.by_session(one, "session", "id", numeric_suffix(F.col("id")))
    assert rows(out.where("split = 'val'").select("id")) == [("sample_000010",)]
    assert split.by_session(one.limit(1), "session", "id", numeric_suffix(F.col("id"))).first().split == "train"
    many = spark.createDataFrame([(f"s{i:02d}", i) for i in range(25)], "session string, id int")
    assert rows(split.by_session(many, "session", "id", F.col("id")).where("split = 'val'").select("session")) == [("s23",), ("s24",)]
    assert split.head_tail(many, ["id"]).where("split = 'train'").count() == 22
    assert rows(split.every_nth(many, ["id"], 10).select("id")) == [(0,), (10,), (20,)]


def test_profile_and_monitor(spark):
    c = spark.createDataFrame([("a",)] * 3 + [("b",)], "c string")
    import math

    assert profile.class_balance(c, "c").first()[0] == pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)) / math.log(2))
    assert profile.class_balance(c.where("c = 'a'"), "c").first()[0] == 1
    p = spark.createDataFrame(
        [
            (10, 10, 1, 1.0, 0.1, 1.0, "trivial"),
            (500, 900, 3, 1.8, 0.1, 1.0, "moderate"),
            (5000, 900, 30, 1.8, 0.1, 1.0, "complex"),
            (100, 200, 1, 2.0, 0.1, 1.0, "simple"),
        ],
        "num_images int, num_annotations int, num_classes int, avg_annotations_per_image double, avg_box_area_ratio double, class_balance_score double, estimated_complexity string",
    )
    assert [
        r.model_name for r in profile.strategy(p).orderBy("num_images").collect()
    ] == ["microsoft/Florence-2-base", "yolov8n.pt", "yolov8s.pt", "yolov8m.pt"]
    d = spark.createDataFrame([(60, 5, True, None), (1, 1, False, None), (60, 30, False, 2.0)], "f int, c int, d boolean, h double")
    got = monitor.retrain_decision(d, "f", "c", "d", "h").collect()
    assert [(r.should_retrain, r.recommended_strategy) for r in got] == [(True, "full"), (False, "none"), (False, "none")]
    assert got[0].reason == "failures=60>=50; drift_detected" and got[2].reason.startswith("cooldown active (2.0h")
