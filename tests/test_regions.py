"""Regions of changed pixels by hand values and against a flood fill."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import regions
from loomframe.operators import candidates
from loomframe.plans import candidate_queries


def _flood(free, seeds, steps):
    seen, stack = set(seeds), list(seeds)
    while stack:
        y, x = stack.pop()
        for dy, dx in steps:
            at = (y + dy, x + dx)
            if at not in seen and at in free:
                seen.add(at)
                stack.append(at)
    return seen


SIDES = [(0, 1), (1, 0), (0, -1), (-1, 0)]
ALL = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def plain_boxes(mask):
    """Outer shapes by flood fill, a pixel at a time; the area by the polygon's squares and halves."""
    h, w = mask.shape
    free = {(y, x) for y in range(-1, h + 1) for x in range(-1, w + 1) if not (0 <= y < h and 0 <= x < w and mask[y, x])}
    shapes = {(y, x) for y in range(h) for x in range(w)} - _flood(free, [(-1, -1)], SIDES)
    out = []
    for at in sorted(shapes):
        if at in shapes:
            own = _flood(shapes, [at], ALL)
            shapes -= own
            ys, xs = [y for y, _ in own], [x for _, x in own]
            parts = [sum((y + a, x + b) in own for a in (0, 1) for b in (0, 1)) for y in range(-1, h) for x in range(-1, w)]
            area = sum(1.0 if n == 4 else 0.5 if n == 3 else 0.0 for n in parts)
            out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, area))
    return sorted(out)


@pytest.mark.parametrize("share", [0.05, 0.3, 0.5, 0.7, 0.95])
def test_boxes_against_flood_fill(share):
    rng = np.random.default_rng(int(share * 100))
    for shape in ((1, 1), (1, 9), (9, 1), (12, 17), (25, 25)):
        for _ in range(12):
            mask = rng.random(shape) < share
            assert sorted(map(tuple, regions.boxes(mask).tolist())) == plain_boxes(mask)


def test_closing_against_its_words():
    rng = np.random.default_rng(3)
    mask = rng.random((14, 18)) < 0.1
    near = lambda m, y, x: m[max(y - 2, 0) : y + 3, max(x - 2, 0) : x + 3]
    wide = np.array([[near(mask, y, x).any() for x in range(18)] for y in range(14)])
    assert (regions.closed(mask) == np.array([[near(wide, y, x).all() for x in range(18)] for y in range(14)])).all()


def test_drawn_rectangles_by_hand():
    before = np.zeros((200, 300))
    after = before.copy()
    after[20:50, 30:90] = 200  # 60 by 30: the polygon through its border pixels has 59 by 29
    after[100:112, 200:212] = 90
    after[100:112, 216:228] = 90  # four pixels away: one shape
    after[150:155, 10:15] = 255  # too small
    after[60:90, 120:190] = 255
    after[70:80, 130:150] = 0  # a hole changes nothing outside
    after[180, 280] = 3  # within the threshold
    got = regions.changed_boxes(before, after)
    assert [g[:4] for g in got] == [(120, 60, 190, 90), (30, 20, 90, 50), (200, 100, 228, 112)]
    assert got[1][4] == min(1.0, 59 * 29 / 60000 * 100) == 1.0 and got[2][4] == pytest.approx(27 * 11 / 60000 * 100)
    assert regions.changed_boxes(before, after[:100]) == [] and regions.changed_boxes(before, before) == []
    near = regions.changed_near(before, after, 95.0, 30.0, radius=20, align=False)
    assert [n[:4] for n in near] == [(75, 20, 90, 50)] and regions.changed_near(before, after, 900.0, 30.0) == []


def test_alignment_of_moved_screens():
    rng = np.random.default_rng(4)
    big = np.kron(rng.integers(0, 256, (20, 25)), np.ones((8, 8)))
    before, after = big[10:130, 10:170].copy(), big[7:127, 5:165].copy()  # moved by 5 right and 3 down
    dx, dy = regions.shift_between(before, after)
    assert (round(dx), round(dy)) == (5, 3)
    after[60:90, 60:100] = 255 - after[60:90, 60:100]
    plain = regions.changed_boxes(before, after)
    assert plain and plain[0][2] - plain[0][0] > 100  # everything has moved
    moved = regions.shifted(before, 5.0, 3.0)
    assert (moved[3:, 5:] == before[:-3, :-5]).all() and (moved[:3, 5:] == before[2::-1, :-5]).all()
    half = regions.shifted(np.array([[0.0, 10.0, 20.0]]), 0.5, 0.0)
    assert half.tolist() == [[0.0, 5.0, 15.0]]


def test_operators_over_image_rows(spark, data):
    frames = candidate_queries._frames(spark, data)
    held = {r.vec_id: [np.frombuffer(i.data, np.uint8).reshape(32, 32).astype(float) for i in (r.before, r.after)] for r in frames.collect()}
    got = {}
    for r in candidate_queries.diff_boxes(spark, data).collect():
        assert r.signal == "diff" and r.semantic_text is None
        got.setdefault(r.vec_id, []).append((r.at, (r.x1, r.y1, r.x2, r.y2)))
    assert len(got) > 100
    for k, (before, after) in list(held.items())[:60]:
        changed = plain_boxes(regions.closed(np.abs(before - after) > 5))
        want = sorted((x, y, x + w, y + h) for x, y, w, h, a in changed if a >= 4)
        found = [b for _, b in sorted(got.get(k, []))]
        assert sorted(found) == want and found == sorted(found, key=lambda b: -(b[2] - b[0]) * (b[3] - b[1]))
    near = candidate_queries.local_diff_boxes(spark, data)
    assert near.where("signal = 'diff_local'").count() == near.count() > 100
    bare = frames.limit(3).withColumn("x", F.lit(None)).withColumn("after", F.when(F.col("vec_id") > 0, F.col("after")))
    assert candidates.local_diff_boxes(bare, "vec_id", "x", "x").count() == 0
