import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import geometry as G
from loomframe.functions import hashing, text


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def box(*v):
    return G.Box(*(F.lit(float(x)) for x in v))


def test_iou_and_distance(spark):
    a, b = box(0, 0, 20, 20), box(10, 10, 30, 30)
    r = one(spark, G.iou(a, b), G.center_distance(a, b), G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), G.iou(a, a))
    assert r.c0 == pytest.approx(100 / 700) and r.c1 == pytest.approx(math.sqrt(200)) and r.c2 == 0 and r.c3 == 1


def test_scales(spark):
    n = G.normalize(box(96, 54, 192, 108), "0-1000", F.lit(1920), F.lit(1080))
    d = G.denormalize(box(50, 50, 100, 100), "0-1000", F.lit(1920), F.lit(1080))
    g = [
        G.guess_pixels(box(0.1, 0.1, 1.5, 0.5), F.lit(100), F.lit(100)).x1,
        G.guess_pixels(box(100, 0, 1200, 0), F.lit(100), F.lit(100)).x1,
        G.guess_pixels(box(100, 0, 1201, 0), F.lit(100), F.lit(100)).x1,
    ]
    r = one(spark, n.x1, n.y2, d.x1, d.y2, *g)
    assert [round(v, 9) for v in r] == [50, 100, 96, 108, 10, 10, 100]
    with pytest.raises(ValueError):
        G.normalize(box(0, 0, 1, 1), "percent", F.lit(1), F.lit(1))
    with pytest.raises(Exception, match="positive"):
        one(spark, G.normalize(box(0, 0, 1, 1), "0-1", F.lit(0), F.lit(1)).x1)


def test_crops_round_half_to_even(spark):
    c = G.crop_pixels(box(0.005, 0.015, 0.005, 0.5), F.lit(100), F.lit(100))
    assert list(one(spark, *c)) == [0, 2, 1, 50]
    assert list(one(spark, *G.corner_crop(F.lit(1920), F.lit(1080)))) == [1383, 843, 1920, 1080]


def test_text(spark):
    r = one(
        spark,
        text.clean_json(F.lit('```json\n{"a": 1}\n```')),
        text.numeric_suffix(F.lit("sample_000012")),
        text.numeric_suffix(F.lit("x_y")),
        text.frame_index(F.lit("frame_0007b2")),
        text.first_nonzero(F.lit(0.0), F.lit(0.4)),
        text.first_nonzero(F.lit(0.0), F.lit(0.0)),
        text.sample_id(F.lit(3)),
        text.response_text(F.lit('{"candidates":[{"content":{"parts":[{"x":1},{"text":"hi"}]}}]}')),
        text.event_label(F.lit("scroll")),
    )
    assert list(r) == ['{"a": 1}', 12, 0, 7, 0.4, 0.0, "sample_000003", "hi", "scroll_area"]
    assert one(spark, text.numbers(F.lit("<1, 2.5, -3, 4, 5>"))).c0 == [1, 2.5, -3, 4]
    with pytest.raises(Exception, match="too few"):
        one(spark, text.numbers(F.lit("1 2 3")))


def test_hash_bits_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(50)]
    got = {
        r.i: r.h for r in spark.createDataFrame(rows, "i int, b array<double>").select(
            "i", hashing.hash_bits(F.col("b")).alias("h"),
        ).collect()
    }
    for i, b in rows:
        want = int("".join("1" if v > np.median(b[1:]) else "0" for v in b), 2)
        assert got[i] % 2**64 == want


def test_pixels():
    flat, edge = np.full((40, 40), 100.0), np.zeros((40, 40))
    edge[:, 20:] = 255
    assert hashing.laplacian_variance(flat) == 0 and hashing.laplacian_variance(edge) > 50
    assert hashing.changed_ratio(flat, flat) == 0 and hashing.changed_ratio(flat, edge) == 1 and hashing.changed_ratio(flat, edge[:5]) == 1
    assert np.allclose(hashing.align(np.roll(edge, 3, axis=1), edge), edge)
    assert hashing.perceptual_block(edge).shape == (8, 8)


def test_perceptual_hash_of_a_fixed_image():
    """Coefficients by the cosine sum's own words on an image that needs no resize, and the hash of a fixed one."""
    y, x = np.mgrid[:32, :32]
    gray = ((x * 7 + y * y) % 256).astype(float)
    got = hashing.perceptual_block(gray)
    for u, v in ((0, 0), (0, 3), (5, 2), (7, 7)):
        waves = np.cos(np.pi * (2 * np.arange(32) + 1) * u / 64)[:, None] * np.cos(np.pi * (2 * np.arange(32) + 1) * v / 64)[None, :]
        scale = (1 / 32 if u == 0 else 1 / 16) ** 0.5 * (1 / 32 if v == 0 else 1 / 16) ** 0.5
        assert got[u, v] == pytest.approx(scale * (gray * waves).sum(), abs=1e-6)
    larger = np.kron(gray, np.ones((4, 4)))  # shrunk again it is nearly the same
    bits = lambda b: b.ravel() > np.median(b.ravel()[1:])
    assert (bits(hashing.perceptual_block(larger)) != bits(got)).sum() <= 4
