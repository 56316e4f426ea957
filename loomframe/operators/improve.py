"""Judging labels, preference pairs, iteration history, weight search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.geometry import Box, contains
from loomframe.operators.split import numbered
from loomframe.runtime import checkpoint


def heuristic(
    b: Box,
    x: Column,
    y: Column,
    confidence: Column,
    width: Column,
    height: Column,
    least_area: float = 0.0001,
    most_area: float = 0.5,
    most_aspect: float = 10.0,
) -> Column:
    """struct of score, click_inside, area_ratio, aspect_ratio (null: infinite), confidence, penalties."""
    bw, bh = b.x2 - b.x1, b.y2 - b.y1
    ratio = F.greatest(F.lit(0.0), bw * bh) / F.greatest(F.lit(1.0), (width * height).cast("double"))
    flat = (bw <= 0) | (bh <= 0)
    aspect = F.when(~flat, F.greatest(bw / bh, bh / bw))
    inside = F.coalesce(contains(b, x, y), F.lit(False))
    tests = [
        ("bbox_too_small", ratio < least_area, 0.3),
        ("bbox_too_large", ratio > most_area, 0.3),
        ("extreme_aspect_ratio", flat | (aspect > most_aspect), 0.2),
        ("click_outside_bbox", ~inside, 0.3),
        ("low_confidence", confidence < 0.3, 0.2),
    ]
    total = sum((F.when(t, F.lit(n)).otherwise(F.lit(0.0)) for _, t, n in tests), F.lit(0.0))
    score = F.when(flat, F.lit(0.0)).otherwise(clamp(1.0 - total))
    names = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t, _ in tests), F.when(flat, F.lit("degenerate_bbox"))))
    return F.struct(
        score.alias("score"),
        inside.alias("click_inside"),
        ratio.alias("area_ratio"),
        aspect.alias("aspect_ratio"),
        confidence.alias("confidence"),
        names.alias("penalties"),
    )


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def ensemble(vision: Column, rule: Column, vision_weight: float = 0.6, rule_weight: float = 0.4) -> Column:
    return vision_weight * vision + rule_weight * rule


def normalize_weights(weights: Column) -> Column:
    """A map of weights to sum 1; a sum of 0 changes nothing."""
    total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, x: a + x)
    return F.when(total == 0, weights).otherwise(F.transform_values(weights, lambda k, v: v / total))


def ranked(rows: DataFrame, score: str, order: str, name: str = "rank") -> DataFrame:
    """rows with rank from 1 by falling score, ties in order; in ranges of (score, order), so no task holds all rows
    and equal scores are dealt out like others."""
    return numbered(rows, [F.desc(score), F.col(order)], name).withColumn(name, F.col(name) + 1)


#: Blocks that a side of paired rows is cut into at most, rows of a block at least, places of a pack and of a turn.
BLOCKS, LEAST_BLOCK, PACK, TURN = 32, 1024, 256, 64


def _apart(chosen: DataFrame, rejected: DataFrame, margin: float, rank: bool = False) -> DataFrame:
    """Pairs of rows whose chosen_score is margin over rejected_score (rank: and __i < __j), with the columns of both.

    chosen has its place from 1 as __i, rejected as __j, in order of falling score. Blocks of places meet in tiles, one
    group of an equi-join a tile, so no side is broadcast or read again for each part of the other. Tiles whose best and
    worst scores are nearer than margin are left out. A row goes to at most BLOCKS tiles: what is shuffled grows with the
    rows, only what is returned with their square. The rejected rows of a block travel in packs of PACK places, and a pack
    meets TURN chosen places at a time: a column then repeats within some hundred rows or stays the same for as many,
    whatever the size of a block, and Parquet packs both into a few bits a pair. Whole blocks in turn took more bytes for
    each pair the larger the blocks were, since a page of 20,000 rows holds few of them.
    """

    def blocks(side: DataFrame, place: str, block: str, *more: Column) -> DataFrame:
        ends = side.agg(F.min(place).alias("__first"), F.max(place).alias("__last"))  # one row
        size = F.greatest(F.lit(LEAST_BLOCK), F.ceil((F.col("__last") - F.col("__first") + 1) / BLOCKS))
        return side.crossJoin(F.broadcast(ends)).withColumn(block, F.floor((F.col(place) - F.col("__first")) / size)).select("*", *more).drop("__first", "__last")

    places = lambda place, size: F.floor((F.col(place) - F.col("__first")) / size)
    a = blocks(chosen, "__i", "__a", places("__i", TURN).alias("__turn"))
    b = blocks(rejected, "__j", "__b", places("__j", PACK).alias("__pack"))
    turns = F.min("__turn").alias("__low"), F.max("__turn").alias("__high")
    best = a.groupBy("__a").agg(F.max("chosen_score").alias("__best"), F.min("__i").alias("__from"), *turns)
    worst = b.groupBy("__b").agg(F.min("rejected_score").alias("__worst"), F.max("__j").alias("__to"))
    meet = F.col("__best") - F.col("__worst") >= margin
    tiles = checkpoint(best.join(F.broadcast(worst), meet & (F.col("__from") < F.col("__to")) if rank else meet).select("__a", "__b", "__low", "__high"))
    parts = max(1, tiles.count())  # at most BLOCKS * BLOCKS
    packs = b.groupBy("__b", "__pack").agg(F.sort_array(F.collect_list(F.struct("__j", *rejected.drop("__j").columns))).alias("__rows"))
    b = packs.join(F.broadcast(tiles), "__b").repartition(parts, "__a", "__b").withColumn("__at", F.explode(F.sequence("__low", "__high"))).alias("b")
    a = a.join(F.broadcast(tiles.select("__a", "__b")), "__a").repartition(parts, "__a", "__b").alias("a")
    # a difference, since an equality would become a key of the join, by which both sides would be shuffled again
    meeting = (F.col("a.__a") == F.col("b.__a")) & (F.col("a.__b") == F.col("b.__b")) & (F.col("__at") - F.col("__turn") == 0)
    both = b.hint("merge").join(a, meeting).select(*chosen.columns, F.inline("__rows"))
    kept = F.col("chosen_score") - F.col("rejected_score") >= margin
    return both.where(kept & (F.col("__i") < F.col("__j")) if rank else kept).drop("__i", "__j")


def _top_bottom(judged: DataFrame, key: str, score: str, order: str, share: float) -> tuple[DataFrame, DataFrame]:
    """The best k and the worst k, k = max(1, int(n * share)), with their places: the two sides of top_bottom_pairs."""
    places = checkpoint(ranked(judged.select(*dict.fromkeys((key, score, order))), score, order))
    n = places.agg(F.count("*").alias("__n")).withColumn("__k", F.greatest(F.lit(1), (F.col("__n") * share).cast("int")))
    both = places.crossJoin(F.broadcast(n))  # one row
    top = both.where(F.col("rank") <= F.col("__k")).select(F.col(key).alias("chosen"), F.col(score).alias("chosen_score"), F.col("rank").alias("__i"))
    low = both.where(F.col("rank") > F.col("__n") - F.col("__k"))
    return top, low.select(F.col(key).alias("rejected"), F.col(score).alias("rejected_score"), F.col("rank").alias("__j"))


def top_bottom_pairs(judged: DataFrame, key: str, score: str, order: str, share: float = 0.3, margin: float = 0.1) -> DataFrame:
    """chosen, rejected, scores: each of the best k with each of the worst k, k = max(1, int(n * share)), a margin apart.

    All pairs are the result that is asked for, and grow with the square of the rows: judge a bounded set or lower share.
    """
    top, low = _top_bottom(judged, key, score, order, share)
    return _apart(top, low, margin).select("chosen", "chosen_score", "rejected", "rejected_score")


#: Chosen rows up to which ranked_pairs sends them to every task: a few numbers each.
FEW = 10_000


def ranked_pairs(judged: DataFrame, key: str, score: str, order: str, margin: float = 0.1) -> DataFrame:
    """chosen, rejected, scores by the original's rule: it walks down from each row and stops at the first gap below
    margin, so a row whose next neighbour is nearer than margin has no pairs, and any other has all rows below it.

    Scores from 0 to 1 have at most 1 / margin such rows, so the pairs are about that many times the rows.
    """
    places = ranked(judged, score, order)
    after = places.select((F.col("rank") - 1).alias("rank"), F.col(score).alias("__next"))
    a = places.join(after, "rank").where(F.col(score) - F.col("__next") >= margin)
    a = checkpoint(a.select(F.col(key).alias("chosen"), F.col(score).alias("chosen_score"), F.col("rank").alias("__i")))
    b = places.select(F.col(key).alias("rejected"), F.col(score).alias("rejected_score"), F.col("rank").alias("__j"))
    a = F.broadcast(a) if a.count() <= FEW else a
    return b.join(a, F.col("__i") < F.col("__j")).select("chosen", "rejected", "chosen_score", "rejected_score")


def margin_pairs(judged: DataFrame, key: str, score: str, order: str, margin: float = 0.1) -> DataFrame:
    """chosen, rejected, scores: all rows of a better rank with those at least margin below.

    All pairs are the result that is asked for, and grow with the square of the rows: judge a bounded set.
    """
    places = checkpoint(ranked(judged.select(*dict.fromkeys((key, score, order))), score, order))
    a = places.select(F.col(key).alias("chosen"), F.col(score).alias("chosen_score"), F.col("rank").alias("__i"))
    b = places.select(F.col(key).alias("rejected"), F.col(score).alias("rejected_score"), F.col("rank").alias("__j"))
    return _apart(a, b, margin, rank=True).select("chosen", "chosen_score", "rejected", "rejected_score")


def _side(samples: DataFrame, name: str, key: str, prompt: str, box: str, path: str) -> DataFrame:
    text = F.coalesce(F.nullif(F.col(prompt), F.lit("")), F.lit("detect the UI element"))
    return samples.select(F.col(key).alias(name), text.alias(f"{name}_prompt"), F.col(box).alias(f"{name}_bbox"), F.col(path).alias(f"{name}_image_path"))


def pair_records(pairs: DataFrame, samples: DataFrame, key: str, prompt: str, box: str, path: str) -> DataFrame:
    """Pairs with prompt, box and image of both sides; pairs with an unknown side go. Moves every pair twice: see
    top_bottom_records."""
    side = lambda name: _side(samples, name, key, prompt, box, path)
    return pairs.join(side("chosen"), "chosen").join(side("rejected"), "rejected")


def top_bottom_records(judged: DataFrame, samples: DataFrame, key: str, score: str, order: str, prompt: str, box: str, path: str, share: float = 0.3, margin: float = 0.1) -> DataFrame:
    """pair_records of top_bottom_pairs. Places are those among all judged rows; each side then gets its records, or
    goes, before it is paired, so that rows are joined and not their pairs."""
    top, low = _top_bottom(judged, key, score, order, share)
    chosen = top.join(_side(samples, "chosen", key, prompt, box, path), "chosen")
    return _apart(chosen, low.join(_side(samples, "rejected", key, prompt, box, path), "rejected"), margin)


#: The history of iterations has one row an iteration; its windows need no partitioning.
def _history(order: str):
    return Window.orderBy(order)


def trends(history: DataFrame, score: str, order: str) -> DataFrame:
    """trend against the iteration before (0 before the first): = within 0.001, ^ or v; blank for iteration 1."""
    change = F.col(score) - F.lag(score, 1, 0.0).over(_history(order))
    return history.withColumn("trend", F.when(F.col(order) <= 1, " ").when(F.abs(change) < 0.001, "=").when(change > 0, "^").otherwise("v"))


def best_iteration(history: DataFrame, score: str, order: str) -> DataFrame:
    """best (first on ties), best_score, last iteration."""
    return history.agg(
        F.max_by(order, F.struct(F.col(score), -F.col(order))).alias("best"), F.max(score).alias("best_score"), F.max(order).alias("last"),
    )


def stalled(history: DataFrame, score: str, order: str, patience: int, threshold: float = 0.0) -> DataFrame:
    """stalled: the reference rule, true for any positive threshold once patience + 1 iterations exist;
    no_gain: none of the last `patience` is over the best before them by more than the threshold."""
    last = F.row_number().over(Window.orderBy(F.desc(order)))
    marked = history.withColumn("__back", last)
    best = F.max(score).over(Window.partitionBy())
    marked = marked.withColumn("__best", best).withColumn(
        "__isbest", F.col(order) == F.max_by(order, F.struct(F.col(score), -F.col(order))).over(Window.partitionBy()),
    )
    recent = F.col("__back") <= patience
    rule = (F.col("__best") - F.col(score) > -threshold) & (F.col(score) - F.col("__best") < threshold)
    enough = F.count("*") >= patience + 1
    gain = F.max(F.when(recent, F.col(score))) - F.max(F.when(~recent, F.col(score)))
    return marked.agg(
        (enough & F.coalesce(F.bool_and(F.when(recent & ~F.col("__isbest"), rule)), F.lit(True))).alias("stalled"),
        (enough & (gain <= threshold)).alias("no_gain"),
    )


def improved(history: DataFrame, score: str, order: str) -> DataFrame:
    """improved: over the best of all earlier iterations; the first always."""
    before = F.max(score).over(_history(order).rowsBetween(Window.unboundedPreceding, -1))
    return history.withColumn("improved", F.coalesce(F.col(score) > before, F.lit(True)))


def last_best(history: DataFrame, score: str, order: str) -> DataFrame:
    """Checkpoint kept by training: later epochs win ties."""
    return history.agg(F.max_by(order, F.struct(score, order)).alias("epoch"))


def search_weights(samples: DataFrame, candidates: DataFrame, objective: Column) -> DataFrame:
    """candidate, value: the objective's mean over the samples for each of a short list of weight candidates, one job."""
    return samples.crossJoin(F.broadcast(candidates)).groupBy("candidate").agg(F.avg(objective).alias("value"))


def report(history: DataFrame, score: str, order: str) -> DataFrame:
    """line: text rows of the iteration report, in order."""
    t = trends(history, score, order)
    return t.select(F.col(order), F.format_string("  %4d  %7.4f  %5s", F.col(order), F.col(score), F.col("trend")).alias("line"))
