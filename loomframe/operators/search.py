"""Search for the best parameters: a Parzen-tree estimator over the history of trials, and median pruning.

The history of trials is short (some hundred rows) and stays with the driver; what is expensive, the objective over the
samples, is one Spark job for a whole generation of candidates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trials before the estimator takes over, share of trials that count as good (25 at most), candidates it draws a trial.
STARTUP, GOOD, MOST_GOOD, TRIES = 10, 0.1, 25, 24
#: Trials that a step must have seen before it prunes.
SEEN = 5


@dataclass(frozen=True)
class Range:
    """Numbers from low to high; log: spread by their logarithm; whole: integers."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def inner(self, value: float) -> float:
        return math.log(value) if self.log else float(value)

    def outer(self, value: float):
        out = min(self.high, max(self.low, math.exp(value) if self.log else value))
        return int(round(out)) if self.whole else float(out)

    @property
    def bounds(self) -> tuple[float, float]:
        return self.inner(self.low), self.inner(self.high)


#: A parameter is a Range or a tuple of choices.
Space = dict[str, "Range | tuple"]


@dataclass
class Trial:
    number: int
    params: dict
    value: float | None = None
    #: Mean of the objective after each step that the trial has seen.
    steps: list[float] = field(default_factory=list)
    pruned: bool = False


class Parzen:
    """A mixture of normals about the values seen and one about the middle, cut to the bounds. A value's width is the
    larger of the gaps to its neighbours, within a share of the range that falls with the number of values."""

    def __init__(self, values: list[float], low: float, high: float) -> None:
        middle = (low + high) / 2
        at = np.array(sorted([*values, middle]))
        padded = np.concatenate(([low], at, [high]))
        width = np.maximum(padded[1:-1] - padded[:-2], padded[2:] - padded[1:-1])
        span = high - low
        width = np.clip(width, span / min(100, len(at) + 1), span)
        width[np.flatnonzero(at == middle)[0]] = span
        self.at, self.width, self.low, self.high = at, width, low, high
        inside = lambda x: 0.5 * (1 + np.vectorize(math.erf)((x - at) / (width * math.sqrt(2))))
        self.mass = np.maximum(inside(high) - inside(low), 1e-12)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        which = rng.integers(len(self.at), size=n)
        out = rng.normal(self.at[which], self.width[which])
        for _ in range(100):
            beyond = (out < self.low) | (out > self.high)
            if not beyond.any():
                break
            out[beyond] = rng.normal(self.at[which[beyond]], self.width[which[beyond]])
        return np.clip(out, self.low, self.high)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.at) / self.width
        each = np.exp(-0.5 * z * z) / (self.width * math.sqrt(2 * math.pi) * self.mass)
        return np.log(np.maximum(each.mean(axis=1), 1e-300))


def suggest(history: list[Trial], space: Space, rng: np.random.Generator) -> dict:
    """Parameters of the next trial: at random until STARTUP trials are done, then for each parameter the drawn value that
    is likeliest among good trials against the others. A pruned trial counts as worse than any that wasn't."""
    seen = [t for t in history if t.value is not None]
    if len(seen) < STARTUP:
        return {n: s.outer(rng.uniform(*s.bounds)) if isinstance(s, Range) else s[rng.integers(len(s))] for n, s in space.items()}
    ordered = sorted(seen, key=lambda t: (t.pruned, -t.value, t.number))
    cut = min(MOST_GOOD, math.ceil(GOOD * len(seen)))
    out = {}
    for name, s in space.items():
        good, rest = ([t.params[name] for t in part] for part in (ordered[:cut], ordered[cut:]))
        if isinstance(s, Range):
            one, two = (Parzen([s.inner(v) for v in values], *s.bounds) for values in (good, rest))
            drawn = one.draw(rng, TRIES)
            out[name] = s.outer(float(drawn[np.argmax(one.log_density(drawn) - two.log_density(drawn))]))
        else:
            share = lambda values: np.array([values.count(c) + 1.0 for c in s]) / (len(values) + len(s))  # noqa: B023, E731
            one, two = share(good), share(rest)
            drawn = rng.choice(len(s), size=TRIES, p=one)
            out[name] = s[int(drawn[np.argmax(one[drawn] / two[drawn])])]
    return out


def prune(trial: Trial, history: list[Trial]) -> bool:
    """Whether the trial's latest step lies below the median of the other trials at that step."""
    k = len(trial.steps) - 1
    others = [t.steps[k] for t in history if t is not trial and len(t.steps) > k]
    return len(others) >= SEEN and trial.steps[k] < float(np.median(others))


def search(
    samples: DataFrame,
    space: Space,
    objective: Column,
    key: str,
    trials: int = 30,
    together: int = 6,
    steps: int = 2,
    seed: int = 0,
    history: list[Trial] | None = None,
) -> list[Trial]:
    """The history with `trials` more trials that look for the highest mean of the objective over the samples.

    objective: a column of samples and of w, a struct of the parameters. `together` candidates are a generation. Samples are
    dealt into `steps` parts by the hash of their key; a generation sees a part a job, and candidates that prune()
    rejects after one don't see the next. Choices must be of one type a parameter. The same seed gives the same trials.
    """
    spark = samples.sparkSession
    past = list(history or [])
    dealt = samples.withColumn("__part", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(steps)))
    while trials > 0:
        first = len(past)
        new = []
        for k in range(min(together, trials)):
            rng = np.random.default_rng([seed, first + k])  # a trial's own, so that runs may be cut anywhere
            new.append(Trial(first + k, suggest(past, space, rng)))
        past += new
        trials -= len(new)
        sums = {t.number: [0.0, 0] for t in new}
        for part in range(steps):
            open_ = [t for t in new if not t.pruned]
            if not open_:
                break
            rows = [(t.number, *(t.params[n] for n in space)) for t in open_]
            kinds = ", ".join(f"`{n}` {_kind(s)}" for n, s in space.items())
            table = spark.createDataFrame(rows, f"trial int, {kinds}").select("trial", F.struct(*(F.col(f"`{n}`") for n in space)).alias("w"))
            met = dealt.where(F.col("__part") == part).crossJoin(F.broadcast(table))  # a generation: a few rows
            for r in met.groupBy("trial").agg(F.sum(objective).alias("total"), F.count(objective).alias("n")).collect():
                sums[r["trial"]][0] += r["total"] or 0.0
                sums[r["trial"]][1] += r["n"]
            for t in open_:
                total, n = sums[t.number]
                t.value = total / n if n else 0.0
                t.steps.append(t.value)
            if part < steps - 1:
                for t in open_:
                    t.pruned = prune(t, past)
    return past


def _kind(s) -> str:
    if isinstance(s, Range):
        return "int" if s.whole else "double"
    return "string" if isinstance(s[0], str) else "int" if isinstance(s[0], int) else "double"


def best(history: list[Trial]) -> Trial | None:
    """The trial of highest value among those that weren't pruned, the first of equal ones."""
    done = [t for t in history if t.value is not None and not t.pruned]
    return max(done, key=lambda t: (t.value, -t.number), default=None)
