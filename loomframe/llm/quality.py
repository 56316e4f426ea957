"""Quality classifier: supervised subword embeddings.

Every word and its n-grams of characters are hashed to rows of one table, and a word that repeats the one before it adds
one more row (the word pair as a feature); a document is the mean of its rows, softmax on top. The table is trained by
stochastic gradient descent in numpy on a bounded, documented sample of labelled rows. A trained model is linear in the
mean, so each row of the table becomes one number for scoring and each word's sum is remembered per worker in a bounded
memory. Words that aren't known yet are hashed together, in numpy. Every document is scored on its whole text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import ddl, released, ship, texts
from loomframe.llm.labelled import remainder, sample

#: Multiplier of the n-gram hash (2^64 divided by the golden ratio, odd).
MIX = np.uint64(0x9E3779B97F4A7C15)
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
EXAMPLES = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("rows", pa.binary()), ("counts", pa.binary())])
TRAINED = pa.schema([("weights", pa.binary()), ("bias", pa.float64())])


def subwords(words: list[str], buckets: int, low: int = 2, high: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(rows, ends): the rows of word i are rows[ends[i]:ends[i + 1]].

    A word's rows are itself and the n-grams of the characters of <word>, from low to high. Very long words have all.
    """
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    text = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    of_word = [np.arange(len(words))]
    found = [np.fromiter((crc32(m.encode("utf-8", "replace"), 7) for m in marked), np.int64, len(marked)) % buckets]
    for k in range(low, high + 1):
        n = len(text) - k + 1
        if n < 1:
            continue
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = (h ^ text[j : j + n]) * MIX
            h ^= h >> np.uint64(29)
        inside = word[:n] == word[k - 1 :]
        of_word.append(word[:n][inside])
        found.append((h[inside] >> np.uint64(16)).astype(np.int64) % buckets)
    owner, rows = np.concatenate(of_word), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def repeats(words: list[str]) -> int:
    """Words that equal the one before them."""
    return sum(map(eq, words, words[1:]))


def repeat_row(buckets: int) -> int:
    return crc32(b"<repeated>", 7) % buckets


@dataclass(frozen=True)
class Model:
    """weights: one number per row of the table; bias: log-odds of label 1 for an empty text."""

    weights: np.ndarray
    bias: float

    def scorer(self, remember: int = 100_000, together: int = 10_000):
        """A function from texts to their scores. together: number of new words that are hashed at once."""
        known: dict[str, complex] = {}
        weights, buckets = self.weights.astype(np.float64), len(self.weights)
        again = complex(float(weights[repeat_row(buckets)]), 1)

        def learn(words: list[str]) -> None:
            rows, ends = subwords(words, buckets)
            sums = np.add.reduceat(weights[rows], ends[:-1])
            known.update(zip(words, (sums + 1j * np.diff(ends)).tolist(), strict=True))

        def scores(every: list[str]) -> list[float]:
            if len(known) > remember:
                known.clear()
            split = [text.split() for text in every]
            new = list({w for words in split for w in words if w not in known})
            for k in range(0, len(new), together):
                learn(new[k : k + together])
            totals = np.array([sum(map(known.__getitem__, words)) + again * repeats(words) for words in split], complex)
            z = self.bias + totals.real / np.maximum(totals.imag, 1)
            for w in new:  # a very long word isn't kept
                if len(w) > 60:
                    del known[w]
            return (1 / (1 + np.exp(-np.clip(z, -50, 50)))).tolist()

        return scores


def train(
    examples: list[tuple[np.ndarray, np.ndarray, int]],
    buckets: int,
    dim: int = 8,
    epochs: int = 8,
    least_steps: int = 20_000,
    rate: float = 4.0,
    seed: int = 11,
) -> Model:
    """examples: (distinct rows, counts, label). Plain SGD, one document at a time, with a linearly falling rate.

    Few examples are gone through more often, so that there are least_steps steps in all.
    """
    if not examples:
        return Model(np.zeros(buckets, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    ones = sum(y for *_, y in examples)
    bias = np.log(np.array([len(examples) - ones + 1.0, ones + 1.0])).astype(np.float32)
    epochs = max(epochs, -(-least_steps // len(examples)))
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            rows, counts, y = examples[k]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(rows):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            own = table[rows]
            hidden = share @ own
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1  # gradient of the loss by z
            back = out.T @ p
            out -= lr * 0.25 * np.outer(p, hidden)
            table[rows] = own - lr * share[:, None] * back[None, :]
    return Model(table @ (out[1] - out[0]), float(bias[1] - bias[0]))


def _featurise(buckets: int):
    def run(it):
        for batch in it:
            rows, counts = [], []
            for text in texts(batch):
                words = text.split()
                every = Counter(words)
                own, ends = subwords(list(every), buckets)
                times = np.repeat(np.fromiter(every.values(), np.int64, len(every)), np.diff(ends))
                n = np.bincount(np.append(own, repeat_row(buckets)), np.append(times, repeats(words)))
                found = np.flatnonzero(n)
                rows.append(found.astype(np.int32).tobytes())
                counts.append(n[found].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(rows, pa.binary()), pa.array(counts, pa.binary())], schema=EXAMPLES,
            )

    return run


def _train(buckets: int):
    """All examples in one task; their number is bounded by the sample."""

    def run(it):
        found = []
        for batch in it:
            found += zip(*(batch.column(k).to_pylist() for k in ("doc_id", "rows", "counts", "y")), strict=True)
        found.sort(key=lambda r: r[0])
        model = train([(np.frombuffer(rows, np.int32), np.frombuffer(counts, np.int32), y) for _, rows, counts, y in found], buckets)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias])], schema=TRAINED,
        )

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    folds: int = 4,
    held_out: int = 2,
    sample_rows: int = 5000,
    buckets: int = 1 << 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Model trained on at most sample_rows labelled rows whose id isn't held out, in one task on an executor."""
    ship(docs.sparkSession)
    rows = sample(docs, labels, label, folds, held_out, sample_rows, id_col, text_col)
    examples = rows.mapInArrow(released(_featurise(buckets)), ddl(EXAMPLES)).repartition(1)
    found = examples.mapInArrow(released(_train(buckets)), ddl(TRAINED)).collect()  # one row of `buckets` numbers
    return Model(np.frombuffer(found[0]["weights"], np.float32), found[0]["bias"])


def apply(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(it):
        scores = shipped.value.scorer()
        for batch in it:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(texts(part)), pa.float64())], schema=SCORES)

    return rows.mapInArrow(released(run), ddl(SCORES))


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    folds: int = 4,
    held_out: int = 2,
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """The rows of docs, all columns unchanged, whose score is threshold or more; filtered in one pass, no join.

    Null text counts as empty. Repeated rows and null ids are rows like others; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, folds, held_out, id_col=id_col, text_col=text_col, **options))

    def run(it):
        scores = model.value.scorer()
        for batch in it:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield part.filter(pa.array(np.array(scores(texts(part, text_col))) >= threshold, pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    folds: int = 4,
    held_out: int = 2,
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """id_col, held_out, score, predicted: one row per input row, on its whole text.

    Null text counts as empty and has the score of the base rate; a null id is held out in no fold but its own rule
    (the empty text's remainder). Without labelled rows every score is 0.5. Only the text enters a score. Other
    columns are ignored.
    """
    model = fit(docs, labels, label, folds, held_out, id_col=id_col, text_col=text_col, **options)
    out = apply(model, docs, id_col, text_col)
    return out.select(
        F.col("doc_id").alias(id_col),
        (remainder("doc_id", folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
