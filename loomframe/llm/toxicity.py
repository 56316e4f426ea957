"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words of a bounded sample of labelled rows, of either label; none is left out. A word weighs
(1 + ln count) * idf * lean: document frequencies are counted over all documents, and lean grows smoothly from `little`
to 1 with the evidence (likelihood ratio) that the word goes with label 1 in the sample, since plain cosine is ruled by
words that have nothing to do with the label. Every text that shares a word with an example has neighbours.

Blocks of alike examples stand in order of an upper bound from the largest weight of each term per block: the best are
read first, and reading ends when no block can reach the k-th best example, so the k nearest are exact. Texts whose
bounds leave too many blocks are multiplied with all examples instead, which gives the same neighbours. Votes weighted
by similarity, with the base rate as a prior, give the score; the nearest example of label 1 and the words that bring
it near are the evidence.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import ddl, released, scratch, ship, texts
from loomframe.llm.labelled import remainder, sample

_WORD = re.compile(r"[^\W_]+")
IDS = pa.list_(pa.int32())
EXAMPLES = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("terms", IDS), ("tf", IDS)])
VECTORS = pa.schema([("doc_id", pa.int64()), ("terms", IDS), ("tf", IDS)])
SCORES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("score", pa.float64()),
        ("neighbours", pa.list_(pa.int64())),
        ("similarities", pa.list_(pa.float64())),
        ("evidence", pa.list_(pa.string())),
    ]
)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Vectors:
    """Term counts of several texts: those of text i stand at starts[i]:starts[i + 1]."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        self.starts, self.terms, self.tf = starts, terms, tf

    def __len__(self) -> int:
        return len(self.starts) - 1

    @classmethod
    def of_texts(cls, every: list[str], vocabulary: dict[str, int]) -> Vectors:
        terms, tf, sizes = array("i"), array("i"), []
        for text in every:
            counts = Counter(words_of(text))
            terms.extend(map(vocabulary.get, counts, repeat(-1)))
            tf.extend(counts.values())
            sizes.append(len(counts))
        ids, n = np.array(terms, np.int32), np.array(tf, np.int32)
        known = ids >= 0
        ends = np.concatenate(([0], np.cumsum(known)))[np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))]
        return cls(ends, ids[known], n[known])

    @classmethod
    def of_batch(cls, batch) -> Vectors:
        terms, tf = batch.column("terms"), batch.column("tf")
        starts = np.asarray(terms.offsets).astype(np.int64)
        return cls(starts - starts[0], np.asarray(terms.flatten()), np.asarray(tf.flatten()))

    def columns(self) -> list[pa.Array]:
        offsets = pa.array(self.starts.astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (self.terms, self.tf)]

    def part(self, a: int, b: int) -> Vectors:
        s, e = self.starts[a], self.starts[b]
        return Vectors(self.starts[a : b + 1] - s, self.terms[s:e], self.tf[s:e])

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def weights(self, weight: np.ndarray) -> np.ndarray:
        """Of unit length for each text."""
        w = (1 + np.log(self.tf)) * weight[self.terms]
        rows = self.rows()
        return w / np.sqrt(np.bincount(rows, w * w, len(self)))[rows]


class Postings:
    """Entries (column, value) of terms: those of term t stand at starts[t]:starts[t + 1]."""

    def __init__(self, terms: np.ndarray, at: np.ndarray, values: np.ndarray, size: int) -> None:
        order = np.argsort(terms, kind="stable")
        self.starts = np.searchsorted(terms[order], np.arange(size + 1))
        self.at, self.values = at[order], values[order]

    def sums(self, rows: np.ndarray, terms: np.ndarray, w: np.ndarray, height: int, width: int) -> np.ndarray:
        """For each row the sum of w times the values of its terms, by column."""
        first = self.starts[terms]
        n = self.starts[terms + 1] - first
        ends = np.cumsum(n)
        entry = np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(n) else 0)
        cell = np.repeat(rows * width, n) + self.at[entry]
        return np.bincount(cell, np.repeat(w, n) * self.values[entry], height * width).reshape(height, width)


class BlockMaxIndex:
    """Unit vectors of examples by term, in blocks of examples. weight: the terms' weights, all above 0."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: Vectors, weight: np.ndarray, block: int = 32) -> None:
        self.weight, self.block = weight, block
        w = vectors.weights(weight)
        rows = []
        for i in range(len(vectors)):
            s, e = vectors.starts[i], vectors.starts[i + 1]
            if e > s:
                order = np.argsort(-w[s:e], kind="stable")
                rows.append((vectors.terms[s:e][order][:8].tolist(), int(ids[i]), int(labels[i]), vectors.terms[s:e], w[s:e]))
        rows.sort(key=lambda r: r[:3])  # alike examples share blocks, so that bounds are tight
        self.ids = np.array([r[1] for r in rows], np.int64)
        self.labels = np.array([r[2] for r in rows], np.int64)
        self.starts = np.concatenate(([0], np.cumsum([len(r[3]) for r in rows], dtype=np.int64)))
        self.terms = np.concatenate([np.zeros(0, np.int32), *(r[3] for r in rows)])
        self.values = np.concatenate([np.zeros(0), *(r[4] for r in rows)])
        self._open()

    def _open(self) -> None:
        """What is made anew in each process: the inverted lists, and room for a text's weights."""
        n, size = len(self.ids), len(self.weight)
        self.blocks = -(-n // self.block)
        at = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.starts))
        self.lists = Postings(self.terms, at, self.values, size)
        cell = self.terms.astype(np.int64) * max(1, self.blocks) + at // self.block
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.diff(cell[order], prepend=-1))
        top = np.maximum.reduceat(self.values[order], first) if len(first) else np.zeros(0)
        cell = cell[order][first]
        self.tops = Postings(cell // max(1, self.blocks), cell % max(1, self.blocks), top, size)
        frequent = np.flatnonzero(np.diff(self.lists.starts) >= max(32, n // 8))
        self.column = np.full(size, -1)
        self.column[frequent] = np.arange(len(frequent))
        self.full = np.zeros((len(frequent), n))
        for c, t in enumerate(frequent):
            entries = slice(self.lists.starts[t], self.lists.starts[t + 1])
            self.full[c, self.lists.at[entries]] = self.lists.values[entries]
        self.dense = np.zeros(size)
        #: Entries that a term adds to a search.
        self.entries = np.where(self.column < 0, np.diff(self.lists.starts), 0) + np.diff(self.tops.starts)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("weight", "block", "ids", "labels", "starts", "terms", "values")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def nearest(self, vectors: Vectors, k: int, patience: int = 6) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the k examples of largest cosine above 0, as (examples, cosines), ties to the smaller
        example; exact. patience: number of blocks left by the bounds beyond which all examples are multiplied."""
        none = (np.zeros(0, np.int64), np.zeros(0))
        out: list = [none] * len(vectors)
        if not len(self.ids):
            return out
        rows, w = vectors.rows(), vectors.weights(self.weight)
        bounds = self.tops.sums(rows, vectors.terms, w, len(vectors), self.blocks)
        wide = []
        for i in np.flatnonzero(bounds.any(axis=1)):
            own = slice(vectors.starts[i], vectors.starts[i + 1])
            found = self._by_blocks(bounds[i], vectors.terms[own], w[own], k, patience)
            if found is None:
                wide.append(i)
            else:
                out[i] = found
        if wide:
            for i, sums in zip(wide, self._all(np.array(wide), rows, vectors.terms, w, len(vectors)), strict=True):
                out[i] = self._best(np.arange(len(self.ids)), sums, k)
        return out

    def _by_blocks(
        self, bound: np.ndarray, terms: np.ndarray, w: np.ndarray, k: int, patience: int,
    ) -> tuple[np.ndarray, np.ndarray] | None:
        if np.count_nonzero(bound > 1) > patience:  # no cosine is above 1, so these would all be read
            return None
        order = np.argsort(-bound, kind="stable")
        self.dense[terms] = w
        at, dots = np.zeros(0, np.int64), np.zeros(0)
        for n, b in enumerate(order):
            least = dots[k - 1] - 1e-9 if len(dots) >= k else 0.0
            if bound[b] <= 0 or bound[b] < least:
                break
            if n == 2 and np.count_nonzero(bound >= least) > patience:
                at = None
                break
            first, last = b * self.block, min((b + 1) * self.block, len(self.ids))
            entries = slice(self.starts[first], self.starts[last])
            own = np.add.reduceat(self.values[entries] * self.dense[self.terms[entries]], self.starts[first:last] - self.starts[first])
            at, dots = self._best(np.concatenate((at, np.arange(first, last))), np.concatenate((dots, own)), k)
        self.dense[terms] = 0
        return None if at is None else (at, dots)

    def _all(self, wide: np.ndarray, rows: np.ndarray, terms: np.ndarray, w: np.ndarray, height: int) -> np.ndarray:
        """Cosines of the texts in wide with all examples: frequent terms by columns, the others by their lists."""
        place = np.full(height, -1)
        place[wide] = np.arange(len(wide))
        rows = place[rows]
        column = self.column[terms]
        rare, often = (rows >= 0) & (column < 0), (rows >= 0) & (column >= 0)
        sums = self.lists.sums(rows[rare], terms[rare], w[rare], len(wide), len(self.ids))
        used, at = np.unique(column[often], return_inverse=True)
        matrix = np.zeros((len(wide), len(used)))
        matrix[rows[often], at] = w[often]
        return sums + matrix @ self.full[used]

    @staticmethod
    def _best(at: np.ndarray, dots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(dots) > k:
            near = dots >= np.partition(dots, len(dots) - k)[-k] - 1e-11
            at, dots = at[near], dots[near]
        dots = np.round(dots, 12)
        at, dots = at[dots > 0], dots[dots > 0]
        order = np.lexsort((at, -dots))[:k]
        return at[order], dots[order]


class Scorer:
    """base: share of label 1 among examples; without: among examples without words."""

    def __init__(self, index: BlockMaxIndex, words: list[str], base: float, without: float, k: int, prior: float) -> None:
        self.index, self.words, self.base, self.without, self.k, self.prior = index, words, base, without, k, prior

    def near(self, vectors: Vectors, most: int = 250_000):
        """(texts' vectors, neighbours) of parts that read about `most` list entries, one text at least."""
        read = np.concatenate(([0], np.cumsum(self.index.entries[vectors.terms])))[vectors.starts]
        a = 0
        while a < len(vectors):
            b = max(a + 1, int(np.searchsorted(read, read[a] + most, "right")) - 1)
            part = vectors.part(a, b)
            yield part, self.index.nearest(part, self.k)
            a = b

    def score(self, at: np.ndarray, dots: np.ndarray) -> float:
        if not len(at):
            return self.without
        return float((dots @ self.index.labels[at] + self.prior * self.base) / (dots.sum() + self.prior))

    def scores(self, vectors: Vectors) -> np.ndarray:
        return np.array([self.score(*found) for _, every in self.near(vectors) for found in every])

    def explained(self, vectors: Vectors) -> list[tuple[float, list[int], list[float], list[str]]]:
        """score, neighbours, similarities, evidence of each text."""
        out = []
        for part, every in self.near(vectors):
            w = part.weights(self.index.weight)
            for i, (at, dots) in enumerate(every):
                own = slice(part.starts[i], part.starts[i + 1])
                marked = at[self.index.labels[at] == 1]
                evidence = self.evidence(int(marked[0]), part.terms[own], w[own]) if len(marked) else []
                out.append((self.score(at, dots), self.index.ids[at].tolist(), dots.tolist(), evidence))
        return out

    def evidence(self, example: int, terms: np.ndarray, w: np.ndarray, most: int = 5) -> list[str]:
        """The shared words that bring most of a text's similarity to an example, the largest first."""
        index = self.index
        own = slice(index.starts[example], index.starts[example + 1])
        index.dense[terms] = w
        parts = index.values[own] * index.dense[index.terms[own]]
        index.dense[terms] = 0
        return [self.words[index.terms[own][j]] for j in np.argsort(-parts, kind="stable")[:most] if parts[j] > 0]


def lean(n: np.ndarray, hits: np.ndarray, total: int, ones: int, little: float, enough: float) -> np.ndarray:
    """From little to 1 with the square of the evidence that a word goes with label 1; 1 from `enough` on."""
    share = ones / total if total else 0.0
    if not 0 < share < 1:
        return np.full(len(n), little)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda k, p: np.where(k > 0, k * np.log(k / (n * p)), 0.0)
        evidence = np.where(hits > n * share, 2 * (part(hits, share) + part(n - hits, 1 - share)), 0.0)
    return little + (1 - little) * np.minimum(1.0, (evidence / enough) ** 2)


def _sample_words(it):
    for batch in it:
        found = {w for text in texts(batch) for w in words_of(text)}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["term"])


def _vectors(shipped, keep: list[str], schema: pa.Schema):
    def run(it):
        for batch in it:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                found = Vectors.of_texts(texts(part), shipped.value)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *found.columns()], schema=schema)

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    folds: int = 5,
    held_out: int = 0,
    sample_rows: int = 3_000,
    little: float = 0.05,
    enough: float = 26.0,
    k: int = 15,
    prior: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[dict[str, int], Scorer, DataFrame]:
    """Vocabulary, scorer, and the term counts of all docs as a table (doc_id, terms, tf).

    Examples are at most sample_rows labelled rows outside the held-out fold; little, enough: see lean().
    """
    spark = docs.sparkSession
    ship(spark)
    rows = sample(docs, labels, label, folds, held_out, sample_rows, id_col, text_col)
    words = sorted(rows.mapInArrow(_sample_words, "term string").distinct().toArrow().column("term").to_pylist())  # bounded by sample_rows
    vocabulary = {w: i for i, w in enumerate(words)}
    shipped = spark.sparkContext.broadcast(vocabulary)
    found = rows.mapInArrow(_vectors(shipped, ["doc_id", "y"], EXAMPLES), ddl(EXAMPLES)).toArrow().sort_by("doc_id").combine_chunks()  # bounded by sample_rows
    ids, ys = found.column("doc_id").to_numpy(), found.column("y").to_numpy()
    batches = found.to_batches()
    vectors = Vectors.of_batch(batches[0]) if batches else Vectors(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    every = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    table = scratch(every.mapInArrow(released(_vectors(shipped, ["doc_id"], VECTORS)), ddl(VECTORS)), "term-counts")
    counted = table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()  # bounded by the vocabulary
    frequencies = np.zeros(len(words))
    frequencies[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    total, ones = len(ys), int(ys.sum())
    n = np.bincount(vectors.terms, minlength=len(words)).astype(float)
    hits = np.bincount(vectors.terms, ys[vectors.rows()], len(words)) if total else np.zeros(len(words))
    idf = np.log((1 + table.count()) / (1 + frequencies)) + 1
    index = BlockMaxIndex(ids, ys, vectors, idf * lean(n, hits, total, ones, little, enough))
    base = (ones + 1) / (total + 2)
    bare = ys[np.diff(vectors.starts) == 0]
    return vocabulary, Scorer(index, words, base, (int(bare.sum()) + 2 * base) / (len(bare) + 2), k, prior), table


def keep_clean(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    folds: int = 5,
    held_out: int = 0,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """The rows of docs, all columns unchanged, whose score is below threshold; filtered in one pass, no join.

    Null text counts as empty. Repeated rows and null ids are rows like others; an empty table stays empty.
    """
    vocabulary, scorer, _ = fit(docs, labels, label, folds, held_out, id_col=id_col, text_col=text_col, **options)
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary, scorer))

    def run(it):
        vocabulary, scorer = shipped.value
        for batch in it:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                scores = scorer.scores(Vectors.of_texts(texts(part, text_col), vocabulary))
                yield part.filter(pa.array(scores < threshold, pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    folds: int = 5,
    held_out: int = 0,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """id_col, held_out, score, predicted, and as evidence neighbours (ids), similarities and words: a row per row.

    The score is near the share of label 1 among texts like this one. Null text counts as empty; a text that shares no
    word with an example has the share of label 1 among examples without words and no neighbours. Evidence: up to five
    words shared with the nearest example of label 1; none if no neighbour has it. Without labelled rows of both labels
    every score is near the smoothed base rate. Only the text enters a score. Repeated rows and null ids are rows like
    others; other columns are ignored; an empty table gives no rows.
    """
    _, scorer, table = fit(docs, labels, label, folds, held_out, id_col=id_col, text_col=text_col, **options)
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(it):
        scorer = shipped.value
        for batch in it:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                found = zip(*scorer.explained(Vectors.of_batch(part)), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(v, f.type) for v, f in zip(found, list(SCORES)[1:], strict=True))], schema=SCORES,
                )

    out = table.mapInArrow(released(run), ddl(SCORES))
    held = (remainder("doc_id", folds) == held_out).alias("held_out")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return out.select(F.col("doc_id").alias(id_col), held, "score", predicted, "neighbours", "similarities", "evidence")
