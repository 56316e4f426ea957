"""How far each source of a language departs from the others in its words, and by which words.

Words are counted per task in a bounded memory, so that a frequent word leaves a task as one row. A word's counts in the
sources of its language are a sparse vector; words of equal vectors are grouped, and everything that depends on counts
alone is evaluated once per distinct vector and multiplied by the number of its words. Names of words come back for the
ranking only.

The divergence of two sources is a sum over all kept words of f(p, q). Most words are absent from most sources, so the
sum is taken apart by absence: a word absent from both adds f of the two values for zero, which hold for all such
words; a word that one of them has adds what depends on that one's count alone, evaluated once per distinct count; only
words that both have need their pair, evaluated once per distinct vector that holds both. The parts add up exactly.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import ddl, scratch, ship

UNIT = 1_000_000_000
#: Runs of ASCII letters and of all characters beyond ASCII, as bytes of lower-cased UTF-8.
TERM = re.compile(rb"[a-z\x80-\xff]+")
_NOT_TERM = re.compile(rb"[^a-z\x80-\xff]")
#: Bytes of a text that are cut into words at once, and words that a task counts before it hands on what it has.
STRETCH, HELD = 1 << 20, 300_000
#: Pairs that are evaluated at once, and most sources of a language whose sums a task keeps as a square.
PAIRS, SQUARE = 1 << 20, 1000
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
SUMS = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])


def terms_of(text: bytes):
    """The words of a text, a stretch at a time."""
    low, at = text.lower(), 0  # bytes.lower() knows A-Z only
    while at < len(low):
        cut = _NOT_TERM.search(low, at + STRETCH)
        end = cut.start() if cut else len(low)
        yield TERM.findall(low, at, end)
        at = end


def _count(it):
    counts: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def handed():
        for (lang, source), held in counts.items():
            own = docs[lang, source]
            terms = list(held)
            for k in range(0, len(terms), 50_000):
                part = terms[k : k + 50_000]
                columns = [
                    pa.array([lang] * len(part), pa.string()),
                    pa.array([source] * len(part), pa.string()),
                    pa.array([t.decode() for t in part], pa.string()),
                    pa.array([held[t] for t in part], pa.int64()),
                    pa.array([own[t] for t in part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=COUNTS)
        counts.clear()
        docs.clear()

    for batch in it:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seen: set[bytes] = set()
            for words in terms_of(text):
                counts[lang, source].update(words)
                seen.update(words)
            docs[lang, source].update(seen)
        if sum(map(len, counts.values())) > HELD:
            yield from handed()
    yield from handed()


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def shared_sums(group: np.ndarray, p: np.ndarray, zero: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, value) of vectors of one length, by row: what a pair that both sources have adds beyond what each adds alone.

    group, p, zero: the sources' numbers, values and values for zero; times: how many words have the vector.
    """
    pa_, pb, za, zb = p[:, :, None], p[:, None, :], zero[:, :, None], zero[:, None, :]
    value = (f(pa_, pb) - f(pa_, zb) - f(za, pb) + f(za, zb)) * times[:, None, None]
    n, k = group.shape
    a, b = np.broadcast_to(group[:, :, None], (n, k, k)), np.broadcast_to(group[:, None, :], (n, k, k))
    off = ~np.eye(k, dtype=bool)
    return a[:, off].ravel(), b[:, off].ravel(), value[:, off].ravel()


def summed(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of equal (a, b) added up."""
    order = np.lexsort((b, a))
    a, b, value = a[order], b[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[first], b[first], np.add.reduceat(value, first)


def _shared(it):
    """Sums over the distinct vectors of a task, by language. Columns: lang, times, group, p, zero (lists)."""
    held: dict[str, list] = defaultdict(list)
    size: Counter = Counter()

    def handed(lang):
        a, b, value = summed(*(np.concatenate(c) for c in zip(*held.pop(lang), strict=True)))
        size.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(value)], schema=SUMS)

    for batch in it:
        langs = np.array(batch.column("lang").to_pylist(), object)
        times = batch.column("times").to_numpy()
        lists = batch.column("entries")
        offsets = lists.offsets.to_numpy()
        flat = lists.values.flatten()
        lengths = np.diff(offsets)
        columns = [c.to_numpy() for c in flat]
        for k in np.unique(lengths[lengths > 1]):
            step = max(1, PAIRS // int(k * k))
            for lang in set(langs[lengths == k]):
                rows = np.flatnonzero((lengths == k) & (langs == lang))
                for s in range(0, len(rows), step):
                    own = rows[s : s + step]
                    at = offsets[own][:, None] + np.arange(k)[None, :]
                    held[lang].append(summed(*shared_sums(*(c[at] for c in columns), times[own])))
                    size[lang] += len(held[lang][-1][0])
                    if size[lang] > 2 * PAIRS:
                        done = [summed(*(np.concatenate(c) for c in zip(*held[lang], strict=True)))]
                        held[lang], size[lang] = done, len(done[0][0])
                        if size[lang] > PAIRS:  # more pairs than a task should keep
                            yield handed(lang)
    for lang in list(held):
        yield handed(lang)


def _p(count: str, total: str) -> str:
    """SQL of a word's value among a total that holds one more for each kept word; exact beyond 64 bits."""
    return f"1 + (cast({count} + 1 AS decimal(20, 0)) * {UNIT}) div ({total})"


def _f(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 3, top: int = 200,
) -> DataFrame:
    """lang, source, part, item, value, rank for every occurring (lang, source).

    part 'pair': item is each other source of the language, value how far source departs from it. part 'term': item is a
    kept word that source has and uses more than its language does, value its share; ranks to `top`. Ties go by item.

    Null texts, languages and sources count as ''. Repeated rows are documents of their own, ids aren't read. Texts
    without words, and languages without kept words, give pairs of value 0 and no terms; an empty table gives no rows.
    A text of any length is cut a stretch at a time; a task holds its distinct words. Other columns are ignored.
    """
    ship(docs.sparkSession)
    own = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counted = own.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_count, ddl(COUNTS))
    # one exchange serves both groupings; tasks have added up their own counts before it
    each = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = each.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"),  # as long as the language has sources
    )
    terms = scratch(kept.where(F.col("docs") >= least_docs).select("lang", "term", "vector"), "terms")
    distinct = terms.groupBy("lang", "vector").agg(F.count("*").alias("times"))
    vectors = scratch(distinct.withColumn("vid", F.monotonically_increasing_id()), "count-vectors")

    cells = vectors.select("vid", "lang", "times", F.inline("vector"))
    totals = cells.groupBy("lang", "source").agg(F.sum(F.expr("n * times")).alias("total"))
    langs = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    langs = langs.join(vectors.groupBy("lang").agg(F.sum("times").alias("words")), "lang")
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "lang_total", "words"]).withColumn("gid", F.monotonically_increasing_id())
    groups = scratch(groups.withColumn("zero", F.expr(f"CASE WHEN words > 0 THEN {_p('0', 'total + words')} END")), "groups")

    valued = cells.join(groups, ["lang", "source"]).withColumn("p", F.expr(_p("n", "total + words")))
    valued = scratch(valued.select("vid", "lang", "times", "source", "gid", "n", "p", "zero", "words", "lang_total"), "vector-cells")
    pairs = _pairs(valued, groups)
    best = _best_terms(valued, vectors, terms, top)
    place = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = [
        pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place().alias("rank")),
        best.select("lang", "source", F.lit("term").alias("part"), "item", "value", place().alias("rank")).where(F.col("rank") <= top),
    ]
    return out[0].unionByName(out[1])


def _pairs(valued: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of every two groups of a language."""
    entry = F.struct("gid", "p", "zero")
    lists = valued.groupBy("vid", "lang", "times").agg(F.collect_list(entry).alias("entries")).where("size(entries) > 1")
    both = lists.select("lang", "times", "entries").mapInArrow(_shared, ddl(SUMS)).select("a", "b", "value")
    single = valued.groupBy("lang", "gid", "p", "zero").agg(F.sum("times").alias("times"))  # one row per distinct count of a source
    other = groups.select(F.col("lang"), F.col("gid").alias("other"), F.col("zero").alias("other_zero"))
    met = single.join(other, "lang").where("gid != other")
    alone = met.select(
        F.expr("stack(2, gid, other, " + f"{_f('p', 'other_zero')} - {_f('zero', 'other_zero')}, other, gid, {_f('other_zero', 'p')} - {_f('other_zero', 'zero')})").alias("a", "b", "value"), "times",
    ).select("a", "b", F.expr("value * times").alias("value"))
    added = both.unionByName(alone).groupBy("a", "b").agg(F.sum(F.col("value").cast("decimal(38, 0)")).alias("added"))
    one, two = groups.alias("x"), groups.alias("y")
    every = one.join(two, F.expr("x.lang = y.lang AND x.gid != y.gid")).select(
        "x.lang", "x.source", F.col("y.source").alias("item"), F.col("x.gid").alias("a"), F.col("y.gid").alias("b"),
        F.expr(f"coalesce(x.words * ({_f('x.zero', 'y.zero')}), 0)").alias("absent"),
    )
    return every.join(added, ["a", "b"], "left").withColumn("value", F.expr("cast(absent + coalesce(added, 0) AS bigint)"))


def _best_terms(valued: DataFrame, vectors: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value: the words of the vectors that can be among a group's best, at least `top` where there are."""
    in_lang = vectors.select("vid", F.expr("aggregate(vector, 0L, (s, x) -> s + x.n)").alias("in_lang"))
    scored = valued.join(in_lang, "vid").withColumn("q", F.expr(_p("in_lang", "lang_total + words"))).where("p > q")
    scored = scored.withColumn("value", F.expr(_f("p", "q")))
    # a vector stands for one word at least, so those beyond the best `top` can't bring one
    rank = F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))
    best = scored.withColumn("place", rank).where(F.col("place") <= top).select("vid", "source", "value")
    named = terms.join(vectors.select("vid", "lang", "vector"), ["lang", "vector"]).select("vid", "lang", F.col("term").alias("item"))
    return best.join(named, "vid").select("lang", "source", "item", "value")
