"""Source divergence against plain integers over every word and pair."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomframe.llm import source_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least=3, top=200):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = TERM.findall((text or "").translate(upper))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in {k for k, _ in counts}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        own = {s: c for (k, s), c in counts.items() if k == lang}
        whole = sum(own.values(), Counter())

        def p(c):
            total = sum(c[t] for t in kept) + len(kept)  # noqa: B023
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}  # noqa: B023

        values, q = {s: p(c) for s, c in own.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = sorted((-sum(f(values[s][t], values[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((-f(values[s][t], q[t]), t.encode()) for t in kept if own[s][t] and values[s][t] > q[t])[:top]
            for part, items in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(items, 1)]
    return sorted(out)


def _rows():
    rng = random.Random(9)
    words = ["The", "the", "naïve", "ÉCOLE", "école", "don't", "x1y2", "漢字", "Ωmega", "a" * 300] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows = []
    for k in range(160):
        source = "hot" if k % 2 else rng.choice(["s1", "s2", "S2", "", None, "日本"])
        lang = rng.choice(["en", "en", "de", "", None])
        rows.append((lang, source, " ".join(rng.choices(words[: 30 + 70 * (k % 4)], k=rng.randrange(120)))))
    rows += [("en", "copies", rows[0][2])] * 30 + [("fr", "only", "un deux"), ("fr", "other", None), ("xx", "s", "123 !?"), ("xx", "t", "")]
    rows += [("one", "alone", "word word word"), ("one", "alone", "word"), ("one", "alone", "word")]
    return rows


@pytest.mark.parametrize("held, pairs, top", [(300_000, 1 << 20, 200), (40, 30, 7)])
def test_against_plain_integers(spark, monkeypatch, held, pairs, top):
    """Nulls, repeated rows, ties, languages without kept words, clashing names; small memories give the same."""
    monkeypatch.setattr(source_divergence, "HELD", held)
    monkeypatch.setattr(source_divergence, "PAIRS", pairs)
    rows = _rows()
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS vid", "3 AS rank", "lang AS item").repartition(5)
    got = sorted(map(tuple, source_divergence.divergence(df, top=top).collect()))
    want = plain(rows, top=top)
    assert got == want and {r[2] for r in want} == {"pair", "term"} and any(r[4] == 0 for r in want)
    assert source_divergence.divergence(df.limit(0)).count() == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "".join(random.Random(1).choice("abcé 1\n") for _ in range(5000)).encode()
    whole = source_divergence.TERM.findall(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(source_divergence, "STRETCH", size)
        assert [w for part in source_divergence.terms_of(text) for w in part] == whole


def test_shared_sums_of_large_numbers():
    """Values near 10^9 stay exact in 64 bits."""
    p, zero = np.array([[10**9 + 1, 1, 5]]), np.array([[1, 1, 2]])
    a, b, value = source_divergence.shared_sums(np.array([[3, 4, 9]]), p, zero, np.array([7]))
    f = lambda x, y: (x - y) ** 2 // y
    rows = [(3, 10**9 + 1, 1), (4, 1, 1), (9, 5, 2)]
    want = {(i, j): 7 * (f(x, y) - f(x, zy) - f(zx, y) + f(zx, zy)) for i, x, zx in rows for j, y, zy in rows if i != j}
    assert {(i, j): v for i, j, v in zip(a.tolist(), b.tolist(), value.tolist(), strict=True)} == want
