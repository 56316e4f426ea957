"""Encoding, counting, exact and near-duplicates, against the libraries and brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomframe.llm import common, components, exact_dedup, line_dedup, packing, sentencepiece_codec, simhash, token_counts

ALPHABET = st.lists(
    st.sampled_from(list("abcdeXYZ' \n\t▁éñßΣσİ中🙂0123.,%<|>/s\x00\x1c\x85　́") + ["<s>", "<|endoftext|>", "don't", "hello ", "the ", "  "]),
    max_size=40,
).map("".join)
AWKWARD = [
    (1, "same  text", "a", 1),
    (2, "same\ttext", "b", 2),
    (3, None, None, None),
    (4, "", "a", 3),
    (None, "same text", "c", 4),
    (6, "x" * 5000 + " " + "word " * 3000, "a", 5),
    (6, "x" * 5000 + " " + "word " * 3000, "a", 5),
    (8, "\n\n", "a", 6),
    (9, "Ünïcode ▁ 中文 🙂", "a", 7),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empties, long texts, repeated rows, and columns whose names clash with the operators' own."""
    return spark.createDataFrame(AWKWARD, "doc_id long, text string, source string, kept int").selectExpr(
        "*", "kept AS group_size", "kept AS score", "source AS lang", "0L AS n_chars", "kept AS rid", "kept AS fp", "kept AS shard",
    )


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    return sentencepiece.SentencePieceProcessor(
        model_file=sentencepiece_codec.default_model()
    ), Tokenizer.from_file(token_counts.default_vocabulary()), Tokenizer.from_file(packing.default_vocabulary())


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_codecs_equal_the_libraries(library, text):
    piece, word, byte = library
    c = sentencepiece_codec.codec(sentencepiece_codec.default_model())
    ids = piece.encode(text)
    assert c.encode(text) == ids and c.decode(ids) == piece.decode(ids)
    assert c.digest(text) == (
        len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(piece.decode(ids).encode()).hexdigest(),
    )
    n = token_counts.counter(token_counts.default_vocabulary())
    assert n.count(text) == len(word.encode(text, add_special_tokens=False).ids)
    assert np.frombuffer(
        packing.encoder(packing.default_vocabulary()).encode(text), "<u4",
    ).tolist() == byte.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(ALPHABET.filter(lambda t: "<|" not in t), st.integers(0, 12))
def test_prefix_table(library, text, budget):
    word = library[1]
    count = lambda t: len(word.encode(t, add_special_tokens=False).ids)
    n = token_counts.counter(token_counts.default_vocabulary())
    ends, counts = n.prefixes(text)
    normal = n.normalise(text)
    assert all(count(normal[:e]) == c for e, c in zip(ends, counts, strict=True))
    cut, tokens, kept = n.truncate(text, budget)
    assert count(kept) == tokens and (tokens <= budget) and kept == normal[:cut]
    assert n.at((ends, counts), len(normal)) == count(normal)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(ALPHABET, st.sampled_from(["<|endoftext|>", "<|startoftext|>", " <|endoftext|> "])), max_size=6).map("".join), st.integers(0, 9))
def test_prefix_table_with_special_strings(library, text, budget):
    """Special strings are one token each; the table has no ends inside them."""
    count = lambda t: len(library[1].encode(t, add_special_tokens=False).ids)
    n = token_counts.counter(token_counts.default_vocabulary())
    assert n.count(text) == count(text)
    ends, counts = n.prefixes(text)
    normal = "".join(p if p in n.specials else n.normalise(p) for p in n.special.split(text))
    assert counts[-1] == count(text) and all(count(normal[:e]) == c for e, c in zip(ends, counts, strict=True))
    cut, tokens, kept = n.truncate(text, budget)
    assert tokens <= budget and kept == normal[:cut] and count(kept) == tokens


@settings(max_examples=200, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=12))
def test_digests_with_a_small_memory(library, texts_):
    """A memory that is emptied within a text changes no digest; decode is that of the ids."""
    small = sentencepiece_codec.Codec(sentencepiece_codec.default_model(), remember=2) if not _SMALL else _SMALL[0]
    _SMALL[:] = [small]
    piece = library[0]
    for text in texts_:
        ids = piece.encode(text)
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(
            piece.decode(ids).encode("utf-8", "replace")
        ).hexdigest()
        assert small.digest(text) == want and small.decode(small.encode(text)) == piece.decode(ids)


_SMALL: list = []


@pytest.mark.parametrize("run", [sentencepiece_codec.encode_digests, sentencepiece_codec.encode_documents, token_counts.token_counts, token_counts.prefix_counts, exact_dedup.exact_dedup, simhash.near_duplicates])
def test_a_row_for_each_row(spark, awkward, run):
    assert run(awkward).count() == len(AWKWARD)
    assert run(awkward.limit(0)).count() == 0


def test_exact_dedup_awkward(awkward):
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(awkward).collect())
    assert [g[1:] for g in got if g[0][1] in (1, 2) or g[0][0]] == [(1, 3, True), (1, 3, False), (1, 3, False)]
    assert [g[1:] for g in got if g[0] == (False, 3)] == [(3, 2, True)] and sum(g[3] for g in got if g[0] == (False, 6)) == 1


def test_grace_recursion_and_collisions(tmp_path):
    rng = random.Random(5)
    texts = [("t%d" % rng.randrange(300)).encode() * 50 for _ in range(2000)]
    same_digest = b"\0" * 32  # every digest equal: only contents tell
    records = [(i, i, 1, same_digest, t) for i, t in enumerate(texts)]
    rows = list(exact_dedup.grace(iter(records), 3000, str(tmp_path)))
    groups = {r[1]: r[2:] for r in rows if r[0] is None}
    out = {r[0]: (r[0], *groups[r[1]]) for r in rows if r[0] is not None}
    first, size = {}, {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
        size[t] = size.get(t, 0) + 1
    assert all(out[i][1:] == (first[t], first[t], size[t]) for i, t in enumerate(texts)) and not list(tmp_path.iterdir())


def test_collapsing_is_bounded_and_whole(monkeypatch):
    """Texts beyond the scan task's budget pass one by one; long id lists are cut; nothing is lost."""
    monkeypatch.setattr(exact_dedup, "HELD", 2_600)
    monkeypatch.setattr(exact_dedup, "MOST_IDS", 50)
    rng = random.Random(2)
    rows = [(i if i % 50 else None, rng.choice(["hot  text", "hot text", "x" * 700 + str(rng.randrange(9)), None])) for i in range(3000)]
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows[a : a + 500]], pa.int64()), pa.array([r[1] for r in rows[a : a + 500]])], names=["id", "text"],
        ) for a in range(0, 3000, 500)
    ]
    out = [r for batch in exact_dedup._local(iter(batches)) for r in batch.to_pylist()]
    got, want = Counter(), Counter(((exact_dedup.normalise(t or "")).encode(), i) for i, t in rows)
    for r in out:
        assert r["n"] == len(r["ids"]) <= 50 and r["first"] == min((i for i in r["ids"] if i is not None), default=None)
        assert r["sha"] == hashlib.sha256(r["content"]).digest()
        got.update((r["content"], i) for i in r["ids"])
    assert got == want and len(out) < 2000


def test_simhash_against_brute_force(spark):
    rng = random.Random(1)
    base = [
        " ".join(
            rng.choice(["alpha", "beta", "Gamma", "delta", "eps", "zeta"]) + str(rng.randrange(40)) for _ in range(200)
        ) for _ in range(8)
    ]
    texts = ["", None, "one", "A b"]
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "changed%d" % rng.randrange(3)
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}

    def slow(t):
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]
        if not words:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [slow(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert all(got[i].fingerprint == f"{prints[i]:016x}" and got[i].component_id == find(i) for i in range(len(texts)))


@pytest.mark.parametrize("crowd", [1, 48])
def test_golay_links_lose_nothing(spark, crowd):
    rng = np.random.default_rng(crowd)
    near = [int(x) for x in rng.integers(0, 2**63, 6)]
    every = sorted({n ^ (1 << int(a)) ^ (1 << int(b)) for n in near for a, b in rng.integers(0, 63, (60, 2))} | set(near))
    df = spark.createDataFrame([(x,) for x in every], "fp long")
    got = {r.node: r.component for r in components.connected_components(simhash.links(df, crowd), "fp", "other").collect()}
    parent = {x: x for x in every}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in every:
        for y in every:
            if bin(x ^ y).count("1") <= 2:
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    assert all(got.get(x, x) == find(x) for x in every)


def test_components_of_a_chain(spark):
    n = 200
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(900, 901), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(chain, "a", "b").collect()}
    assert got == {i: 0 for i in range(n + 1)} | {900: 900, 901: 900}
    assert components.connected_components(chain.limit(0), "a", "b").count() == 0


def test_line_dedup(spark, awkward):
    rows = [(i, f"menu\nbody {i}\n\nmenu", "h") for i in range(10)] + [
        (20, "menu\nx", "k"), (21, None, "h"), (22, "", "h"), (23, "menu", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS n_lines")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df, ratio=0.5).collect()}
    assert got[3].text == "body 3\n" and (got[3].n_lines, got[3].n_dropped) == (4, 2)
    assert got[20].text == "menu\nx" and got[21].text is None and got[22].text == "" and got[23].text == "menu"
    out = line_dedup.drop_boilerplate(awkward, ratio=0.1)
    assert out.count() == len(AWKWARD) and line_dedup.drop_boilerplate(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("most", [line_dedup.BROADCAST_BYTES, -1])
def test_line_dedup_against_brute_force(spark, most, monkeypatch):
    """Both ways of joining, hosts of one, two and many pages, null hosts and texts, repeated rows, clashing names."""
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", most)
    rng = random.Random(8)
    rows = []
    for host, pages in (("one", 1), ("two", 2), ("many", 120), (None, 40)):
        for k in range(pages):
            lines = [
                rng.choice(["menu", "footer", " ", "", f"l{rng.randrange(30)}", f"own {rng.random()}"]) for _ in range(rng.randrange(8))
            ]
            rows.append((len(rows), host, None if k % 17 == 16 else "\n".join(["menu", *lines])))
    rows += [rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr(
        "*", "text AS line", "1 AS pages", "source AS host", "2 AS n_dropped",
    )
    total, on = Counter(), Counter()
    for _, host, text in rows:
        total[host] += 1
        on.update((host, line) for line in set((text or "").split("\n")) if text is not None and line.strip(" "))
    want = []
    for i, host, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if not x.strip(" ") or on[host, x] < 2 or on[host, x] <= 0.1 * total[host]]
        want.append((i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    got = line_dedup.drop_boilerplate(df, ratio=0.1)
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got.collect())
    assert {"line", "pages", "host"} <= set(got.columns)
    one = [w for w, r in zip(want, rows, strict=True) if r[1] == "one"][0]
    assert one[3] == 0 and all(w[1] is None or not w[1].startswith("menu") for w, r in zip(want, rows, strict=True) if r[1] == "two")


@pytest.mark.parametrize("most", [simhash.BROADCAST_ROWS, -1])
def test_keep_one_of_each_by_both_joins(spark, most, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
    rows = [(4, "a b c d"), (2, "a b c d"), (2, "a b c d"), (None, "a b c d"), (9, "something else here"), (3, None), (8, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS __id", "text AS root")
    out = simhash.keep_one_of_each(df)
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == ["2", "3", "9", "None"]


def test_shared_folder_and_scratch(spark, tmp_path):
    """Scratch tables lie in the shared folder and can be dropped; a cluster without one is an error."""

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: None)})

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Cluster.conf)  # noqa: N815
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)
    assert common.unused(["Text", "_text"], "text", "line") == ["__text", "line"]
    common.drop_scratch(spark)
    table = common.scratch(spark.range(3), "test")
    assert table.count() == 3 and common.drop_scratch(spark) == 1
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        table.count()
