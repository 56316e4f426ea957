"""Cross-tokenizer alignment against the libraries on whole texts and plain loops."""

import hashlib
from collections import Counter

import pytest

from loomframe.llm import alignment, queries


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_vocabularies()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    return a, b, alignment.Vocabularies(path_a, path_b, remember=100)


def plain(libraries, texts):
    """Figures of each text by loops over its groups."""
    a, b, v = libraries
    found = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        pieces = [[v.bytes_a[i] for i in ids[0]], [v.bytes_b[i] for i in ids[1]]]
        if not text or any(b"".join(x) != whole for x in pieces):
            found.append(([], [], []))
            continue
        ends = [[sum(map(len, x[: k + 1])) for k in range(len(x))] for x in pieces]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [
            tuple([i for i, e in zip(own, at, strict=True) if lo < e <= hi] for own, at in zip(ids, ends, strict=True))
            for lo, hi in zip([0, *cuts], cuts, strict=False)
        ]
        found.append((*ids, groups))
    count = Counter(p for _, _, groups in found for p in {(x, y) for g in groups for x in g[0] for y in g[1]})
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for ids_a, ids_b, groups in found:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        spelled = ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        digest = hashlib.sha256(spelled.encode()).hexdigest() if groups else ""
        out.append((len(ids_a), len(ids_b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest))
    return out


ODD = [
    None, "", " ", "a  b", " lead", "trail ", "x\ny \n z\t\tq", "▁mark", "<s> hi </s><unk>", "<|endoftext|> b", "\x00a", "  a", "é ﻿x a​b",
    "<0x41> it's 1234567", "漢字 かな 한국어", "=" * 300, "a" * 500 + " " * 300, "word " * 40, "word " * 40, "\r\n\v\f a", "naïve café", "🙂🙂 🙂",
]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_align_odd_texts(spark, libraries, limit):
    rows = [(k if k % 3 else None, t, "x") for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string").selectExpr("*", "1 AS rid", "2 AS pairs", "3 AS times")
    got = alignment.align(df, broadcast_pairs=limit).collect()
    want = plain(libraries, ODD)
    assert sorted(str((r.doc_id, *r[1:])) for r in got) == sorted(str((i, *w)) for (i, _, _), w in zip(rows, want, strict=True))
    assert alignment.align(df.limit(0)).count() == 0


def test_align_documents(spark, data, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = {i: w for (i, _), w in zip(docs, plain(libraries, [t for _, t in docs]), strict=True)}
    got = queries.op12_alignment(spark, data).collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == want and len(got) == len(docs)


def test_a_group_of_many_links(libraries):
    """Ids of a group with many links are counted before they are paired."""
    *_, v = libraries
    text = "".join(chr(0x4E00 + k % 60) for k in range(400))
    small, many = v.encode([text])[0], alignment.MANY
    size = alignment.np.array([len(text.encode()) + 1])
    want = alignment.Laid(v, [small], size).linked()
    try:
        alignment.MANY = 0
        got = alignment.Laid(v, [small], size).linked()
    finally:
        alignment.MANY = many
    assert all((x == y).all() for x, y in zip(got, want, strict=True))


def test_odd_texts_in_other_company(libraries):
    """A text's parts have the ids that the libraries give the whole text."""
    a, b, v = libraries
    for text in [" ".join(x for x in ODD if x and alignment.MARK not in x), "a \n b\n\n c  　 d", "it 's  'll\t'd"]:
        ids = [list(memoryview(x).cast("i")) for x in v.encode([text])[0]]
        assert ids == [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]


def test_words_of_new_parts_are_encoded_once(libraries):
    """A word in many new parts is encoded once; ids are those of the library, whatever is remembered and however little."""
    a, b, _ = libraries
    words = ["Quernizol", "Zweißgrün", "ciónó", "12", "***", "x" * 70]
    texts = [" ".join(x + y + z for x in words for y in (".", ",", "\n", ".\n", "\n\n", "'") for z in ["", *words])]
    texts += [" ".join(f"{w}{k}" for w in words) for k in range(40)] + ["\n".join(words), "\n" + texts[0] + "\n", "ǃª µ² ½ " + texts[0], *texts]

    class Counted:
        def __init__(self, model):
            self.model, self.letters = model, 0

        def __getattr__(self, name):
            return getattr(self.model, name)

        def encode(self, given, **options):
            self.letters += len("".join(given))
            return self.model.encode(given, **options)

    for remember, together in ((150_000, alignment.TOGETHER), (3, 2)):
        v = alignment.Vocabularies(*alignment.default_vocabularies(), remember=remember)
        v.b = Counted(v.b)
        before, alignment.TOGETHER = alignment.TOGETHER, together
        try:
            for own in (texts[:1], texts[1:20], texts[20:], texts[:3]):
                for text, ids in zip(own, v.encode(own), strict=True):
                    assert [list(memoryview(x).cast("i")) for x in ids] == [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
        finally:
            alignment.TOGETHER = before
        if remember > 3:
            v.b.letters = 0
            v.encode([" ".join(x + "," + y for x in ("neuword", "Wort") for y in words), "neuword! Wort! neuword; Wort; neuword?!"])
            assert v.b.letters < 150  # the parts have 309


def test_words_of_another_pattern(tmp_path):
    """Where A cuts words in its own way, or a piece of B may hold their border, parts are encoded as they are."""
    from tokenizers import Tokenizer, pre_tokenizers

    path_a, path_b = alignment.default_vocabularies()
    other = Tokenizer.from_file(path_a)
    cut = pre_tokenizers.Split("e", "isolated")
    other.pre_tokenizer = pre_tokenizers.Sequence([cut, pre_tokenizers.ByteLevel(add_prefix_space=False)])
    other.save(str(tmp_path / "a.json"))
    text = "one, therefore two.\nthree"
    v, own = alignment.Vocabularies(path_a, path_b), alignment.Vocabularies(str(tmp_path / "a.json"), path_b)
    assert v.by_words and not own.by_words
    ids = [list(memoryview(x).cast("i")) for x in own.encode([text])[0]]
    assert ids == [other.encode(" " + text, add_special_tokens=False).ids, v.b.encode(text)]
    want = v.encode([text])
    v = alignment.Vocabularies(path_a, path_b)
    v.by_words = False
    assert v.encode([text]) == want and not v.words
