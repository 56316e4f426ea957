"""Token counts by prefix dynamic programming for a word-end BPE vocabulary (tokenizers .json).

A table over the prefixes of each word holds the exact number of tokens of every prefix; running sums over words give
every prefix of a text. Counts, truncation points and budgets are read from the table without encoding again.
Words are remembered per worker in a bounded memory, which changes no result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.bpe import WORD_END, Merges, PrefixTable
from loomframe.llm.common import ddl, per_document, ship

#: Unicode white space, and the vocabulary's way of cutting words.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x2000))) + "-" + chr(0x200A)
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
_SPACES = re.compile(f"[{SPACE}]+")
_CONTROL = re.compile("[\x1c-\x1f]")
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
CUTS = pa.schema([("doc_id", pa.int64()), ("cut", pa.int64()), ("n_tokens", pa.int64()), ("kept", pa.string())])
PREFIXES = pa.schema([("doc_id", pa.int64()), ("ends", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it is printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(free)) for b in range(256)}


class Counter:
    """Token counts as the tokenizers library gives them, without added special tokens."""

    def __init__(self, path: str, remember: int = 200_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["end_of_word_suffix"] is None:
            raise ValueError("this counter is for vocabularies with a word-end suffix")
        suffix = model["end_of_word_suffix"]
        own = lambda t: t.removesuffix(suffix) + WORD_END if t.endswith(suffix) else t
        special = [t["content"] for t in spec["added_tokens"]]
        ranks = {(own(a), own(b)): k for k, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"])}
        self.table = PrefixTable([own(t) for t in model["vocab"] if t not in special], Merges(lambda a, b, get=ranks.get: get((a, b))))
        self.letters = byte_letters()
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.specials = set(special)
        self.starts = {s[:2] for s in special}
        self.remember = remember
        self.words: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    @staticmethod
    def normalise(text: str) -> str:
        """NFC, runs of white space to one space, lower case character by character."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form at a word's end
        return _SPACES.sub(" ", text).lower()

    def letters_of(self, word: str) -> str:
        return "".join([self.letters[b] for b in word.encode("utf-8", "replace")])

    def word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            n = self.table.total(self.letters_of(word))
            if len(word) <= 60:
                if len(self.words) >= self.remember:
                    self.words.clear()
                self.words[word] = n
        return n

    def chunk(self, chunk: str) -> int:
        """Tokens of a stretch without white space."""
        n = self.chunks.get(chunk)
        if n is None:
            n = sum(map(self.word, WORDS.findall(self.normalise(chunk))))
            if len(chunk) <= 60:
                if len(self.chunks) >= self.remember:
                    self.chunks.clear()
                self.chunks[chunk] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        chunks = _SPACES.split(text) if _CONTROL.search(text) else text.split()
        found = list(map(self.chunks.get, chunks))
        if None in found:
            return sum([n if n is not None else self.chunk(c) for n, c in zip(found, chunks, strict=True)])
        return sum(found)

    def count(self, text: str) -> int:
        if not any(s in text for s in self.starts):
            return self.plain(text)
        return sum(1 if p in self.specials else self.plain(p) for p in self.special.split(text))

    def prefixes(self, text: str) -> tuple[list[int], list[int]]:
        """(ends, counts): at each character offset of the normalised text that ends a token-bearing prefix, the exact
        number of tokens of that prefix encoded by itself. Offsets between two ends (white space) keep the count of
        the end before. Special strings inside the text are one token each and have no ends inside."""
        ends, counts, base, at = [0], [0], 0, 0
        for piece in self.special.split(text):
            if piece in self.specials:
                at, base = at + len(piece), base + 1
                ends.append(at)
                counts.append(base)
                continue
            piece = self.normalise(piece)
            for m in WORDS.finditer(piece):
                word = m.group()
                letters = self.letters_of(word)
                every = self.table.every(letters)
                size = 0
                for k, c in enumerate(word, 1):
                    size += len(c.encode("utf-8", "replace"))
                    inner = every[size]
                    if word[0] == "'" and len(word) > 2 and 1 < k < len(word):  # 're cut to 'r is two words
                        inner = sum(map(self.word, WORDS.findall(word[:k])))
                    ends.append(at + m.start() + k)
                    counts.append(base + inner)
                base += every[-1]
            at += len(piece)
        return ends, counts

    def truncate(self, text: str, budget: int) -> tuple[int, int, str]:
        """Offset, number of tokens and text of the longest prefix of the normalised text within budget, from the table."""
        ends, counts = self.prefixes(text)
        normal = "".join(p if p in self.specials else self.normalise(p) for p in self.special.split(text))
        if counts[-1] <= budget:
            return len(normal), counts[-1], normal
        k = max(k for k, c in enumerate(counts) if c <= budget)
        return ends[k], counts[k], normal[: ends[k]]

    def at(self, table: tuple[list[int], list[int]], offset: int) -> int:
        """Tokens of the prefix of that length, from prefixes()."""
        return table[1][bisect_right(table[0], offset) - 1]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 2048) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit (n_tokens > limit): one row per input row.

    Null text counts as empty: zero bytes and tokens. Ids may be null or repeated. Other columns are ignored.
    """
    out = _apply(docs, id_col, text_col, COUNTS, path, lambda c, t: (len(t.encode("utf-8", "replace")), c.count(t)))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id_col, ends, counts: the table of Counter.prefixes for each row. Null text has the table of the empty text."""
    return _apply(docs, id_col, text_col, PREFIXES, path, Counter.prefixes)


def truncate(docs: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id_col, cut, n_tokens, kept: the longest prefix of each normalised text within budget tokens."""
    return _apply(docs, id_col, text_col, CUTS, path, lambda c, t: c.truncate(t, budget))


def _apply(docs, id_col, text_col, schema, path, fn):
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(it):
        held = counter(path or default_vocabulary())
        return per_document(lambda t: fn(held, t), schema)(it)

    return rows.mapInArrow(run, ddl(schema)).withColumnRenamed("doc_id", id_col)
