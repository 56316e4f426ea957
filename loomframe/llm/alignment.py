"""How the tokens of two vocabularies cover the same bytes, and which pairs of tokens go together corpus-wide.

Both tokenise a text with a space before it. A whole batch of texts is laid end to end: the byte offsets at which tokens
of A and of B end are counted once each, and the batch is cut where both occur, which every end of a text is. The
number of cuts up to a byte tells a token's group, and prefix sums over groups, read at the ends of the texts, give each
text's own figures. No text is looked at by itself, and no token in a loop.

A text's ids come from its parts: stretches that begin with a space between two characters that aren't white space.
A's pattern begins a word there, and no piece of B holds a word mark after another character, so neither merges across.
A new part's ids come from its words: runs of letters, of digits and of marks, where no piece of B goes across either.
Parts and words are remembered per worker in a bounded memory, which changes no result.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import ddl, released, scratch, ship
from loomframe.llm.packing import _WORDS
from loomframe.llm.token_counts import SPACE, byte_letters

MARK = "▁"
#: A space that begins a part, and a text in which not every space does.
_CUT = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
_NOT_PLAIN = re.compile(f"[{SPACE}] | (?:[{SPACE}]|$)")
#: Bytes of text that are laid end to end, and links of a group beyond which its ids are counted before they are paired.
LAID, MANY = 1 << 20, 4096
#: Words that are encoded in one call.
TOGETHER = 1000
#: Most pairs whose counts are broadcast (about 50 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000
TOKENS = pa.schema(
    [
        ("rid", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("groups_sha256", pa.string()),
        ("pairs", pa.list_(pa.int64())),
        ("times", pa.list_(pa.int64())),
    ]
)


class Vocabularies:
    """Ids of both vocabularies for a part of a text, and the number of bytes that each id stands for."""

    def __init__(self, path_a: str, path_b: str, remember: int = 150_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings inside texts are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        byte_of = {letter: b for b, letter in letters.items()}
        special = self.a.get_added_tokens_decoder()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = token.encode() if i in special else bytes(byte_of[c] for c in token)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
        if any(MARK in self.b.id_to_piece(i).lstrip(MARK) for i in range(len(self.bytes_b))):
            raise ValueError("a piece of B holds a word mark after another character")
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.digits_a, self.digits_b = (_spelled(len(y)) for y in (self.bytes_a, self.bytes_b))
        self.letters = {k: "".join(letters[b] for b in chr(k).encode()) for k in range(0x250) if chr(k) != "\n"}
        self.lines = Tokenizer(self.a.model)  # of words that are spelled already, one a line
        self.lines.pre_tokenizer = CharDelimiterSplit("\n")
        self.line_end = self._same(b"\n", self.a.encode("\n", add_special_tokens=False).ids, self.b.encode("\n")[1:])
        plain = (x for i in range(len(self.bytes_b)) if not self._special(i) for x in [self.b.id_to_piece(i)])
        joints = {x[k : k + 2] for x in plain for k in range(len(x) - 1)}
        before = self.a.pre_tokenizer
        usual = isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space
        usual = usual and self.a.normalizer is None and all(t.special for t in special.values())
        #: Whether A makes these words, and no piece of B holds a border of words or a line end beside another character.
        self.by_words = usual and self.line_end is not None and not any("\n" in x or len(_WORDS.findall(x)) > 1 for x in joints)
        self.remember = remember
        #: What is remembered of parts and of words, and of both what was before the memory was last full.
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.known_before: dict[str, tuple[bytes, bytes] | None] = {}
        self.words: dict[str, tuple[bytes, bytes] | None] = {}
        self.words_before: dict[str, tuple[bytes, bytes] | None] = {}

    def _special(self, i: int) -> bool:
        return self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i)

    @staticmethod
    def parts(text: str) -> list[str]:
        """The parts of a space and the text, each without its first space."""
        if not _NOT_PLAIN.search(" " + text):
            return text.split(" ")
        parts = _CUT.split(" " + text)
        parts[0] = parts[0][1:]
        return parts

    def _same(self, data: bytes, a: list[int], b: list[int]) -> tuple[bytes, bytes] | None:
        """Both as 32-bit numbers; None where their bytes aren't data."""
        same = b"".join([self.bytes_a[i] for i in a]) == data == b"".join([self.bytes_b[i] for i in b])
        return (array("i", a).tobytes(), array("i", b).tobytes()) if same else None

    def _of_words(self, words: set[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Ids of words of A's pattern, a space before them included; each is merged by itself."""
        if len(self.words) > self.remember:
            self.words, self.words_before = {}, self.words
        known, before = self.words, self.words_before
        found, own = {"\n": self.line_end}, []
        for word in words - found.keys():
            ids = known.get(word) or before.get(word)
            if ids is None:
                own.append(word)
            else:
                found[word] = known[word] = ids
        for k in range(0, len(own), TOGETHER):
            some = own[k : k + TOGETHER]
            for word, ids in zip(some, self._together(some), strict=True):
                found[word] = ids
                if len(word) <= 60:
                    known[word] = ids
        return found

    def _together(self, words: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of words that are laid a line each, since a line end merges with nothing. None for all if bytes differ."""
        lines, sizes = "\n".join(words), np.array([len(w.encode()) for w in words])
        data, ends, out = lines.encode(), np.cumsum(sizes), []
        for ids, of_id, size_of, want, stops in (
            (self.lines.encode_batch_fast([lines.translate(self.letters)], add_special_tokens=False)[0].ids, self.bytes_a, self.size_a, data.replace(b"\n", b""), ends),
            (self.b.encode("\n" + lines), self.bytes_b, self.size_b, b" \n" + data, ends + np.arange(2, len(words) + 2)),
        ):
            if b"".join([of_id[i] for i in ids]) != want:
                return [None] * len(words)
            numbers = np.array(ids, np.int32)
            upto = np.concatenate(([0], np.cumsum(size_of[numbers])))
            first, last = np.searchsorted(upto, stops - sizes), np.searchsorted(upto, stops)
            if (upto[first] != stops - sizes).any() or (upto[last] != stops).any():
                raise ValueError("a token goes across the border of a word")
            spelled = numbers.tobytes()
            out.append([spelled[s:e] for s, e in zip((4 * first).tolist(), (4 * last).tolist(), strict=True)])
        return list(zip(*out, strict=True))

    def learn(self, parts: set[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Ids of A and of B of each part as 32-bit numbers; None where their bytes aren't the part's."""
        new, whole, cut, before = {}, [], {}, self.known_before.get
        for part in parts:
            if ids := before(part):
                new[part] = ids
                continue
            if not self.by_words:
                whole.append(part)
            elif part.isascii() and part.isalpha():
                cut[part] = [" " + part]
            elif len("".join(words := _WORDS.findall(" " + part))) == len(part) + 1:
                cut[part] = words
            else:
                whole.append(part)
        found = self._of_words({w for words in cut.values() for w in words})
        for part, words in cut.items():
            ids = [found[w] for w in words]
            if None in ids:
                whole.append(part)
            else:
                new[part] = ids[0] if len(ids) == 1 else (b"".join([x for x, _ in ids]), b"".join([x for _, x in ids]))
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in whole], add_special_tokens=False)]
        for part, a, b in zip(whole, ids_a, self.b.encode(whole, num_threads=1), strict=True):
            new[part] = self._same((" " + part).encode(), a, b)
        if len(self.known) + len(new) > self.remember:
            self.known, self.known_before = {}, self.known
        for part, ids in new.items():
            if len(part) <= 60 and len(self.known) < self.remember:
                self.known[part] = ids
        return new

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of A and of B of whole texts; None for a text whose bytes a vocabulary doesn't give back."""
        split = [self.parts(t) if t and MARK not in t else [] for t in texts]
        known = self.known.get
        found = {p: known(p) for p in set().union(*split)}
        if missing := {p for p, ids in found.items() if ids is None}:
            found |= self.learn(missing)
        out = []
        for parts in split:
            ids = list(map(found.__getitem__, parts))
            out.append((b"".join([x for x, _ in ids]), b"".join([x for _, x in ids])) if ids and None not in ids else None)
        return out


def _spelled(size: int) -> dict[str, np.ndarray]:
    """For each separator the bytes of it and every id in decimal, as one 64-bit number padded with zeros."""
    if size > 10_000_000:
        raise ValueError("ids of more than seven digits")
    return {c: np.array([f"{c}{i}".encode() for i in range(size)], "S8").view(np.uint64) for c in ",;|"}


class Laid:
    """Texts end to end: what their tokens share. ids: (A, B) by text, sizes: bytes of the texts."""

    def __init__(self, v: Vocabularies, ids: list[tuple[bytes, bytes]], sizes: np.ndarray) -> None:
        self.v = v
        self.a, self.b = (np.frombuffer(b"".join(x), np.int32) for x in zip(*ids, strict=True))
        self.ends = np.cumsum(sizes)
        total = int(self.ends[-1])
        ends_a, ends_b = np.cumsum(v.size_a[self.a]), np.cumsum(v.size_b[self.b])
        cut = np.bincount(ends_a, minlength=total + 1) * np.bincount(ends_b, minlength=total + 1)
        cuts = np.cumsum(cut)  # groups that end at a byte or before it
        self.group_a, self.group_b = cuts[ends_a - 1], cuts[ends_b - 1]
        self.in_a, self.in_b = (np.bincount(g, minlength=int(cuts[-1])) for g in (self.group_a, self.group_b))
        self.upto_a, self.upto_b = (np.concatenate(([0], np.cumsum(x))) for x in (self.in_a, self.in_b))
        self.group_ends = cuts[self.ends]
        self.token_ends = self.upto_a[self.group_ends], self.upto_b[self.group_ends]

    def figures(self) -> list[np.ndarray]:
        """Tokens of A and of B, groups and links of each text."""
        links = np.concatenate(([0], np.cumsum(self.in_a * self.in_b)))
        return [np.diff(x, prepend=0) for x in (*self.token_ends, self.group_ends, links[self.group_ends])]

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups: a1,a2|b1;a3|b2,b3."""
        spelled = np.empty(len(self.a) + len(self.b), np.uint64)
        for ids, group, before, mark, digits in (
            (self.a, self.group_a, self.upto_b[:-1], ";", self.v.digits_a),
            (self.b, self.group_b, self.upto_a[1:], "|", self.v.digits_b),
        ):
            first = np.diff(group, prepend=-1) != 0
            spelled[np.arange(len(ids)) + before[group]] = np.where(first, digits[mark][ids], digits[","][ids])
        ends = (self.token_ends[0] + self.token_ends[1]).tolist()
        own = (spelled[s:e].tobytes().translate(None, b"\0") for s, e in zip([0, *ends], ends, strict=False))
        return [hashlib.sha256(x[1:]).hexdigest() for x in own]  # without the mark before the first group

    def linked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times): how often each pair of ids is linked in each text, in order. A pair is a * |B| + b."""
        span, wide = len(self.v.bytes_b), len(self.v.bytes_a) * len(self.v.bytes_b)
        text = np.repeat(np.arange(len(self.ends)), np.diff(self.token_ends[0], prepend=0))
        links = self.in_a * self.in_b
        each = np.where(links <= MANY, self.in_b, 0)[self.group_a]  # links of each token of A
        place = np.arange(int(each.sum())) + np.repeat(self.upto_b[self.group_a] - np.cumsum(each) + each, each)
        keys = np.repeat(text * wide + self.a.astype(np.int64) * span, each) + self.b[place]
        keys, times = np.unique(keys, return_counts=True)
        large = np.flatnonzero(links > MANY)
        if len(large):
            more = [(keys, times)]
            for g in large.tolist():
                start = int(self.upto_a[g])
                a, n = np.unique(self.a[start : int(self.upto_a[g + 1])], return_counts=True)
                b, m = np.unique(self.b[int(self.upto_b[g]) : int(self.upto_b[g + 1])], return_counts=True)
                own = text[start] * wide + a.astype(np.int64)[:, None] * span + b[None, :]
                more.append((own.ravel(), (n[:, None] * m[None, :]).ravel()))
            keys, at = np.unique(np.concatenate([k for k, _ in more]), return_inverse=True)
            times = np.zeros(len(keys), np.int64)
            np.add.at(times, at, np.concatenate([t for _, t in more]))
        return keys // wide, keys % wide, times


def _rows(v: Vocabularies, batch: pa.RecordBatch) -> pa.RecordBatch:
    n = batch.num_rows
    texts = [x or "" for x in batch.column("text").to_pylist()]
    ids = v.encode(texts)
    with_tokens = np.array([k for k, x in enumerate(ids) if x is not None], np.int64)
    figures, digests = np.zeros((4, n), np.int64), [""] * n
    pairs = times = np.zeros(0, np.int64)
    offsets = np.zeros(n + 1, np.int64)
    if len(with_tokens):
        size = 1 + pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
        laid = Laid(v, [ids[k] for k in with_tokens], size[with_tokens])
        figures[:, with_tokens] = laid.figures()
        for k, digest in zip(with_tokens, laid.digests(), strict=True):
            digests[k] = digest
        text, pairs, times = laid.linked()
        offsets = np.concatenate(([0], np.cumsum(np.bincount(with_tokens[text], minlength=n))))
    lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x)) for x in (pairs, times)]
    return pa.RecordBatch.from_arrays(
        [batch.column("rid"), batch.column("doc_id"), *(pa.array(x) for x in figures), pa.array(digests), *lists], schema=TOKENS,
    )


@lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def token_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """rid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the linked pairs of each row with their times."""
    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(it):
        held = vocabularies(*(paths or default_vocabularies()))
        for batch in it:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:  # a text that is longer is laid by itself
                before = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, before + LAID, "right")))
                yield _rows(held, batch.slice(at, end - at))
                at = end

    return rows.mapInArrow(released(run), ddl(TOKENS))


def align(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    paths: tuple[str, str] | None = None,
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row per row.

    A pair's count is the number of rows that hold it linked; n_best counts the links whose pair has the highest count of
    its A id (ties included), count_sum adds up the counts over links. Null and empty texts, and texts whose bytes a
    vocabulary doesn't give back, have no tokens: zeros and an empty digest. Ids may be null or repeated, and repeated
    rows count as rows. A text of any length is taken whole. Other columns are ignored; an empty table gives no rows.
    """
    path_a, path_b = paths or default_vocabularies()
    found = scratch(token_links(docs, id_col, text_col, (path_a, path_b)), "token-links")
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    span = len(vocabularies(path_a, path_b).bytes_b)
    of_one = Window.partitionBy(F.expr(f"pair div {span}"))  # at most |B| pairs
    counts = scratch(counts.withColumn("best", F.col("n") == F.max("n").over(of_one)), "pair-counts")
    small = counts.count() <= broadcast_pairs
    links = found.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "rid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"),
    )
    sums = links.join(F.broadcast(counts) if small else counts, "pair").groupBy("rid").agg(
        F.sum(F.expr("CASE WHEN best THEN times ELSE 0 END")).alias("n_best"), F.sum(F.expr("times * n")).alias("count_sum"),
    )
    out = found.drop("pairs", "times").join(sums, "rid", "left").na.fill(0, ["n_best", "count_sum"])
    return out.select(
        F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
    )
