"""SentencePiece encoding and decoding for merge-type (BPE) models with byte fallback.

Encoding is exact by backtracking (bpe.BacktrackEncoder). A piece never holds a word mark after another character, so
a text falls apart into segments, each a run of marks and what follows up to the next mark. A segment falls apart
further between two characters that stand side by side in no piece, since no merge can cross there. The parts are
encoded by themselves and remembered per worker in a bounded memory, which changes no result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.bpe import BacktrackEncoder, Merges
from loomframe.llm.common import ddl, per_document, ship

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("decoded", pa.string())])


class Codec:
    """encode() and decode() as the library does them without begin and end ids, and without its sampling."""

    def __init__(self, model_file: str, remember: int = 500_000) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        special = [i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)]
        self.byte_ids = {model.id_to_piece(i): i for i in special if model.is_byte(i)}
        self.byte_of = {i: int(p[1:-1], 16) for p, i in self.byte_ids.items()}
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        skip = set(special)
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in skip}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece of this model holds a word mark after another character")
        scores = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.encoder = BacktrackEncoder(self.ids, Merges(lambda a, b, get=scores.get: get(a + b)))
        self.skipped = skip - set(self.byte_of)
        #: Ids from here on are plain pieces.
        self.plain_from = max(skip, default=-1) + 1
        self.remember = remember
        self.joints = {p[k : k + 2] for p in self.encoder.tokens for k in range(len(p) - 1)}
        #: For a segment without its first mark: its ids as 32-bit numbers.
        self.known: dict[str, bytes] = {}
        #: By id: a comma and the id in decimal, and the piece's text where that is short, each padded with zeros.
        self.spelled = np.array([f",{i}".encode() for i in range(size)], "S8").view(np.uint64)
        self.texts = np.zeros(size, "S16")
        short = [(i, t) for p, i in self.ids.items() if len(t := p.replace(MARK, " ").encode()) <= 16 and b"\0" not in t]
        self.texts[[i for i, _ in short]] = [t for _, t in short]
        self.short = np.zeros(size, bool)
        self.short[[i for i, _ in short]] = True
        self.parts: dict[str, list[int]] = {}

    def segment(self, text: str) -> list[int]:
        out: list[int] = []
        ids = self.ids
        for token in self.encoder.encode(text):
            i = ids.get(token)
            if i is None:
                out += [self.byte_ids[f"<0x{b:02X}>"] for b in token.encode("utf-8", "replace")]
            else:
                out.append(i)
        return out

    def segments(self, text: str) -> list[str]:
        """The segments without their first mark."""
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [s[1:] for s in _SEGMENT.findall(MARK + text.replace(" ", MARK))]

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for i in self._split(MARK + s)]

    def decode(self, ids: list[int]) -> str:
        return self._join(ids)[1:] if ids and self.pieces[ids[0]].startswith(MARK) else self._join(ids)

    def _join(self, ids: list[int]) -> str:
        if min(ids, default=0) >= self.plain_from:
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_bytes(raw))
                raw = bytearray()
            if i not in self.skipped:
                out.append(self.pieces[i])
        if raw:
            out.append(_bytes(raw))
        return "".join(out).replace(MARK, " ")

    def _split(self, segment: str) -> list[int]:
        """Ids of a segment by its parts."""
        joints, parts = self.joints, self.parts
        cuts = [k for k, joint in enumerate(map(add, segment, segment[1:]), 1) if joint not in joints]
        out: list[int] = []
        for part in map(segment.__getitem__, map(slice, [0, *cuts], [*cuts, len(segment)])) if cuts else (segment,):
            ids = parts.get(part)
            if ids is None:
                ids = self.segment(part)
                if len(part) <= 100:
                    if len(parts) >= self.remember:
                        parts.clear()
                    parts[part] = ids
            out += ids
        return out

    def _learn(self, segment: str) -> bytes:
        found = array("i", self._split(MARK + segment)).tobytes()
        if len(segment) <= 100:
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[segment] = found
        return found

    def ids_of(self, text: str) -> np.ndarray:
        """encode() as an array."""
        segments = self.segments(text)
        found = list(map(self.known.get, segments))
        if None in found:
            learn, get = self._learn, self.known.get
            found = [x or get(s) or learn(s) for x, s in zip(found, segments, strict=True)]
        return np.frombuffer(b"".join(found), np.int32)

    def decoded(self, ids: np.ndarray) -> bytes:
        """decode() of an array in UTF-8: the pieces of all ids side by side, without the space before the first."""
        if not self.short[ids].all():  # bytes, long pieces
            return self.decode(ids.tolist()).encode("utf-8", "replace")
        out = self.texts[ids].tobytes().translate(None, b"\0")
        return out[1:] if len(ids) and self.pieces[ids[0]].startswith(MARK) else out

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of what the ids decode to."""
        ids = self.ids_of(text)
        joined = self.spelled[ids].tobytes().translate(None, b"\0")[1:]
        return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(self.decoded(ids)).hexdigest()


def _bytes(raw: bytearray) -> str:
    """UTF-8 with one replacement character for every byte that isn't valid."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return _bytes(raw[: e.start]) + "�" + _bytes(raw[e.start + 1 :])


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """id_col, ids and the decoded text of each row. Null text counts as empty: no ids, empty text. Ids may be null or
    repeated; each input row gives one row. Other columns are ignored. model_file None: the public 32k model."""
    return _apply(docs, id_col, text_col, TOKENS, model_file, lambda c, t: ((ids := c.encode(t)), c.decode(ids)))


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """As encode_documents, but n_tokens and the digests of ids and decoded text, so that no id list is shipped."""
    return _apply(docs, id_col, text_col, SCHEMA, model_file, Codec.digest)


def _apply(docs, id_col, text_col, schema, model_file, fn):
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(it):
        held = codec(model_file or default_model())
        return per_document(lambda t: fn(held, t), schema)(it)

    return rows.mapInArrow(run, ddl(schema)).withColumnRenamed("doc_id", id_col)
