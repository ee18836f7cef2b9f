"""Operator 3: byte-level BPE encoding and decoding with a sentencepiece model made from a vocabulary.

The model file is serialised here, straight from the ranks: a piece per token, its bytes mapped to
one character each, its score the negative rank, type BPE, normalisation identity. Texts are cut by
the vocabulary's pattern; each pre-token that isn't itself a token is encoded by sentencepiece,
which merges by highest score, that is by lowest rank, leftmost first. Nothing is trained.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean
from .pretoken import PretokenEncoder

#: Byte b stands as this character plus b: two bytes of UTF-8, no white space, no normalisation.
BYTE_BASE = 0x100
_UNKNOWN, _BPE = 2, 2


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (x.split() for x in f if x.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protobuf field."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def to_chars(token: bytes) -> str:
    return token.decode("latin-1").translate(_CHARS)


_CHARS = {b: chr(BYTE_BASE + b) for b in range(256)}


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ``ModelProto``: piece 0 is unknown, then the tokens by rank.

    Piece ``k + 1`` is the token of the ``k``-th lowest rank. Raises ValueError where a single
    byte is missing, since then not every text has an encoding, or where ranks repeat.
    """
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for bytes {missing[:5]}")
    if len(set(ranks.values())) != len(ranks):
        raise ValueError("ranks repeat")
    order = sorted(ranks, key=ranks.get)
    pieces = _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, _UNKNOWN))
    pieces += b"".join(_field(1, _field(1, to_chars(t)) + _field(2, -float(k))) for k, t in enumerate(order))
    trainer = _field(3, _BPE) + _field(4, len(order) + 1)
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    """Encoder and decoder of one vocabulary; made once in each Python worker."""

    _made: dict[tuple[str, str], "ByteBPE"] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece

        self.ranks = ranks
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.rank_of = [-1, *sorted(ranks.values())]
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.cut = PretokenEncoder(pattern, self._pretoken, pretokens=50_000, pieces=100_000)

    @classmethod
    def at(cls, path: str, pattern: str) -> "ByteBPE":
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(read_ranks(path), pattern)
        return cls._made[path, pattern]

    def _pretoken(self, t: str) -> list[int]:
        data = t.encode()
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return [self.rank_of[i] for i in self.model.encode(to_chars(data))]

    def encode(self, text: str) -> bytes:
        return self.cut.encode(text)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of little-endian unsigned 32-bit ids; KeyError for an id outside the vocabulary."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, decode_too: bool = False) -> DataFrame:
    """``(doc_id, ids)``, and ``decoded`` with ``decode_too``: whole texts to ids, one row a row.

    ``ids`` is binary, little-endian unsigned 32-bit; ``decoded`` is the bytes of the decoded ids.
    A null text counts as empty and has no ids. A null doc_id stays null; repeated rows come out as
    often as they came in. No shuffle: every row is encoded where it is read.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        bpe = ByteBPE.at(path, pattern)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array(ids, pa.binary())] + ([pa.array(map(bpe.decode, ids), pa.binary())] if decode_too else [])
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"][: len(cols)])

    schema = "doc_id long, ids binary" + ", decoded binary" * decode_too
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, decoded)`` of ``(doc_id, ids)``; null ids decode to no bytes."""
    bound_batches(encoded.sparkSession)

    def run(batches):
        bpe = ByteBPE.at(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or b"") for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(lean(run), "doc_id long, decoded binary")
