"""Byte-level BPE: a sentencepiece model written straight from a rank vocabulary.

Each byte becomes one printable character, each vocabulary entry a piece whose score is its negative
rank, and the normaliser is the identity, so sentencepiece merges exactly the pairs that the ranks ask
for. Texts are split by the pre-token pattern first and every pre-token is encoded alone; an entry that
equals a whole pre-token is taken as it is, as rank tokenizers do. Decoding reads the model's pieces by id and
maps their characters back to bytes.

Token ids travel as packed little-endian unsigned 32-bit integers (``binary``), the form in which token
shards are stored; ``unpack`` gives an array. A null text counts as empty and gives no ids. A very long text is
coded whole, in memory of some twenty times its size. Repeated rows get equal ids; columns named ids or decoded
are replaced; no rows in, no rows out.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrine.llm.common import batched, release

#: Distinct pre-tokens whose ids a Python worker remembers; it starts anew beyond.
REMEMBERED = 120_000
#: Texts that are coded before their ids are handed on.
PIECE = 256


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries in the order of their ranks, which must run from 0 without gaps."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    entries = sorted(ranks, key=ranks.__getitem__)
    if [ranks[e] for e in entries] != list(range(len(entries))):
        raise ValueError("ranks must run from 0 without gaps")
    return entries


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


#: Bytes as characters that no splitter or normaliser treats in a special way.
_CHARS = {b: chr(0x4E00 + b) for b in range(256)}


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_CHARS)


def unmapped(piece: str) -> bytes:
    return bytes(ord(c) - ord(_CHARS[0]) for c in piece)


def model_proto(entries: list[bytes]) -> bytes:
    """A serialised sentencepiece model of kind BPE whose ids are the ranks; one more id, never used, is its unknown piece."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, mapped(e).encode()) + _field(2, -float(rank)) + _field(3, normal)) for rank, e in enumerate(entries)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    none = (1 << 64) - 1  # -1 as a varint
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(entries)) + b"".join(_field(n, none) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes in one Python worker."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex
        import sentencepiece

        entries = read_ranks(vocabulary)
        self.whole = {e: struct.pack("<I", rank) for rank, e in enumerate(entries)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(entries))
        # what the model's pieces stand for, by the inverse of the byte mapping; its last id is the unknown piece
        self.pieces = [unmapped(p) for p in self.model.id_to_piece(list(range(len(entries))))]
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        tokens = self.split(text)
        known = self.known
        try:
            return b"".join([known[t] for t in tokens])
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        rest = []
        for token in set(tokens).difference(known):
            raw = token.encode()
            if raw in self.whole:
                known[token] = self.whole[raw]
            else:
                rest.append((token, mapped(raw)))
        if rest:
            for (token, _), ids in zip(rest, self.model.encode([m for _, m in rest], num_threads=1), strict=True):
                known[token] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join([known[t] for t in tokens])

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str) -> Codec:
    """One codec a worker."""
    return Codec(vocabulary, pattern)


def encode(text: Column, vocabulary: str, pattern: str) -> Column:
    """Packed ids of each whole text."""

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        c = codec(vocabulary, pattern)
        return pd.Series([c.encode(t) for t in texts], dtype=object)

    return ids(F.coalesce(text, F.lit("")))


def decode(ids: Column, vocabulary: str, pattern: str) -> Column:
    """The bytes that packed ids stand for."""

    @F.pandas_udf("binary")
    def raw(packed: pd.Series) -> pd.Series:
        c = codec(vocabulary, pattern)
        return pd.Series([c.decode(p) for p in packed], dtype=object)

    return raw(F.coalesce(ids, F.lit(b"")))


def unpack(ids: Column) -> Column:
    """Packed ids as an array of longs."""

    @F.pandas_udf("array<long>")
    def array(packed: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(p, "<u4").astype("int64") for p in packed], dtype=object)

    return array(ids)


def tokenized(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """docs plus ids and decoded (both binary); columns of docs with these names are replaced.

    One Python worker a task does both, in pieces of PIECE texts: decoding starts from the packed ids alone.
    """
    docs = batched(docs.drop("ids", "decoded"))
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    at = docs.columns.index(text)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(vocabulary, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, PIECE):
                part = batch.slice(k, PIECE)
                ids = [c.encode(t or "") for t in part.column(at).to_pylist()]
                columns = [*part.columns, pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "ids", "decoded"])
        del c
        release()

    return docs.mapInArrow(code, schema)


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """One row per document: how many ids, and digests of the ids and of what they decode to."""
    return tokenized(docs.select("doc_id", "text"), vocabulary, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
