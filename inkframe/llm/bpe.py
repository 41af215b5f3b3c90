"""Byte-level BPE encoding and decoding with a sentencepiece model made from the ranks."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from inkframe.llm import words as W
from inkframe.llm.memory import Memory

#: Code points with the property White_Space, which the split pattern's \s means.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A text falls into runs of non-space with one space before, and runs of
#: space; no pre-token crosses them.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Chunks in each of the two generations that a worker remembers, and how long one may be.
REMEMBERED = 400_000
LONGEST = 128


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank; the ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not consecutive from 0")
    return [ranks[i] for i in range(len(ranks))]


def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _number(tag: int, value: int) -> bytes:
    return _varint(tag << 3) + _varint(value)


def _bytes(tag: int, value: bytes) -> bytes:
    return _varint(tag << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece i is token i, byte-mapped, scored -i.

    Merging the pair with the greatest score is then merging the pair of least
    rank. The unknown piece, which no text reaches, takes the id after the last.
    Nothing is normalised and no space is added, dropped or escaped.
    """
    alphabet = byte_alphabet()
    pieces = []
    for rank, token in enumerate(tokens):
        surface = "".join(alphabet[b] for b in token).encode()
        pieces.append(_bytes(1, _bytes(1, surface) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, 1)))
    pieces.append(_bytes(1, _bytes(1, "⁇unk".encode()) + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2)))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(tokens)) + b"".join(_number(t, -1) for t in (41, 42, 43))
    trainer += _bytes(45, "⁇unk".encode())
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normaliser)


class Codec:
    """Encodes text to ids and decodes ids to bytes."""

    def __init__(self, ranks: str, pattern: str):
        self.tokens = read_ranks(ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.split = regex.compile(pattern)
        self.names = [str(i) for i in range(len(self.tokens))]
        self.memory = Memory(REMEMBERED)
        alphabet = byte_alphabet()
        self.table = {b: alphabet[b] for b in range(256)}

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks, each pre-token separately, and remember them as little-endian 32-bit ids."""
        each = [self.split.findall(c) for c in chunks]
        mapped = [p.encode().decode("latin-1").translate(self.table) for found in each for p in found]
        ids = self.model.encode(mapped, out_type=int, num_threads=1)
        packed = np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids))).tobytes()
        young, at, low = self.memory.young, 0, 0
        for c, found in zip(chunks, each, strict=True):
            high = low
            for part in ids[at : at + len(found)]:
                high += 4 * len(part)
            young[c] = packed[low:high]
            at, low = at + len(found), high

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; chunks that are new are learned together."""
        cut = [CHUNK.findall(t) for t in texts]
        missing = list(self.memory.lacking(set().union(*cut)))
        if missing:
            self._learn(missing)
        get = self.memory.young.__getitem__
        out = [b"".join(map(get, chunks)) for chunks in cut]
        self.memory.forget(c for c in missing if len(c) > LONGEST)
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], np.int32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


#: Columns that encoding can give, and their types.
OUT = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks: str, pattern: str) -> Codec:
    """The codec of a vocabulary, made once per process."""
    key = (ranks, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    _, offsets = W.buffers(column)
    for low, high in W.slices(offsets):
        yield low, ["" if x is None else x for x in column.slice(low, high - low).to_pylist()]


def _map(documents: DataFrame, ranks: str, pattern: str, out: list[str]) -> DataFrame:
    """Every column but text, and those of OUT that ``out`` names."""
    keep = [c for c in documents.columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(ranks, pattern)
        for batch in batches:
            for low, texts in _texts(batch.column("text")):
                packed = made.encode_all(texts)
                counts = np.array([len(p) // 4 for p in packed], np.int64)
                columns = {"n_tokens": pa.array(counts)}
                if "ids" in out:
                    ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
                    columns["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packed), np.int32)))
                if "ids_sha256" in out:
                    shown, decoded = zip(*(_digests(made, np.frombuffer(p, np.int32).tolist()) for p in packed), strict=True)
                    columns |= {"ids_sha256": pa.array(shown, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(low, len(texts)) for c in keep), *(columns[n] for n in out)], names=[*keep, *out])

    return documents.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{n}` {OUT[n]}" for n in out)]))


def encode_documents(documents: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Every column but text, and ``ids`` and their number.

    A null text is encoded as the empty text; both give no ids. Texts of any
    length are encoded whole. Rows are independent of each other. Input columns
    named ids or n_tokens are replaced.
    """

    return _map(documents.drop("ids", "n_tokens"), ranks, pattern, ["n_tokens", "ids"])


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Every column but ids, and the decoded ``bytes`` (null ids: no bytes)."""
    keep = [c for c in encoded.columns if c not in ("ids", "bytes")]
    kinds = {f.name: f.dataType.simpleString() for f in encoded.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(ranks, pattern)
        for batch in batches:
            found = [made.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.binary())], names=[*keep, "bytes"])

    return encoded.select(*keep, "ids").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "`bytes` binary"]))


def _digests(made: Codec, ids: list[int]) -> tuple[str, str]:
    """SHA-256 of the ids and of the bytes that they decode to."""
    shown = " ".join(map(made.names.__getitem__, ids)).encode()
    return hashlib.sha256(shown).hexdigest(), hashlib.sha256(made.decode(ids)).hexdigest()


def encode_and_digest(documents: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """As ``encode_documents``, with the digests of ``digest_documents``."""
    return _map(documents.drop(*OUT), ranks, pattern, list(OUT))


def digest_documents(documents: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what the ids decode to.

    Nulls, empty and long texts as in ``encode_documents``; repeated rows give
    equal results; an empty table gives an empty result.
    """
    return _map(documents.select("doc_id", "text"), ranks, pattern, ["n_tokens", "ids_sha256", "decoded_sha256"])
