"""Byte-level BPE through the sentencepiece library: the rank file is serialised as a sentencepiece model.

Every token becomes a piece spelt in byte-mapped characters (one printable character a byte) and scored by its negative
rank; normalisation is the identity. Pre-tokens are encoded by that model, and ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import ChunkCache, bound_batches, chunks, slices, worker_state


def byte_characters() -> list[str]:
    """For each byte value, a printable character of its own: itself where it is one, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: token in base64 and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _message(*fields: tuple[int, int | float | bytes]) -> bytes:
    """One protobuf message."""
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += _varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += _varint(number << 3) + _varint(value)
        else:
            out += _varint(number << 3 | 2) + _varint(len(value)) + value
    return out


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model in which the piece with id i is the token of rank i; the unknown piece comes last."""
    letters = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("ranks must be 0, 1, 2, ... and hold every single byte")
    pieces = [_message((1, "".join(letters[b] for b in token).encode()), (2, -float(rank))) for token, rank in by_rank]
    pieces.append(_message((1, b"<unk>"), (2, 0.0), (3, 2)))
    trainer = _message((3, 2), (4, len(pieces)), (24, 0), (35, 0), (40, len(pieces) - 1), (41, 0), (42, 0))
    identity = _message((1, b"identity"), (2, b""), (3, 0), (4, 0), (5, 0))
    return b"".join(_message((1, p)) for p in pieces) + _message((2, trainer), (3, identity))


class ByteBpe:
    """Encodes texts into ids of a rank file and decodes ids into bytes."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.whole = {token: rank for token, rank in ranks.items()}
        self.bytes_of = [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.digits = [str(i) for i in range(len(ranks))]
        self.letters = dict(enumerate(byte_characters()))
        self.match = regex.compile(pattern).findall
        self.code = "H" if len(ranks) <= 1 << 16 else "I"
        self.cache = ChunkCache(self.encode_chunks, entries=150_000)

    def encode_chunks(self, new: list[str]) -> list[bytes]:
        """Ids of each chunk, packed."""
        split = [[t.encode("utf-8", "replace") for t in self.match(c)] for c in new]
        todo = list({t for s in split for t in s} - self.whole.keys())
        found = self.model.encode([t.decode("latin-1").translate(self.letters) for t in todo], num_threads=1) if todo else []
        ids = dict(zip(todo, found, strict=True))
        whole = self.whole
        return [array(self.code, [i for t in s for i in (ids[t] if t in ids else (whole[t],))]).tobytes() for s in split]

    def encode(self, texts: list[str]) -> list[list[int]]:
        docs = self.cache.values([chunks(t) for t in texts])
        return [memoryview(b"".join(d)).cast(self.code).tolist() for d in docs]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """The one of this worker process."""
    return worker_state(("byte_bpe", path, pattern), lambda: ByteBpe(path, pattern))


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """Encodes every whole text and decodes its ids again.

    outputs names what comes beside id_col, in this order: ids (array<int>), n_tokens, ids_sha256 (of the decimal ids
    joined by one space), decoded (binary), decoded_sha256. One row for each input row, repeated rows included. A null
    text counts as empty: no ids, digests of the empty string. Strings of special tokens are ordinary text. Other columns
    of df are not read, so their names cannot clash; an empty table gives an empty table. No shuffle; memory is bounded by
    slices of a batch.
    """
    bound_batches(df.sparkSession)
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded": ("binary", pa.binary()), "decoded_sha256": ("string", pa.string())}

    def run(batches):
        bpe = byte_bpe(ranks_path, pattern)
        digits = bpe.digits.__getitem__
        make = {
            "ids": lambda ids, raw: ids,
            "n_tokens": lambda ids, raw: len(ids),
            "ids_sha256": lambda ids, raw: hashlib.sha256(" ".join(map(digits, ids)).encode()).hexdigest(),
            "decoded": lambda ids, raw: raw,
            "decoded_sha256": lambda ids, raw: hashlib.sha256(raw).hexdigest(),
        }
        for b in batches:
            for start, part in slices(b.column(1).to_pylist()):
                columns = [[] for _ in outputs]
                for ids in bpe.encode(part):
                    raw = bpe.decode(ids)
                    for column, name in zip(columns, outputs, strict=True):
                        column.append(make[name](ids, raw))
                arrays = [pa.array(c, kinds[n][1]) for c, n in zip(columns, outputs, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(part)), *arrays], names=["id", *outputs])

    kind = df.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"{n} {kinds[n][0]}" for n in outputs)])
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), *outputs)
