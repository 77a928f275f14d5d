"""Token counts of whole texts under a sentencepiece BPE model, by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch lie one after another in flat numpy arrays. In each round every pre-token merges its own
lowest-rank pair, all pre-tokens at once; those without a pair left drop out, and what survives of each is counted.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import ChunkCache, bound_batches, slices, worker_state

NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6
NEVER = np.int64(1) << 40
SPACE = "▁"


def proto_fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protobuf message, in order: (number, value)."""
    i, n = 0, len(raw)

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            length = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[i : i + length]
            i += length


class RaggedBpe:
    """Counts the pieces of texts as the sentencepiece library would for this model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        pieces: dict[str, float] = {}
        self.byte_fallback = self.dummy_prefix = self.strip = False
        kind, escape = 1, True
        for number, value in proto_fields(raw):
            if number == 1:
                x = dict(proto_fields(value))
                if x.get(3, NORMAL) == NORMAL:
                    pieces[x[1].decode()] = struct.unpack("<f", x.get(2, b"\0\0\0\0"))[0]
                elif x[3] in (USER_DEFINED, UNUSED):
                    raise ValueError("models with user-defined or unused pieces are not handled")
            elif number == 2:
                x = dict(proto_fields(value))
                kind, self.byte_fallback = x.get(3, 1), bool(x.get(35, 0))
            elif number == 3:
                x = dict(proto_fields(value))
                self.dummy_prefix, self.strip, escape = bool(x.get(3, 1)), bool(x.get(4, 1)), bool(x.get(5, 1))
                if x.get(2, b""):
                    raise ValueError("models with a normalisation table are not handled")
        if kind != 2 or not escape or self.strip or not self.byte_fallback:
            raise ValueError("expected a BPE model with byte fallback that keeps white space")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("pieces must not continue after a space")
        # Symbol numbers: 0-4 stand for characters of so many bytes that no piece has; then all characters of pieces, then the longer pieces.
        singles = sorted({c for p in pieces for c in p})
        number = {c: i + 5 for i, c in enumerate(singles)}
        for p in pieces:
            number.setdefault(p, len(number) + 5)
        self.weight = np.ones(len(number) + 5, np.int64)
        self.weight[:5] = range(5)
        for c in singles:
            if c not in pieces:
                self.weight[number[c]] = len(c.encode())
        rank_of = {s: i for i, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        pairs = {}
        for p, score in pieces.items():
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = (rank_of[score], number[p])
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [NEVER], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()] + [0], np.int64)
        self.char_codes = np.array([ord(c) for c in singles], np.int64)
        self.char_numbers = np.array([number[c] for c in singles], np.int64)
        # Places between two characters that stand side by side in no piece: nothing merges across them.
        beside = {(ord(x) << 21) | ord(y) for p in pieces for x, y in zip(p, p[1:], strict=False)}
        self.beside = np.array(sorted(beside), np.int64)
        if any(ord("\n") in (k >> 21, k & 0x1FFFFF) for k in beside):
            raise ValueError("a piece holds a line end")
        self.cut = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.cache = ChunkCache(self.count_chunks)

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a << 20 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == key, at, len(self.keys))
        return self.ranks[at], self.made[at]

    def count_chunks(self, chunks: list[str]) -> list[int]:
        """Pieces of each chunk, merged together."""
        sizes = np.array([len(c) for c in chunks], np.int64)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.searchsorted(self.char_codes, codes)
        at[at == len(self.char_codes)] = 0
        known = self.char_codes[at] == codes
        n_bytes = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        symbol = np.where(known, self.char_numbers[at], n_bytes)
        chunk = np.repeat(np.arange(len(chunks)), sizes)
        joint = codes[:-1] << 21 | codes[1:]
        near = np.searchsorted(self.beside, joint)
        near[near == len(self.beside)] = 0
        starts = np.ones(len(codes), bool)
        starts[1:] = (chunk[1:] != chunk[:-1]) | (self.beside[near] != joint)
        counts = np.zeros(len(chunks), np.int64)
        self._merge(symbol, chunk, np.cumsum(starts) - 1, counts)
        return counts.tolist()

    def _merge(self, symbol: np.ndarray, chunk: np.ndarray, seq: np.ndarray, counts: np.ndarray) -> None:
        """Merges all sequences, in rounds, and adds what survives to counts by chunk."""
        if not len(symbol):
            return
        rank, made = np.full(len(symbol), NEVER), np.zeros(len(symbol), np.int64)
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner], made[inner] = self.pair(symbol[inner], symbol[inner + 1])
        while len(symbol):
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            lengths = np.diff(np.append(starts, len(seq)))
            lowest = np.minimum.reduceat(rank, starts)
            live = lowest < NEVER
            if not live.all():
                keep = np.repeat(live, lengths)
                np.add.at(counts, chunk[~keep], self.weight[symbol[~keep]])
                symbol, chunk, seq, rank, made = (x[keep] for x in (symbol, chunk, seq, rank, made))
                lowest, lengths = lowest[live], lengths[live]
                if not len(symbol):
                    return
            own = np.repeat(np.arange(len(lengths)), lengths)
            hit = np.flatnonzero(rank == lowest[own])
            # Of overlapping pairs the leftmost goes first, then every second one.
            new_run = np.concatenate(([True], hit[1:] != hit[:-1] + 1))
            run_start = hit[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
            hit = hit[(hit - run_start) % 2 == 0]
            of = own[hit]
            first = np.concatenate(([True], of[1:] != of[:-1]))
            if not first.all():
                hit = hit[self._together(hit, of, first, symbol, seq, made, lowest)]
            symbol[hit] = made[hit]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            symbol, chunk, seq, rank, made = (x[keep] for x in (symbol, chunk, seq, rank, made))
            hit = place[hit]
            touched = np.concatenate((hit, hit[hit > 0] - 1))
            rank[touched] = NEVER
            inside = touched[touched < len(symbol) - 1]
            inside = inside[seq[inside] == seq[inside + 1]]
            rank[inside], made[inside] = self.pair(symbol[inside], symbol[inside + 1])

    def _together(self, hit, of, first, symbol, seq, made, lowest) -> np.ndarray:
        """Which of the pairs go in this round: all of a sequence's, or its leftmost if a merge may make way for a pair that goes before the others."""
        n, m = len(symbol), lowest[of]
        after, before = np.minimum(hit + 2, n - 1), np.maximum(hit - 1, 0)
        follow = (hit + 2 < n) & (seq[after] == seq[hit])
        lead = (hit > 0) & (seq[before] == seq[hit])
        early = follow & (self.pair(made[hit], symbol[after])[0] <= m)
        early |= lead & (self.pair(symbol[before], made[hit])[0] <= m)
        beside = np.concatenate((hit[1:] == hit[:-1] + 2, [False])) & follow
        early |= beside & (self.pair(made[hit], np.concatenate((made[hit][1:], [0])))[0] <= m)
        bad = np.zeros(len(lowest), bool)
        bad[of[early]] = True
        return first | ~bad[of]

    def count(self, texts: list[str]) -> list[int]:
        marked = [(" " + t if self.dummy_prefix and t else t).replace(" ", SPACE) for t in texts]
        return list(map(sum, self.cache.values([self.cut.findall(t) for t in marked])))


def ragged_bpe(path: str) -> RaggedBpe:
    """The one of this worker process."""
    return worker_state(("token_counts", path), lambda: RaggedBpe(path))


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Counts the tokens of every whole text under a sentencepiece BPE model with byte fallback.

    Returns id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), one row for each input row, repeated rows
    included. A null text counts as empty: 0 tokens. No token is added at the beginning or the end, and the strings of
    control tokens are ordinary text. Other columns of df are not read, so their names cannot clash; an empty table
    gives an empty table. There is no shuffle: one pass in Arrow batches, with memory bounded by slices of a batch.
    """

    bound_batches(df.sparkSession)

    def run(batches):
        bpe = ragged_bpe(model_path)
        for b in batches:
            texts, counts = b.column(1).to_pylist(), []
            for _, part in slices(texts):
                counts += bpe.count(part)
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) if not (t or "").isascii() else len(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
