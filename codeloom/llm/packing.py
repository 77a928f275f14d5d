"""Packs documents of tokens into sequences of one length by exact complements, then best fit.

Lengths have as many values as a sequence has places, so that a histogram of them holds all that a plan needs to know.
The plan is made from it: for a gap, single lengths, pairs and triples that fill it exactly are looked up by their sum and
consumed as often as their counts allow; what is left goes best fit. Tasks then give each piece its place by its number
among the pieces of its length. Neither texts nor pieces pass through the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import bound_batches, materialize, slices
from codeloom.llm.token_files import encoder

#: A sequence's share of the plan: (how many sequences, {length: how often each of them holds it}).
Pattern = tuple[int, dict[int, int]]


class Complements:
    """The lengths that are left, and an index by sum of the single lengths, pairs and triples of them.

    Sums are at most the capacity, so the index is by address: bit s of an integer says that lengths with the sum s are left.
    Singles and pairs are exact at all times. Triples only ever go, so that a bit not set is right and a bit set is looked up.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, Counter({x: n for x, n in counts.items() if n})
        self.all = (1 << capacity + 1) - 1
        self.single = sum(1 << x for x in self.left)
        #: bit capacity - x for each length x that is left: shifted, it lines up complements
        self.mirror = sum(1 << capacity - x for x in self.left)
        self.index_triples()

    def index_triples(self) -> None:
        pairs = triples = 0
        for x in self.left:
            pairs |= self.single << x & self.all
        for x in self.left:
            triples |= pairs << x & self.all
        self.triple = triples

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.single &= ~(1 << length)
            self.mirror &= ~(1 << self.capacity - length)

    def give(self, length: int, n: int) -> None:
        self.left[length] += n
        self.single |= 1 << length
        self.mirror |= 1 << self.capacity - length

    def pair(self, total: int) -> tuple[int, ...] | None:
        """The two lengths left with this sum that are furthest apart."""
        found = self.single & (self.mirror >> self.capacity - total)
        x = found.bit_length() - 1
        if x > 0 and 2 * x == total and self.left[x] < 2:
            return None  # the only pair is a length and itself, of which there is one
        return (x, total - x) if x > 0 else None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths left that fill the gap exactly."""
        if self.single >> gap & 1:
            return (gap,)
        if gap > 1 and (found := self.pair(gap)):
            return found
        if gap > 2 and self.triple >> gap & 1:
            rest = self.single & (1 << gap - 1) - 1
            while rest:
                x = rest.bit_length() - 1
                if 3 * x < gap:
                    break  # x would be the largest of the three
                self.take(x, 1)
                found = self.pair(gap - x)
                self.give(x, 1)
                if found:
                    return (x, *found)
                rest ^= 1 << x
            self.index_triples()  # the index named a triple that is gone
        return None


def exact(index: Complements) -> Iterator[Pattern]:
    """Consumes combinations that fill a sequence to the last place. From the longest length down: as many of it as fit, or
    up to two fewer, and what fills the gap that they leave."""
    capacity = index.capacity
    for length in sorted(index.left, reverse=True):
        while most := min(index.left[length], capacity // length):
            for base in range(most, max(most - 3, 0), -1):
                gap = capacity - base * length
                index.take(length, base)
                found = index.fill(gap) if gap else ()
                index.give(length, base)
                if found is not None:
                    break
            else:
                break
            need = Counter({length: base})
            need.update(found)
            times = min(index.left[x] // n for x, n in need.items())
            for x, n in need.items():
                index.take(x, n * times)
            yield times, dict(need)


def best_fit(left: dict[int, int], capacity: int) -> Iterator[Pattern]:
    """Puts lengths, from the longest down, where they leave the smallest gap; a new sequence where none fits. Sequences that are alike are handled together."""
    open_: dict[int, list[Pattern]] = {}
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                each = min(n, capacity // length)
                times, content, gap = n // each, {}, capacity
            else:
                times, content = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                each = min(n, gap // length)
                used = min(times, n // each)
                if used < times:
                    open_.setdefault(gap, []).append((times - used, content))
                times = used
            n -= each * times
            rest, now = gap - each * length, (times, content | {length: content.get(length, 0) + each})
            if rest:
                open_.setdefault(rest, []).append(now)
            else:
                yield now
    for patterns in open_.values():
        yield from patterns


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Sequences for so many pieces of each length, from 1 to capacity. Its size is bounded by the capacity, whatever the counts are: every pattern uses up a length of which too few are left for another."""
    index = Complements(counts, capacity)
    done = list(exact(index))
    return done + list(best_fit(index.left, capacity))


class Places:
    """A plan as sorted arrays. Pieces are numbered from the shortest length up, within a length by rank."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.before = np.zeros(capacity + 2, np.int64)
        for length, n in counts.items():
            self.before[length + 1] = n
        self.before = np.cumsum(self.before)
        used, rows, sequence = Counter(), [], 0
        for times, content in plan(counts, capacity):
            at = 0
            for length, each in sorted(content.items(), reverse=True):
                rows.append((int(self.before[length]) + used[length], sequence, each, at))
                used[length] += each * times
                at += each * length
            sequence += times
        if dict(used) != {x: n for x, n in counts.items() if n}:
            raise ValueError("the plan does not use every piece once")
        self.sequences = sequence
        self.first, self.sequence, self.each, self.at = np.array(sorted(rows), np.int64).reshape(-1, 4).T.copy()

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of the pieces of these lengths and ranks."""
        number = self.before[length] + rank
        row = np.searchsorted(self.first, number, side="right") - 1
        nth = number - self.first[row]
        return self.sequence[row] + nth // self.each[row], self.at[row] + nth % self.each[row] * length


def cut_into_pieces(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of at most capacity token ids of each document with end_id: id, piece, start, length, ids_crc32, ids if they are kept; block and nth number the pieces of a length within the task that wrote them."""
    bound_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enc, block, seen = encoder(tokenizer_path), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4")
        for b in batches:
            for first, texts in slices(b.column(1).to_pylist()):
                row, piece, start, length, crc, nth, ids = [], [], [], [], [], [], []
                for i, raw in enumerate(enc.encode(texts)):
                    tokens = np.concatenate([np.frombuffer(raw, f"<u{enc.width}").astype("<u4"), end])
                    for k, at in enumerate(range(0, len(tokens), capacity)):
                        part = tokens[at : at + capacity]
                        row.append(first + i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        nth.append(seen[len(part)])
                        seen[len(part)] += 1
                        ids.append(part)
                columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                columns += [pa.array([block] * len(row), pa.int32()), pa.array(nth, pa.int64())]
                if keep_ids:
                    flat = pa.array(np.concatenate(ids).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, block int, nth bigint" + ", ids array<int>" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id and offset of every piece, and its ids if they are kept.

    A document longer than capacity is cut into pieces of capacity and a rest; all others stay whole. Sequences hold no
    gaps but at their ends. A null text counts as empty and has the end id alone; null and repeated ids are documents of
    their own; an empty table gives an empty table. Other columns are not read, so their names cannot clash.

    Texts are encoded once, and the pieces written to the shared folder. Tasks numbered them by length as they wrote, so
    that a rank needs no sort: counts a task and length, summed up over the tasks, are joined to the pieces. A length that is
    a third of all rows is split by those tasks. The driver gets capacity counts and sends a plan of bounded size.
    """
    spark = df.sparkSession
    pieces = materialize(cut_into_pieces(df, tokenizer_path, end_id, capacity, id_col, text_col, keep_ids), "pieces")
    counts = materialize(pieces.groupBy("block", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(Places(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("block", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["block", "length"]).withColumn("rank", F.col("before") + F.col("nth")).drop("block", "nth", "before")
    kept = [c for c in ranked.columns if c != "rank"]

    def run(batches):
        places = shared.value
        for b in batches:
            sequence, offset = places.of(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id bigint, offset bigint"
    order = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids]
    return ranked.mapInArrow(run, schema).select(F.col("id").alias(id_col), *order)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """sequence_id, ids and bounds of each sequence of what pack() gives with ids: its token ids in order, and for each piece
    in it the document, the piece and its offset. A group holds no more than the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", F.col(id_col).alias("id"), "piece")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    bound = F.transform("parts", lambda p: F.struct(p["id"].alias(id_col), p["piece"].alias("piece"), p["offset"].alias("offset")))
    return grouped.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), bound.alias("bounds"))
