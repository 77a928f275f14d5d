"""Removal of repeated byte strings, by merging Burrows-Wheeler transforms.

A string of `length` bytes that starts at two places is looked for in three steps.

1. Candidates. Every window of `length` bytes names the smallest 8-gram hash among its first SPREAD places, its anchor: equal
   windows name the same one. All windows of one anchor hold the bytes from the anchor to length - SPREAD + 1 beyond it, its
   core; anchors whose core occurs once have no repeated window. Of the others, those whose whole surroundings (the bytes of
   all their windows) occur twice are repeated throughout and go on as one representative.
2. Ranges. Anchors that share a core but not their surroundings are cut into ranges of windows, shorter towards the ends, and
   each range again has a core, which is longer. A range becomes a short text: the bytes before its core, one symbol for the
   core, the bytes after it. A window of a range of q windows is then q symbols.
3. Merge. Texts of equal cores meet in one task. Shards of them are given Burrows-Wheeler transforms, and the transforms are
   merged by refining their interleave: after round k the suffixes of all shards are in the order of their first k symbols,
   each round moving shard numbers only. Suffixes that no round has told apart after q rounds have a common prefix of q
   symbols: they are one repeated interval.

A document is known by 128 bits of its text, so that ids play no part. Rows are packed: each task sends each bucket a few arrays of records, and sends what it
meets again once. A core with many different surroundings (the ends of a passage that much of the corpus holds) does not
meet in one task: its task says so twice and asks for its ranges at once, and ranges of such a core are cut into single
windows, which are counted by bucket of the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import bound_batches, discard, materialize, shuffle_parts, worker_state

LENGTH = 400
#: Passages are made of strings of so many bytes: about 35 words of prose, so that one of over 50 words is not missed.
SHORT, PASSAGE_WORDS = 200, 50
#: Places that a window's anchor may have.
SPREAD = 96
GRAM = 8
#: Bytes handled together; anchors, of about so many bytes of text, that are compared before they are sent; bytes of text for each bucket; tasks of a shuffle, at most.
SEGMENT, FLUSH, BUCKET_BYTES, TASKS = 1 << 20, 16 << 20, 32 << 20, 20_000
#: Surroundings of one core in one flush that go to the core's bucket; of more, two go.
CROWD = 8
#: Texts that a task cuts before it sends them.
TEXTS = 50_000
#: Bytes of short texts in a bucket beyond which its crowded cores are looked for, and texts that make a core crowded.
HOT_BYTES, HOT_TEXTS = 8 << 20, 50_000
#: Texts of one merge, and shards that they are cut into.
MERGE_TEXTS, SHARDS = 20_000, 8
#: What a broadcast may weigh; beyond, texts are shuffled to their spans.
BROADCAST_BYTES = 32 << 20

KEY = [("k1", "<i8"), ("k2", "<i8")]
ANCHOR = np.dtype([("core", "<u8"), ("around", "<u8"), *KEY, ("low", "<u4"), ("more", "u1"), ("at", "u1"), ("twice", "u1"), ("told", "u1")])
SPAN = np.dtype([*KEY, ("low", "<u4"), ("high", "<u4")])
ASK = np.dtype([*KEY, ("low", "<u4"), ("more", "u1"), ("at", "u1"), ("twice", "u1")])
TEXT = np.dtype([("core", "<u8"), *KEY, ("low", "<u4"), ("size", "u1"), ("n_left", "u1"), ("n_right", "u1"), ("twice", "u1"), ("left", "u1", 16), ("right", "u1", 16)])
WINDOW = np.dtype([("hash", "<u8"), ("more", "<u8"), *KEY, ("low", "<u4"), ("twice", "u1")])
TYPES = {"anchor": ANCHOR, "span": SPAN, "ask": ASK, "text": TEXT, "window": WINDOW}
KINDS = {k: i for i, k in enumerate(TYPES)}
SCHEMA = "bucket int, kind int, records binary"


def ranges() -> list[tuple[int, int]]:
    """Ranges (first, last) of a window's distance from its anchor: 1, 1, 2, 4, 8, 16, 16, ... long, from either end."""
    half, out, at = SPREAD // 2, [], 0
    while at < half:
        size = min(max(1, at), 16, half - at)
        out.append((at, at + size - 1))
        at += size
    return out + [(SPREAD - 1 - b, SPREAD - 1 - a) for a, b in reversed(out)]


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the documents data[start:end]: document number, place, and first and last start of their windows."""
    n = len(data)
    size = -(-(n + SPREAD) // SPREAD) * SPREAD
    padded = data + bytes(size - n + 2 * GRAM)
    gram = np.empty(size, np.uint64)
    for k in range(GRAM):
        v = np.frombuffer(padded, "<u8", offset=k, count=(len(padded) - k) // GRAM)
        part = gram[k::GRAM]
        part[:] = v[: len(part)]
    gram *= np.uint64(0x9E3779B97F4A7C15)
    gram &= np.uint64(0xFFFFFFFF00000000)
    gram |= np.uint64(0xFFFFFFFF) - np.arange(size, dtype=np.uint64)  # of equal hashes the last
    rows = gram.reshape(-1, SPREAD)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: size - SPREAD + 1], before[SPREAD - 1 :])[:n]
    place = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    long = np.flatnonzero(ends - starts >= length)
    if not len(long):
        return (np.zeros(0, np.int64),) * 4
    edge = np.zeros(n + 1, np.int64)
    edge[starts[long]] += 1
    edge[ends[long] - length + 1] -= 1
    valid = np.cumsum(edge[:n]) > 0
    first = np.ones(n, bool)
    first[1:] = place[1:] != place[:-1]
    first[starts[long]] = True
    low = np.flatnonzero(first & valid)
    doc = long[np.searchsorted(starts[long], low, side="right") - 1]
    high = np.minimum(np.append(low[1:], n) - 1, ends[doc] - length)
    return doc, place[low], low, high


def _packed(records: np.ndarray, kind: str, n: int) -> Iterator[pa.RecordBatch]:
    """Records by bucket, a row each: anchors and texts by core, windows by their hash, the others by document."""
    if not len(records):
        return
    by = records["core"] if kind in ("anchor", "text") else records["hash"] if kind == "window" else records["k1"].view(np.uint64) >> np.uint64(20)
    bucket = (by % np.uint64(n)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = np.append(cut[1:], len(bucket))
    rows = [records[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), pa.array([KINDS[kind]] * len(rows), pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "kind", "records"])


def _dealt(df: DataFrame, n: int) -> DataFrame:
    """Rows by bucket: a task each, or, of more buckets than TASKS, several buckets one after another."""
    if n <= TASKS:
        return df.repartitionById(n, F.col("bucket"))
    return df.repartitionById(TASKS, F.col("bucket") % TASKS).sortWithinPartitions("bucket")


def _buckets(batches: Iterator[pa.RecordBatch], *kinds: str) -> Iterator[list[np.ndarray]]:
    """For each bucket of a task, its records of each of the kinds."""
    worker_state(("suffix_dedup",))
    now, raw = None, {k: [] for k in kinds}
    of = {KINDS[k]: k for k in kinds}
    take = lambda: [np.frombuffer(b"".join(raw.pop(k)), TYPES[k]) for k in kinds]
    for b in batches:
        for bucket, kind, records in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if bucket != now:
                if now is not None:
                    yield take()
                now, raw = bucket, {k: [] for k in kinds}
            raw[of[kind]].append(records)
    if now is not None:
        yield take()


def _same(*columns: np.ndarray) -> np.ndarray:
    """Whether each of the sorted rows equals the one before it."""
    out = np.zeros(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_and.reduce([c[1:] == c[:-1] if c.ndim == 1 else (c[1:] == c[:-1]).all(1) for c in columns])
    return out


def _classes(same: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted rows: class numbers, whether a class has two members or more, and each class's first row."""
    number = np.cumsum(~same) - 1
    heads = np.flatnonzero(~same)
    count = np.bincount(number, minlength=len(heads)) + (np.bincount(number, weights=twice, minlength=len(heads)) > 0)
    return number, count > 1, heads


def _spans(records: np.ndarray) -> np.ndarray:
    out = np.empty(len(records), SPAN)
    for k in ("k1", "k2", "low"):
        out[k] = records[k]
    out["high"] = records["low"] + (records["more"] if "at" in records.dtype.names else records["size"] - 1)
    return out


def _segments(keys: list[tuple[int, int]], texts: list[bytes], runs: list[bytes | None], length: int) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """Runs of about SEGMENT bytes: (k1, k2, offset) and bytes; longer texts are cut so that each window lies whole in one piece.

    Where runs holds spans of a text, only these are its pieces.
    """
    head, body, size = [], [], 0
    for (k1, k2), text, spans in zip(keys, texts, runs, strict=True):
        parts = [(0, len(text))] if spans is None else [(x, y) for x, y in _pieces(spans)]
        for x, y in parts:
            for at in range(x, y - length + 1, SEGMENT):
                head.append((k1, k2, at))
                body.append(text[at : min(at + SEGMENT + length - 1, y)])
                size += len(body[-1])
                if size >= SEGMENT:
                    yield head, body
                    head, body, size = [], [], 0
    if body:
        yield head, body


def _pieces(records: bytes) -> list[tuple[int, int]]:
    """Start and end of merged spans, whose field high is the end."""
    spans = np.frombuffer(records, SPAN)
    return list(zip(spans["low"].tolist(), spans["high"].tolist(), strict=True))


def _find_anchors(n: int, length: int):
    """Step 1, of each task: anchors by core, and spans of those whose surroundings it meets twice itself."""

    def found(head: list[tuple[int, int, int]], body: list[bytes]) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        data = b"".join(body)
        sizes = np.array([len(x) for x in body], np.int64)
        ends = np.cumsum(sizes)
        doc, place, low, high = anchors(data, ends - sizes, ends, length)
        a = np.empty(len(doc), ANCHOR)
        core_ends = (place + length - SPREAD + 1).tolist()
        a["core"] = [digest(data[x:y]) for x, y in zip(place.tolist(), core_ends, strict=True)]
        a["around"] = [digest(data[x:y]) for x, y in zip(low.tolist(), (high + length).tolist(), strict=True)]
        names = np.array([(x, y) for x, y, _ in head], KEY)
        base = np.array([o for _, _, o in head], np.int64) - (ends - sizes)
        a["k1"], a["k2"] = names["k1"][doc], names["k2"][doc]
        a["low"], a["more"], a["at"], a["twice"], a["told"] = low + base[doc], high - low, place - low, 0, 0
        a["around"] ^= a["at"].astype(np.uint64) << np.uint64(56)
        return a

    def send(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a = np.concatenate(parts)
        a = a[np.lexsort((a["around"], a["core"]))]
        number, repeated, heads = _classes(_same(a["core"], a["around"]), a["twice"])
        yield from _packed(_spans(a[repeated[number]]), "span", n)
        a["twice"] = repeated[number]
        a = a[heads]
        # Of a crowded core two go to its bucket, to tell of it, and the ranges of all are asked for here.
        core = np.cumsum(~_same(a["core"])) - 1
        starts = np.flatnonzero(~_same(a["core"]))
        crowded = (np.bincount(core) > CROWD)[core] if len(core) else np.zeros(0, bool)
        a["told"] = crowded
        yield from _packed(a[~crowded | (np.arange(len(a)) - starts[core] < 2)], "anchor", n)
        yield from _packed(_asks(a[crowded]), "ask", n)

    def run(batches: Iterator[pa.RecordBatch]):
        worker_state(("suffix_dedup",))
        parts, size = [], 0
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            runs = b.column(3).to_pylist() if b.num_columns > 3 else [None] * len(keys)
            for head, body in _segments(keys, b.column(2).cast(pa.binary()).to_pylist(), runs, length):
                parts.append(found(head, body))
                size += sum(map(len, body))
                if size >= FLUSH:
                    yield from send(parts)
                    parts, size = [], 0
        if parts:
            yield from send(parts)

    return run


def _asks(a: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), ASK)
    for k in ASK.names:
        out[k] = a[k]
    return out


def _resolve_anchors(n: int):
    """Step 1, all tasks' anchors of a core together: spans of what is repeated throughout; asks for the texts of cores that several surroundings share."""

    def run(batches: Iterator[pa.RecordBatch]):
        for a, found, asked in _buckets(batches, "anchor", "span", "ask"):
            yield from _packed(found, "span", n)
            yield from _packed(asked, "ask", n)
            a = a[np.argsort(a["core"], kind="stable")]
            a = a[_several(_same(a["core"]))]
            a = a[np.lexsort((a["told"], a["around"], a["core"]))]
            number, repeated, heads = _classes(_same(a["core"], a["around"]), a["twice"])
            yield from _packed(_spans(a[repeated[number]]), "span", n)
            a = a[heads]
            pair = _several(_same(a["core"]))
            a, repeated = a[pair], repeated[pair]
            # A core all of whose surroundings are repeated has nothing left to ask.
            core = np.cumsum(~_same(a["core"])) - 1
            open_cores = np.bincount(core, weights=~repeated | (a["told"] == 1), minlength=core.max() + 1 if len(core) else 0) > 0
            keep = open_cores[core] & (a["told"] == 0) if len(core) else np.zeros(0, bool)
            a = a.copy()
            a["twice"] = repeated
            yield from _packed(_asks(a[keep]), "ask", n)

    return run


def _several(same: np.ndarray) -> np.ndarray:
    """Of sorted rows, those that equal the one before or the one after."""
    out = same.copy()
    if len(out):
        out[:-1] |= same[1:]
    return out


def _gather(kind: str, length: int):
    """Records of each document in one row: k1, k2, records. Spans are merged, and their field high becomes the end of their last byte."""

    def run(batches: Iterator[pa.RecordBatch]):
        for (a,) in _buckets(batches, kind):
            a = a[np.lexsort((a["low"], a["k2"], a["k1"]))]
            if kind == "span":
                a = merged(a, length)
            cut = np.flatnonzero(~_same(a["k1"], a["k2"]))
            ends = np.append(cut[1:], len(a))
            rows = [a[x:y].tobytes() for x, y in zip(cut.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a["k1"][cut]), pa.array(a["k2"][cut]), pa.array(rows, pa.binary())], names=["k1", "k2", "records"])

    return run


def merged(a: np.ndarray, length: int) -> np.ndarray:
    """Spans (first and last start of windows) sorted by document and start, as runs of bytes: low and, in high, the end. Those that overlap or touch are one."""
    same = _same(a["k1"], a["k2"])
    doc = np.cumsum(~same).astype(np.int64)
    reach = np.maximum.accumulate((doc << 33) + a["high"].astype(np.int64) + length)
    start = (doc << 33) + a["low"].astype(np.int64)
    new = np.ones(len(a), bool)
    new[1:] = start[1:] > reach[:-1]
    cut = np.flatnonzero(new)
    out = a[cut].copy()
    last = np.append(cut[1:], len(a)) - 1
    out["high"] = reach[last] & ((1 << 33) - 1)
    return out


def _cut_texts(n: int, length: int):
    """Step 2: short texts of the ranges of what was asked for."""
    cuts = ranges()

    def send(head: list[tuple], left: list[bytes], right: list[bytes]) -> Iterator[pa.RecordBatch]:
        t = np.empty(len(head), TEXT)
        for k, v in zip(("core", "k1", "k2", "low", "size", "n_left", "n_right", "twice"), zip(*head, strict=True), strict=True):
            t[k] = v
        t["left"] = np.frombuffer(b"".join(left), np.uint8).reshape(-1, 16)
        t["right"] = np.frombuffer(b"".join(right), np.uint8).reshape(-1, 16)
        t, repeated, number, heads = _text_classes(t)
        yield from _packed(_spans(t[repeated[number]]), "span", n)
        t["twice"] = repeated[number]
        yield from _packed(t[heads], "text", n)

    def run(batches: Iterator[pa.RecordBatch]):
        worker_state(("suffix_dedup",))
        digest = xxhash.xxh3_64_intdigest
        head, left, right, seen = [], [], [], set()
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            for k1, k2, data, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (k1, k2) in seen:  # rows of one text ask together; where several tasks have them, each window does repeat
                    continue
                seen.add((k1, k2))
                for _, _, low, more, at, twice in np.frombuffer(raw, ASK).tolist():
                    place, high = low + at, low + more
                    for j, (x, y) in enumerate(cuts):
                        first, last = max(low, place - y), min(high, place - x)
                        if first <= last:
                            a, z = place - x, place + length - y
                            head.append((digest(data[a:z], j), k1, k2, first, last - first + 1, a - first, last + length - z, twice))
                            left.append(data[first:a].ljust(16, b"\0"))
                            right.append(data[z : last + length].ljust(16, b"\0"))
                    if len(head) >= TEXTS:
                        yield from send(head, left, right)
                        head, left, right = [], [], []
        if head:
            yield from send(head, left, right)

    return run


def _text_classes(t: np.ndarray):
    """t sorted, and its classes of equal texts."""
    words = np.ascontiguousarray(t["left"]).view("<u8"), np.ascontiguousarray(t["right"]).view("<u8")
    order = np.lexsort((words[1][:, 1], words[1][:, 0], words[0][:, 1], words[0][:, 0], t["n_right"], t["n_left"], t["core"]))
    t = t[order]
    number, repeated, heads = _classes(_same(t["core"], t["n_left"], t["n_right"], t["left"], t["right"]), t["twice"])
    return t, repeated, number, heads


def suffix_order(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Starts of all suffixes in order, of texts that each end with a 0 of its own (an earlier 0 is smaller)."""
    n = len(symbols)
    zeros = symbols == 0
    rank = symbols.astype(np.int64) + int(zeros.sum())
    rank[zeros] = np.arange(int(zeros.sum()))
    width, order = 1, np.argsort(rank, kind="stable")
    while width < longest:
        second = np.zeros(n, np.int64)
        second[:-width or None] = rank[width:]
        key = rank * (int(rank.max()) + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.ones(n, np.int64)
        new[0] = 0
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1:
            break
        width *= 2
    return order


def merge_transforms(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes, ordered by their first depth symbols, and where a new prefix of depth symbols begins.

    Returns indices into the concatenated transforms, in merged order, and for each the number of its repeated interval.
    A round moves each shard number to the bucket of the symbol before its suffix; which of the shard's suffixes it is
    follows from counting, so that no suffix is compared or sorted again.
    """
    shard = np.repeat(np.arange(len(transforms)), [len(t) for t in transforms]).astype(np.uint8)
    symbols = np.concatenate(transforms)
    n = len(symbols)
    ends = symbols == 0
    end_shards = np.sort(shard[ends], kind="stable")
    where = np.arange(n)
    interval = np.zeros(n, np.int64)
    for _ in range(depth):
        c = symbols[where]
        order = np.argsort(c, kind="stable")
        c, before, z = c[order], interval[order], shard[where][order]
        z[: len(end_shards)] = end_shards  # texts end in the order of the shards, not of what precedes them
        new = np.ones(n, np.int64)
        new[0] = 0
        new[1:] = (c[1:] != c[:-1]) | (before[1:] != before[:-1]) | (c[1:] == 0)
        interval = np.cumsum(new)
        where = np.empty(n, np.int64)
        where[np.argsort(z, kind="stable")] = np.arange(n)
    return where, interval


def repeated_windows(t: np.ndarray, q: int) -> np.ndarray:
    """For texts of ranges of at most q windows: (text, window) pairs of those that a window of another text equals, or of one that stands for several."""
    core = np.unique(t["core"], return_inverse=True)[1].astype(np.uint16) + 257
    shards, transforms, texts, offsets = max(1, min(SHARDS, len(t) // 64)), [], [], []
    for k in range(shards):
        own = np.arange(k, len(t), shards)
        nl, nr = t["n_left"][own].astype(np.int64), t["n_right"][own].astype(np.int64)
        sizes = nl + nr + 2
        begins = np.cumsum(sizes) - sizes
        symbols = np.zeros(int(sizes.sum()), np.uint16)
        for j in range(16):
            has = nl > j
            symbols[begins[has] + j] = t["left"][own[has], j].astype(np.uint16) + 1
            has = nr > j
            symbols[begins[has] + nl[has] + 1 + j] = t["right"][own[has], j].astype(np.uint16) + 1
        symbols[begins + nl] = core[own]
        order = suffix_order(symbols, int(sizes.max()))
        text = np.repeat(np.arange(len(own)), sizes)
        preceding = np.roll(symbols, 1)
        preceding[begins] = 0
        transforms.append(preceding[order])
        texts.append(own[text[order]])
        offsets.append((order - begins[text[order]]).astype(np.int64))
    where, interval = merge_transforms(transforms, q)
    text, offset = np.concatenate(texts)[where], np.concatenate(offsets)[where]
    window = offset < t["size"][text]
    text, offset, interval = text[window], offset[window], interval[window]
    count = np.bincount(interval, minlength=int(interval.max()) + 1 if len(interval) else 0) + np.bincount(interval, weights=t["twice"][text], minlength=int(interval.max()) + 1 if len(interval) else 0).astype(np.int64)
    hit = count[interval] > 1
    return np.stack([text[hit], offset[hit]], axis=1)


def _merge_texts(n: int):
    """Step 3: all tasks' texts of a core together."""

    def run(batches: Iterator[pa.RecordBatch]):
        for t, found in _buckets(batches, "text", "span"):
            yield from _packed(found, "span", n)
            if not len(t):
                continue
            t, repeated, number, heads = _text_classes(t)
            yield from _packed(_spans(t[repeated[number]]), "span", n)
            t["twice"] = repeated[number]
            t = t[heads]
            t = t[_several(_same(t["core"]))]
            # A window of a range is as many symbols as the range can have windows: what lies on either side of the core, and the core.
            q = (t["n_left"].astype(np.int64) + t["n_right"] + 2 - t["size"]).astype(np.int64)
            for length in np.unique(q).tolist():
                mine = t[q == length]
                cut = np.flatnonzero(~_same(mine["core"]))
                at = 0
                while at < len(mine):
                    end = at + MERGE_TEXTS
                    if end < len(mine):
                        later = cut[np.searchsorted(cut, end) :]
                        end = int(later[0]) if len(later) else len(mine)
                    part = mine[at:end]
                    hits = repeated_windows(part, length)
                    own = part[hits[:, 0]]
                    yield from _packed(_joined(own, own["low"] + hits[:, 1].astype(np.uint32)), "span", n)
                    at = end

    return run


def _joined(own: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Spans of single windows, given by their documents and starts; windows that follow one another as one span."""
    a = np.empty(len(own), SPAN)
    if not len(a):
        return a
    a["k1"], a["k2"], a["low"], a["high"] = own["k1"], own["k2"], low, low
    a = a[np.lexsort((a["low"], a["k2"], a["k1"]))]
    new = ~_same(a["k1"], a["k2"])
    new[1:] |= a["low"][1:] > a["low"][:-1] + 1
    cut = np.flatnonzero(new)
    out = a[cut].copy()
    out["high"] = a["low"][np.append(cut[1:], len(a)) - 1]
    return out


def _count_cores(batches: Iterator[pa.RecordBatch]):
    """Texts of each core in each row."""
    for b in batches:
        for raw in b.column(2).to_pylist():
            core, count = np.unique(np.frombuffer(raw, TEXT)["core"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(count)], names=["core", "n"])


def _single_windows(n: int, crowded):
    """Texts of crowded cores as single windows, by bucket of the whole window; other texts as they are. A task counts what it meets itself."""

    def run(batches: Iterator[pa.RecordBatch]):
        worker_state(("suffix_dedup",))
        hot = np.array(crowded.value, np.int64).view(np.uint64)
        for b in batches:
            for raw in b.column(2).to_pylist():
                t = np.frombuffer(raw, TEXT)
                here = np.isin(t["core"], hot)
                yield from _packed(t[~here], "text", n)
                t = t[here]
                parts = []
                for w in range(16):
                    own = t[t["size"] > w]
                    if not len(own):
                        continue
                    left = [x[w:k].tobytes() for x, k in zip(own["left"], own["n_left"].tolist(), strict=True)]
                    right = [x[: k - (s - 1 - w)].tobytes() for x, k, s in zip(own["right"], own["n_right"].tolist(), own["size"].tolist(), strict=True)]
                    whole = [c.to_bytes(8, "little") + bytes([len(x)]) + x + y for c, x, y in zip(own["core"].tolist(), left, right, strict=True)]
                    out = np.empty(len(own), WINDOW)
                    out["hash"], out["more"] = [xxhash.xxh3_64_intdigest(x) for x in whole], [xxhash.xxh3_64_intdigest(x, 1) for x in whole]
                    out["k1"], out["k2"], out["low"], out["twice"] = own["k1"], own["k2"], own["low"] + np.uint32(w), own["twice"]
                    parts.append(out)
                if parts:
                    yield from _counted(np.concatenate(parts), n, True)

    return run


def _counted(w: np.ndarray, n: int, go_on: bool) -> Iterator[pa.RecordBatch]:
    """Spans of the windows met twice and, to go on, one of each window."""
    w = w[np.lexsort((w["more"], w["hash"]))]
    number, repeated, heads = _classes(_same(w["hash"], w["more"]), w["twice"])
    hit = w[repeated[number]]
    yield from _packed(_joined(hit, hit["low"]), "span", n)
    if go_on:
        w["twice"] = repeated[number]
        yield from _packed(w[heads], "window", n)


def _count_windows(n: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for w, found in _buckets(batches, "window", "span"):
            yield from _packed(found, "span", n)
            yield from _counted(w, n, False)

    return run


def _settle(cut: DataFrame, n: int) -> list[DataFrame]:
    """Step 3 over all texts: spans. Buckets that hold too much give up their crowded cores, which go on as single windows."""
    texts = cut.where(F.col("kind") == KINDS["text"])
    heavy = [r.bucket for r in texts.groupBy("bucket").agg(F.sum(F.length("records")).alias("size")).where(F.col("size") > HOT_BYTES).select("bucket").collect()]
    if not heavy:
        return [_dealt(cut, n).mapInArrow(_merge_texts(n), SCHEMA)]
    at = F.col("bucket").isin(heavy) & (F.col("kind") == KINDS["text"])
    counts = cut.where(at).mapInArrow(_count_cores, "core bigint, n bigint").groupBy("core").agg(F.sum("n").alias("n")).where(F.col("n") > HOT_TEXTS)
    crowded = cut.sparkSession.sparkContext.broadcast([r.core for r in counts.select("core").collect()])  # one for HOT_TEXTS texts at most
    apart = materialize(cut.where(at).mapInArrow(_single_windows(n, crowded), SCHEMA), "apart")
    others = cut.where(~at).union(apart.where(F.col("kind") != KINDS["window"]))
    windows = apart.where(F.col("kind") == KINDS["window"])
    return [_dealt(others, n).mapInArrow(_merge_texts(n), SCHEMA), _dealt(windows, n).mapInArrow(_count_windows(n), SCHEMA)]


def repeated_spans(docs: DataFrame, n: int, length: int = LENGTH) -> DataFrame:
    """k1, k2 and records (SPAN, merged runs of bytes) of the documents (k1, k2, text) that hold repeated strings of length bytes.

    docs may have a fourth column of such records: then only strings inside these runs are looked at.
    """
    found = materialize(_dealt(docs.mapInArrow(_find_anchors(n, length), SCHEMA), n).mapInArrow(_resolve_anchors(n), SCHEMA), "anchors")
    asks = materialize(_dealt(found.where(F.col("kind") == KINDS["ask"]), n).mapInArrow(_gather("ask", length), "k1 bigint, k2 bigint, records binary"), "asks")
    asked = beside(docs.select("k1", "k2", "text"), asks, "inner").select("k1", "k2", "text", "records")
    cut = materialize(asked.mapInArrow(_cut_texts(n, length), SCHEMA), "texts")
    spans = found.where(F.col("kind") == KINDS["span"])
    for more in _settle(cut, n):
        spans = spans.union(more)
    out = materialize(_dealt(spans.where(F.col("kind") == KINDS["span"]), n).mapInArrow(_gather("span", length), "k1 bigint, k2 bigint, records binary"), "spans")
    discard(found, asks, cut)
    return out


def beside(docs: DataFrame, records: DataFrame, how: str) -> DataFrame:
    """docs (with k1, k2) and records: by broadcast if the records are few, else by a shuffle of both."""
    size = records.agg(F.sum(F.length("records") + 64)).first()[0] or 0
    return docs.join(F.broadcast(records) if size <= BROADCAST_BYTES else records, ["k1", "k2"], how)


def keyed(text: str) -> list:
    """k1 and k2: 128 bits that stand for a text."""
    return [F.xxhash64(F.lit(i), text).alias(f"k{i}") for i in (1, 2)]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False, length: int = LENGTH, passage_words: int | None = None) -> DataFrame:
    """Removes every byte that a string of length bytes covers which starts anywhere else too, in whatever document.

    Texts are UTF-8 bytes; strings never cross documents; overlapping occurrences count; strings are judged on the input.
    Returns id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes), a row for
    each input row. With passage_words also n_passages: the runs of more than so many words (apart by white space) that
    strings of SHORT bytes cover which start anywhere else too, removed or not. With keep_columns all columns of df instead,
    text_col holding what remains (a character of which a byte was removed goes whole). A null text counts as empty (and
    stays null with keep_columns); an empty table gives an empty table. Every row is a document of its own, whatever its
    id: rows of equal texts repeat each other, also where they have one id or none. Other columns are not read.

    Where SHORT strings are looked for too, the longer ones are looked for in their runs alone: a long string that starts
    twice consists of short ones that do.
    """
    if length <= SPREAD + GRAM:
        raise ValueError("a repeated string is longer than the places of its anchor")
    bound_batches(df.sparkSession)
    docs = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(*keyed("text"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(shuffle_parts(df.sparkSession), -(-total // BUCKET_BYTES))
    if passage_words is None:
        spans = repeated_spans(docs, n, length).withColumn("runs", F.lit(None).cast("binary"))
    else:
        short = repeated_spans(docs, n, SHORT)
        inside = beside(docs, short, "inner").select("k1", "k2", "text", "records")
        spans = short.withColumnRenamed("records", "runs").join(repeated_spans(inside, n, length), ["k1", "k2"], "left")
        spans = materialize(spans.select("k1", "k2", "records", "runs"), "runs")
        discard(short)
    # Columns go by number, so that no name of df can clash.
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    id_at, text_at = df.columns.index(id_col), df.columns.index(text_col)
    given = [f"c{i}" for i in range(len(df.columns)) if keep_columns or i == id_at]
    extra = [] if keep_columns else ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_passages"] if passage_words is not None else [])]
    texts = named.select(*given, F.coalesce(F.col(f"c{text_at}"), F.lit("")).alias("text"))
    rows = _besides(texts.select(*given, "text", *keyed("text")), spans).select(*given, "text", "records", "runs")
    schema = named.select(*given).schema
    for name in extra:
        schema = schema.add(name, "string" if name == "kept_sha256" else "long")
    k = len(given)

    def run(batches: Iterator[pa.RecordBatch]):
        worker_state(("suffix_dedup",))
        for b in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            out = []
            for data, raw, short in zip(b.column(k).cast(pa.binary()).to_pylist(), b.column(k + 1).to_pylist(), b.column(k + 2).to_pylist(), strict=True):
                gone = _pieces(raw) if raw else []
                rest, at = [], 0
                for x, y in gone:
                    rest.append(data[at:x])
                    at = y
                rest.append(data[at:])
                if keep_columns:
                    out.append((b"".join(x.decode("utf-8", "ignore").encode() for x in rest).decode(),))
                else:
                    kept = b"".join(rest)
                    long = sum(len(data[x:y].split()) > passage_words for x, y in _pieces(short)) if short else 0
                    out.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), long)[: len(extra)])
            if keep_columns:
                there = b.column(text_at).is_valid().to_pylist()
                texts = pa.array([x if ok else None for ok, (x,) in zip(there, out, strict=True)], pa.string())
                columns = [texts if i == text_at else b.column(i) for i in range(k)]
            else:
                columns = [b.column(0), *(pa.array(c, pa.string() if name == "kept_sha256" else pa.int64()) for c, name in zip(zip(*out, strict=True) if out else [[]] * len(extra), extra, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*(df.columns if keep_columns else [id_col, *extra]))


def _besides(docs: DataFrame, spans: DataFrame) -> DataFrame:
    size = spans.agg(F.sum(F.coalesce(F.length("records"), F.lit(0)) + F.coalesce(F.length("runs"), F.lit(0)) + 64)).first()[0] or 0
    return docs.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, ["k1", "k2"], "left")
