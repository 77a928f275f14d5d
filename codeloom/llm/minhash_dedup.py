"""Near-duplicate documents by improved consistent weighted sampling.

A document is the set of its shingles (five words), each weighing its count times its inverse document frequency. Document
frequencies are those of the 64-bit shingles over all documents: documents go in chunks, each chunk sends its shingles, cut into
ranges, to the tasks that count a range, and gets back their frequencies in the same order. A sample of the sets is consistent: two documents
draw the same one with the probability of their weighted Jaccard similarity. ROWS samples make a band; documents that share
a band are candidates, and candidates are verified by the exact weighted Jaccard similarity of their whole texts.

Where a group has very many copies, its shingles have high document frequencies for no other reason, and weigh the less against
a changed word the larger the group and the table are. So what two documents share, if it occurs in more than LARGE documents on
the average, is also held against the threshold by counts alone. Documents of such shingles have BANDS bands more, of samples by
counts; of a pair of which one has none, the bands by weight find nearly as many as the others.

Equal texts are one class from the start, known by a number. What is shuffled to find candidates are these numbers alone. In
each bucket every class is compared with the bucket's first one, in blocks, once whatever the number of buckets that the two
share; only classes that this does not link are compared with the others of their buckets. So a bucket of n near copies costs
n comparisons and n texts, not their square. Texts go to where they are compared after that is settled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import ChunkCache, bound_batches, discard, materialize, slices, worker_state
from codeloom.llm.components import components
from codeloom.llm.decontaminate import words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
#: Documents of a group beyond which its copies are compared by counts as well. Part of the highest inverse document frequency
#: below which a document, on the average of its shingles, has bands by counts: at 0.9 or more, a pair that reaches the threshold
#: by counts has 0.77 by weight.
LARGE, COMMON = 8, 0.9
#: Every 64-bit shingle is a feature of its own.
FEATURES = 1 << 64
#: Documents of a chunk, about, and the least number of ranges that chunks send their shingles to (a power of two).
CHUNK, RANGES = 1 << 10, 1 << 10
#: Ids whose texts are looked up go by broadcast up to so many, by a shuffle beyond.
BROADCAST_IDS = 500_000
#: Classes of one bucket that are compared in one group.
BLOCK = 400
#: Shingles sampled together: small enough for a core's cache.
TOGETHER = 1 << 15

_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """texts -> distinct shingles of each: (document numbers, 64-bit shingles, counts), by document."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.cache = ChunkCache(lambda new: [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in new], entries=100_000)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        docs = [words(t) for t in texts]
        hashes = self.cache.values(docs)
        sizes = np.array([len(d) for d in docs], np.int64)
        flat = np.fromiter(chain.from_iterable(hashes), np.uint64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        h = flat + np.uint64(1)
        for j in range(1, self.size):
            h[: max(len(h) - j, 0)] *= _P
            h[: max(len(h) - j, 0)] += flat[j:]
        last = np.zeros(len(flat) + 1, bool)  # places too near to a document's end for a whole shingle
        some = sizes > 0
        for j in range(1, self.size):
            last[np.maximum(ends - j, ends - sizes)[some]] = True
        short = np.flatnonzero((sizes > 0) & (sizes < self.size))  # a document of fewer words is one shingle
        for i in short.tolist():
            at = int(ends[i] - sizes[i])
            last[at] = False
            h[at] = xxhash.xxh3_64_intdigest(flat[at : int(ends[i])].tobytes(), 1)
        h = mix(h)
        order = np.argsort(h)
        order = order[~last[:-1][order]]
        doc = np.repeat(np.arange(len(docs), dtype=np.uint16 if len(docs) < 1 << 16 else np.int64), sizes)
        order = order[np.argsort(doc[order], kind="stable")]
        h, d = h[order], doc[order].astype(np.int64)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        return d[at], h[at], np.diff(np.append(at, len(h)))


def worker_shingler() -> Shingler:
    """The one of this worker process."""
    return worker_state(("minhash_dedup",), Shingler)


def _uniform(bits: np.ndarray, shift: int) -> np.ndarray:
    """24 of the bits as a number between 0 and 1, both excluded."""
    x = (bits >> np.uint64(shift)).astype(np.uint32)
    x &= np.uint32(0xFFFFFF)
    out = x.view(np.int32).astype(np.float32)  # 32-bit numbers become floats several at a time
    out *= np.float32(2**-24)
    out += np.float32(2**-25)
    return out


def samples(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """(documents, n) consistent weighted samples; document i has the shingles from starts[i] up to the next start."""
    log_w = np.log(weights).astype(np.float32)
    out = np.zeros((len(starts), n), np.uint32)
    if not (np.append(starts[1:], len(shingles)) > starts).all():
        return out
    packed, steps, number = np.empty(len(shingles), np.uint64), np.empty(len(shingles), np.float32), np.arange(len(shingles), dtype=np.uint64)
    for k in range(n):
        salt = mix(np.array([k + 1], np.uint64) * _P)[0]
        for i in range(0, len(shingles), TOGETHER):
            here = slice(i, i + TOGETHER)
            one = mix(shingles[here] ^ salt)
            two = mix(one + _P)
            r, c = _uniform(one, 0), _uniform(two, 0)
            r *= _uniform(one, 24)
            np.log(r, out=r)  # below 0
            c *= _uniform(two, 24)
            np.log(c, out=c)
            np.negative(c, out=c)
            np.log(c, out=c)
            one >>= np.uint64(48)
            beta = one.astype(np.float32)
            beta += np.float32(0.5)
            beta *= np.float32(2**-16)
            t = np.divide(log_w[here], r)
            np.subtract(beta, t, out=t)
            np.floor(t, out=t)
            steps[here] = t
            t -= beta
            t += np.float32(1)
            t *= r
            t += c
            bits = t.view(np.int32)
            rank = (bits ^ ((bits >> 31) | np.int32(-(2**31)))).view(np.uint32)  # ordered as t is
            packed[here] = rank.astype(np.uint64) << np.uint64(32) | number[here]
        least = (np.minimum.reduceat(packed, starts) & np.uint64(0xFFFFFFFF)).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        out[:, k] = mix(shingles[least] + steps[least].astype(np.int64).view(np.uint64) * _M1).astype(np.uint32)
    return out


def samples_by_count(shingles: np.ndarray, counts: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """samples() where each occurrence of a shingle weighs the same: two documents draw the same with the probability of their Jaccard similarity by counts."""
    first = np.cumsum(counts) - counts
    at = np.repeat(np.arange(len(shingles)), counts)
    nth = (np.arange(len(at)) - first[at]).astype(np.uint64)
    own = mix(shingles[at] + nth * _M2)
    salts = mix(np.arange(1, n + 1).astype(np.uint64) * _P)
    return np.stack([np.minimum.reduceat(mix(own ^ salt), first[starts]) for salt in salts], 1).astype(np.uint32)


def _keys(drawn: np.ndarray, first: int) -> np.ndarray:
    """The keys of the bands, numbered from first, that samples make."""
    drawn = drawn.astype(np.uint64).reshape(len(drawn), -1, ROWS)
    key = np.tile(np.arange(first, first + drawn.shape[1], dtype=np.uint64), (len(drawn), 1))
    for r in range(ROWS):
        key = mix(key * _P + drawn[:, :, r])
    return key.view(np.int64)


def idf(df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequency of shingles that df of n documents have."""
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def _blobs(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values that hold the numbers of x from each cut to the next."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _numbers(blobs: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all binary values in a row, and how many each holds."""
    if not len(blobs):
        return np.empty(0, dtype), np.zeros(0, np.int64)
    cuts = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(blobs.buffers()[2], np.uint8)[cuts[0] : cuts[-1]].copy().view(dtype), np.diff(cuts) // size


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of equal values."""
    cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
    yield from zip([0, *cuts], [*cuts, len(x)], strict=True) if len(x) else ()


def keyed(docs: DataFrame) -> DataFrame:
    """docs (id, text) with k1 and k2, which stand for the text."""
    return docs.select("id", *[F.xxhash64(F.lit(i), "text").alias(f"k{i}") for i in (1, 2)], "text")


def in_chunks(docs: DataFrame, n_docs: int) -> DataFrame:
    """The rows of keyed() with text and their chunk, the rows of a chunk in one partition."""
    chunk = F.pmod(F.xxhash64("id", "k1"), F.lit(max(-(-n_docs // CHUNK), 1)))
    return docs.where("text is not null").select(chunk.cast("bigint").alias("chunk"), "id", "k1", "k2", "text").repartition("chunk")


def frequencies(rows: DataFrame, n_docs: int) -> DataFrame:
    """chunk, range, low and high: how many documents have each shingle of each chunk of in_chunks(), by the range's sorted shingles.

    low holds a byte for each shingle; for 255 or more it is 255, and high has the number.
    """
    bits = (max(RANGES, n_docs // (16 * CHUNK)) - 1).bit_length()
    # The high bits of sorted shingles compress, if they lie apart from the low ones.
    parts = {"a": (np.uint64(48), np.uint16), "b": (np.uint64(16), np.uint32), "c": (np.uint64(0), np.uint16)}

    def of_chunk(chunk: int, found: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(found), return_counts=True)
        ranges = (h >> np.uint64(64 - bits)).astype(np.int32)
        starts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])) if len(h) else np.zeros(0, np.int64)
        cuts = np.append(starts, len(h))
        blobs = [_blobs((h >> shift).astype(kind), cuts) for shift, kind in parts.values()]
        return pa.RecordBatch.from_arrays([pa.array(ranges[starts]), pa.array(np.full(len(starts), chunk, np.int64)), *blobs, _blobs(n.astype(np.uint32), cuts)], names=["range", "chunk", *parts, "n"])

    def send(batches: Iterator[pa.RecordBatch]):
        shingler, now, found = worker_shingler(), None, []
        for b in batches:
            chunks = b.column(0).to_numpy()
            for x, y in _runs(chunks):
                if found and chunks[x] != now:
                    yield of_chunk(now, found)
                    found = []
                now = chunks[x]
                found.extend(shingler(part)[1] for _, part in slices(b.column(4).slice(x, y - x).to_pylist()))
        if found:
            yield of_chunk(now, found)

    def count(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        h = np.zeros(len(_numbers(whole.column(4), np.uint16)[0]), np.uint64)
        for c, (shift, kind) in zip((2, 3, 4), parts.values(), strict=True):
            h |= _numbers(whole.column(c), kind)[0].astype(np.uint64) << shift
        n, sizes = _numbers(whole.column(5), np.uint32)
        own, at = np.unique(h, return_inverse=True)
        df = np.bincount(at, weights=n, minlength=len(own)).astype(np.uint32)[at]
        cuts, many = np.append(0, np.cumsum(sizes)), df >= 255
        return pa.RecordBatch.from_arrays([whole.column(1), whole.column(0), _blobs(np.minimum(df, 255).astype(np.uint8), cuts), _blobs(df[many], np.append(0, np.cumsum(many))[cuts])], names=["chunk", "range", "low", "high"])

    def answer(batches: Iterator[pa.RecordBatch]):
        now, rows = None, []
        for b in batches:
            ranges = b.column(0).to_numpy()
            for x, y in _runs(ranges):
                if rows and ranges[x] != now:
                    yield count(rows)
                    rows = []
                now = ranges[x]
                rows.append(b.slice(x, y - x))
        if rows:
            yield count(rows)

    sent = rows.sortWithinPartitions("chunk").mapInArrow(send, "range int, chunk bigint, a binary, b binary, c binary, n binary")
    return sent.repartition("range").sortWithinPartitions("range").mapInArrow(answer, "chunk bigint, range int, low binary, high binary")


def _of_chunk(texts: list[str], shingler: Shingler, counts: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """For each slice of a chunk's texts its start and shingles; all shingles; the document frequencies of all."""
    found = [(start, shingler(part)) for start, part in slices(texts)]
    h = np.concatenate([x[1] for _, x in found])
    own, at = np.unique(h, return_inverse=True)
    t = counts.sort_by("range").combine_chunks()
    low, high = (np.concatenate([np.empty(0, kind), *(_numbers(c, kind)[0] for c in t.column(name).chunks)]) for name, kind in (("low", np.uint8), ("high", np.uint32)))
    if len(low) != len(own):
        raise ValueError("a chunk's frequencies are not those of its shingles")
    df = low.astype(np.uint32)
    df[low == 255] = high
    return found, h, df[at]


class idf_table:  # noqa: N801
    """Inverse document frequencies of the shingles of all rows of docs (text) on the driver, by shingle; for small tables."""

    def __init__(self, docs: DataFrame):
        self.n = docs.count()
        rows = in_chunks(keyed(docs.select(F.monotonically_increasing_id().alias("id"), "text")), self.n)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            _, h, df = _of_chunk(left.column("text").to_pylist(), worker_shingler(), right)
            own, at = np.unique(h, return_index=True)
            return pa.table({"h": pa.array([own.tobytes()], pa.binary()), "df": pa.array([df[at].tobytes()], pa.binary())})

        found = rows.groupBy("chunk").cogroup(frequencies(rows, self.n).groupBy("chunk")).applyInArrow(run, "h binary, df binary").collect()
        self.known, first = np.unique(np.frombuffer(b"".join(r.h for r in found), np.uint64), return_index=True)
        self.df = np.frombuffer(b"".join(r.df for r in found), np.uint32)[first]

    def __getitem__(self, shingles: np.ndarray) -> np.ndarray:
        return idf(self.df[np.searchsorted(self.known, shingles.astype(np.uint64))], self.n)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sets as (sorted shingles, weights): sum of minima by sum of maxima; 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum())
    high = float(a[1].sum()) + float(b[1].sum()) - low
    return low / high if high else 0.0


def _sets(t: pa.Table, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Shingles (numbered from 0), weights and counts of the rows of t (text, df), where each row's begin and the last ends, and the inverse document frequency of LARGE."""
    d, h, m = worker_shingler()(t.column("text").to_pylist())
    w = m * idf(np.frombuffer(b"".join(map(zlib.decompress, t.column("df").to_pylist())), np.uint32), n_docs).astype(np.float64)
    if len(np.unique(d)) < t.num_rows:
        raise ValueError("a document with bands has no shingles")
    return np.unique(h, return_inverse=True)[1], w, m.astype(np.float64), np.searchsorted(d, np.arange(t.num_rows + 1)), float(idf(np.array(LARGE), n_docs))


def _similar(sets: tuple, own: np.ndarray, i: int, before: int, threshold: float) -> np.ndarray:
    """Whether the first `before` rows reach the threshold with row i, by weight or, where what they share is in over LARGE documents, by counts. own: room for all shingles, all 0."""
    shingle, w, m, starts, large = sets
    a, b, end = starts[i], starts[i + 1], starts[before]

    def shared(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own[shingle[a:b]] = x[a:b]
        common = np.add.reduceat(np.minimum(x[:end], own[shingle[:end]]), starts[:before])
        own[shingle[a:b]] = 0
        return common, common >= threshold * (np.add.reduceat(x[:end], starts[:before]) + x[a:b].sum() - common)

    weight, hit = shared(w)
    if not hit.all() and (w[a:b] < large * m[a:b]).any():
        count, by_count = shared(m)
        hit |= by_count & (weight < large * count)
    return hit


def _links(sets: tuple, bands: np.ndarray, asks: np.ndarray, answers: np.ndarray, root: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that join rows 0, 1, ... of a bucket into components, of pairs of a row that asks and one that answers.

    root: a smallest member of what is known to be linked. bands: those before the bucket's; a pair that shares one is that one's to compare.
    """
    own, out = np.zeros(int(sets[0].max()) + 1), []
    for i in range(1, len(bands)):
        others = (root[:i] != root[i]) & ~(bands[:i] == bands[i]).any(1) & (asks[i] & answers[:i] | answers[i] & asks[:i])
        if others.any():
            for j in np.flatnonzero(others & _similar(sets, own, i, i, threshold)).tolist():
                if root[j] != root[i]:
                    out.append((j, i))
                    root[root == max(root[i], root[j])] = min(root[i], root[j])
    return out


def _few(ids: DataFrame) -> DataFrame:
    """A table of ids that is broadcast if it has few rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text, df and bands of the classes named by nodes (node), one row for each."""
    wanted = materialize(classes.join(nodes, "node").select("k1", "k2", "node", "df", "bands"), "wanted")
    text = docs.join(_few(wanted.select("k1", "k2", "node")), ["k1", "k2"]).groupBy("node").agg(F.max("text").alias("text"))
    return materialize(text.join(wanted.select("node", "df", "bands"), "node"), "texts")


def _whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Groups of rows of equal keys (numbers), from sorted batches."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        g = np.stack([t.column(c).to_numpy() for c in keys])
        cut = np.flatnonzero((g[:, 1:] != g[:, :-1]).any(0)) + 1
        for x, y in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True) if len(cut) else ():
            yield t.slice(x, y - x)
        rest = t.slice(int(cut[-1])) if len(cut) else t
    if rest is not None:
        yield rest


def _star_links(stars: DataFrame, texts: DataFrame, n_docs: int, threshold: float) -> DataFrame:
    """Of the pairs (first, node) those that reach the threshold; a first with many partners meets them in blocks."""
    blocks = stars.groupBy("first").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    partners = stars.join(blocks, "first").select("first", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node")
    firsts = blocks.select("first", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("first").alias("node"))
    met = partners.union(firsts).join(texts.select("node", "text", "df"), "node")

    def run(batches: Iterator[pa.RecordBatch]):
        for t in _whole_groups(batches, "first", "block"):
            node, first = t.column("node").to_numpy(), t.column("first")[0].as_py()
            sets = _sets(t, n_docs)
            own = np.zeros(int(sets[0].max()) + 1)
            hit = node[_similar(sets, own, int(np.flatnonzero(node == first)[0]), len(node), threshold)]
            hit = hit[hit != first]
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), first)), pa.array(hit)], names=["first", "node"])

    return met.select("first", "block", "node", "text", "df").repartition("first", "block").sortWithinPartitions("first", "block").mapInArrow(run, "first bigint, node bigint")


def _other_links(met: DataFrame, linked: DataFrame, texts: DataFrame, n_docs: int, threshold: float) -> DataFrame:
    """Links of what is not linked with its bucket's first, to the others of the bucket."""
    rows = met.where("node <> first").join(linked.withColumn("linked", F.lit(True)), ["first", "node"], "left").withColumn("open", F.col("linked").isNull())
    some = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum(F.col("open").cast("long")).alias("n_open")).where("n > 1 and n_open > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    some = some.select("band", "key", blocks("n_open").alias("asking"), blocks("n").alias("answering"))
    dealt = rows.select("band", "key", "node", "open").join(some, ["band", "key"])
    dealt = dealt.withColumns({"x": F.when(F.col("open"), F.pmod(F.xxhash64("node"), F.col("asking")).cast("int")), "y": F.pmod(F.xxhash64("node"), F.col("answering")).cast("int")})
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    answers = F.transform(upto("asking"), lambda i: F.struct(i.alias("i"), F.col("y").alias("j")))
    asks = F.transform(upto("answering"), lambda j: F.struct(F.col("x").alias("i"), j.alias("j")))
    dealt = dealt.withColumn("at", F.explode(F.when(F.col("open"), F.array_union(asks, answers)).otherwise(answers)))
    dealt = dealt.select("band", "key", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "node", "open", F.coalesce(F.col("x") == F.col("at.i"), F.lit(False)).alias("asks"), (F.col("y") == F.col("at.j")).alias("answers"))

    def run(batches: Iterator[pa.RecordBatch]):
        for t in _whole_groups(batches, "band", "key", "i", "j"):
            if t.num_rows < 2:
                continue
            node, asks, answers, known = (t.column(c).to_numpy() for c in ("node", "asks", "answers", "open"))
            root = np.where(known, np.arange(len(node)), np.argmin(known))  # what is linked with the first is linked
            band = t.column("band")[0].as_py()  # whoever has it has all before it
            bands = np.array([x[:band] for x in t.column("bands").to_pylist()], np.int64)
            found = _links(_sets(t, n_docs), bands, asks, answers, root, threshold)
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    groups = dealt.join(texts, "node").select("band", "key", "i", "j", "node", "open", "asks", "answers", "bands", "text", "df")
    return groups.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j", "node").mapInArrow(run, "a bigint, b bigint")


def signatures(docs: DataFrame, n_docs: int) -> DataFrame:
    """id, k1, k2, bands (null without words; those by counts at the end, where it has any) and df, the packed document frequencies of the shingles, of every row of keyed docs with text."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found, _, df = _of_chunk(left.column("text").to_pylist(), worker_shingler(), right)
        bands: list = [None] * left.num_rows
        packed: list = [None] * left.num_rows
        for start, (d, h, m) in found:
            n, df = df[: len(h)], df[len(h) :]
            own, starts = np.unique(d, return_index=True)
            if not len(own):
                continue
            w = m * idf(n, n_docs)
            keys = _keys(samples(h, w, starts, BANDS * ROWS), 1).tolist()
            common = np.add.reduceat(w, starts) < COMMON * idf(np.array(1), n_docs) * np.add.reduceat(m, starts)
            if common.any():
                some = np.repeat(common, np.diff(np.append(starts, len(h))))
                at = np.cumsum(some)[starts[common]] - 1
                for i, k in zip(np.flatnonzero(common).tolist(), _keys(samples_by_count(h[some], m[some], at, BANDS * ROWS), BANDS + 1).tolist(), strict=True):
                    keys[i] += k
            for i, k, x, y in zip((own + start).tolist(), keys, starts.tolist(), [*starts[1:].tolist(), len(h)], strict=True):
                bands[i], packed[i] = k, zlib.compress(n[x:y].tobytes(), 1)
        return pa.table([*(left.column(c) for c in ("id", "k1", "k2")), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary())], names=["id", "k1", "k2", "bands", "df"])

    rows = in_chunks(docs, n_docs)
    counts = frequencies(rows, n_docs)
    return rows.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(run, "id bigint, k1 bigint, k2 bigint, bands array<bigint>, df binary")


def _named(df: DataFrame, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """id, k1, k2 of every row with text; and of every text (k1, k2) its group's number, smallest id, and whether this text stands for the group."""
    bound_batches(df.sparkSession)
    docs = keyed(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    n_docs = docs.count()
    rows = materialize(signatures(docs, n_docs), "signatures")
    classes = rows.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("df").alias("df"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers of written rows: they stay
    members = classes.where("bands is not null").select("node", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1").drop("n")
    met = materialize(members.join(shared, ["band", "key"]), "buckets")
    texts = _texts(docs, classes, met.select("node").distinct())
    linked = materialize(_star_links(met.where("node <> first").select("first", "node").distinct(), texts, n_docs, threshold), "stars")
    others = materialize(_other_links(met, linked, texts, n_docs, threshold), "links")
    parts = components(linked.select(F.col("first").alias("a"), F.col("node").alias("b")).union(others))
    of = classes.select("k1", "k2", "id", "node").join(parts, "node", "left").withColumn("group", F.coalesce("component", "node"))
    # The text that stands for a group: of its smallest id, and of those by its number.
    best = of.groupBy("group").agg(F.min("id").alias("class_id"), F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("best"))
    named = materialize(of.join(best, "group").select("k1", "k2", "class_id", (F.col("best.node") == F.col("node")).alias("stands")), "named")
    known = materialize(rows.select("id", "k1", "k2"), "rows")
    discard(rows, classes, met, texts, linked, others)
    return known, named


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups documents that are linked by equal texts or by a weighted Jaccard similarity of threshold or more; where what two share occurs in over LARGE documents on the average, also by one of counts.

    Returns id_col, class_id (the smallest id of the group) and kept (id_col = class_id), a row for each input row. A null
    text links with nothing; texts without words link only with equal ones; texts of fewer than five words are one shingle.
    Ids are integers or null. Every row is a document of its own, also where rows repeat an id or have none; a null id is
    no smallest id. Other columns are not read; an empty table gives an empty table. A pair at the threshold is missed by all
    bands once in 1,300, one of similarity 0.9 once in 470,000 (one that only counts link once in 500, if just one of the two
    has bands by counts); no pair below the threshold is linked.
    """
    known, named = _named(df, threshold, id_col, text_col)
    out = known.join(named.select("k1", "k2", "class_id"), ["k1", "k2"]).select("id", "class_id")
    null = df.where(F.col(text_col).isNull()).select(F.col(id_col).cast("long").alias("id"), F.col(id_col).cast("long").alias("class_id"))
    out = out.union(null)
    return out.select(F.col("id").alias(id_col), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def one_of_each(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of near_duplicates(), that of the smallest id, and with all rows without text.

    Of rows that repeat the id and text that stay, one stays. Columns come back as they are, whatever their names.
    """
    known, named = _named(df, threshold, id_col, text_col)
    keys = known.groupBy("id", "k1", "k2").agg(F.count("*").alias("n")).join(named, ["k1", "k2"])
    keys = materialize(keys.select("id", "k1", "k2", "n", (F.col("stands") & F.col("id").eqNullSafe(F.col("class_id"))).alias("stays")), "keys")
    names = [f"c{i}" for i in range(len(df.columns))]  # so that no column of df clashes
    text = F.col(f"c{df.columns.index(text_col)}")
    rows = df.toDF(*names).withColumn("id", F.col(f"c{df.columns.index(id_col)}").cast("long"))
    rows = rows.withColumns({f"k{i}": F.when(text.isNotNull(), F.xxhash64(F.lit(i), text)) for i in (1, 2)})

    def having(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = _few(keys.select(F.col("id").alias("i"), F.col("k1").alias("x"), F.col("k2").alias("y")))
        return rows.join(keys, F.col("id").eqNullSafe(F.col("i")) & (F.col("k1") == F.col("x")) & (F.col("k2") == F.col("y")), how)

    out = having(rows, keys.where("not stays"), "left_anti")
    repeated = keys.where("stays and n > 1")
    if repeated.limit(1).count():
        one = having(out, repeated, "left_semi").groupBy("id", "k1", "k2").agg(F.max(F.struct(*names)).alias("row")).select("row.*")
        out = having(out, repeated, "left_anti").select(*names).union(one)
    return out.select(*names).toDF(*df.columns)


def without_ids(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """df without the rows of ids: by broadcast if they are few, else by a shuffle."""
    ids = materialize(ids.where(F.col(id_col).isNotNull()).distinct(), "ids")
    return df.join(_few(ids), id_col, "left_anti")
