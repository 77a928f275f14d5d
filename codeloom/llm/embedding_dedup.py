"""Near-duplicate vectors by cross-polytope hashing.

Three rounds of random signs and fast Hadamard transforms rotate a vector; the axis that it then lies nearest to, with
its sign, is one hash. A table joins some hashes, and a vector is put into the buckets of its PROBES nearest axes of
each hash. Vectors that share a bucket are compared exactly. A bucket larger than BLOCK is dealt into blocks, and each pair
of blocks is a group of its own, so that no task meets a hot bucket whole; groups give counts and spanning edges, not pairs.

What is shuffled is a vector as it came and its hashes, a byte or two each, once for each of its buckets: 6 where a
label has up to half a million vectors. Beyond, tables of more hashes keep buckets small, and more tables keep the recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize, worker_state
from codeloom.llm.components import components

THRESHOLD = 0.93
PROBES = 3
#: (vectors of one label, tables, hashes of a table): the first line that has room for the largest label is taken. Recall at
#: cosine 0.93 in 64 dimensions is above 0.999 in each.
SIZES = [(500_000, 2, 1), (50_000_000, 3, 2), (1 << 62, 5, 3)]
BLOCK = 1500
SEED = 7
#: Cosines so near to the threshold are computed anew, without rounding on the way to unit length.
NEAR = 1e-9


def hadamard(v: np.ndarray) -> np.ndarray:
    """The (unscaled) Walsh-Hadamard transform of each row; the width is a power of two."""
    v, h, width = v.copy(), 1, v.shape[1]
    while h < width:
        w = v.reshape(len(v), -1, 2, h)
        a, b = w[:, :, 0].copy(), w[:, :, 1].copy()
        w[:, :, 0], w[:, :, 1] = a + b, a - b
        h *= 2
    return v


def codes(unit: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """(rows, tables, hashes, PROBES) numbers of the nearest axes, twice the axis plus one if negative, nearest first."""
    n, dim = unit.shape
    width = max(4, 1 << (dim - 1).bit_length())  # so that there are PROBES axes
    wide = np.zeros((n, width))
    wide[:, :dim] = unit
    signs = np.random.default_rng(SEED).choice([-1.0, 1.0], size=(tables, hashes, 3, width))
    out = np.empty((n, tables, hashes, PROBES), np.int32)
    for t in range(tables):
        for k in range(hashes):
            v = wide
            for s in signs[t, k]:
                v = hadamard(v * s) / np.sqrt(width)
            top = np.argsort(-np.abs(v), axis=1, kind="stable")[:, :PROBES]
            out[:, t, k] = top * 2 + (np.take_along_axis(v, top, 1) < 0)
    return out


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled by powers of two before, so that no square overflows and nothing is rounded."""
    v = scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def scaled(v: np.ndarray) -> np.ndarray:
    return np.ldexp(v.astype(np.float64), -np.frexp(np.abs(v).max(axis=1, keepdims=True).astype(np.float64))[1])


def owned(x: np.ndarray, y: np.ndarray, table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether (table, bucket) is the first that rows of codes x and y share, so that each pair counts once."""
    same = x[:, :, :, :, None] == y[:, :, :, None, :]
    shared = same.any((3, 4)).all(2)
    first = shared.argmax(1)
    rows = np.arange(len(x))
    mine = np.where(same.any(4)[rows, first], x[rows, first], np.int32(2**31 - 1)).min(2)
    return (first == table) & (mine == bucket).all(1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component, for links a-b among n members."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _linked(v: np.ndarray, unit: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row of left and one of right whose cosine reaches threshold."""
    cosine = unit[left] @ unit[right].T
    x, y = np.nonzero(cosine >= threshold - NEAR)
    close = np.flatnonzero(cosine[x, y] <= threshold + NEAR)
    x, y, keep = left[x], right[y], np.ones(len(x), bool)
    if len(close):
        a, b = scaled(v[x[close]]), scaled(v[y[close]])
        keep[close] = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1)) >= threshold
    return x[keep], y[keep]


def _group(weights, v, code, table, bucket, left, right, threshold):
    """Sums of the weights that each row of a group links with, and spanning edges. left, right: rows to compare; equal for a whole bucket."""
    unit, whole = units(v), left is right
    a, b = [], []
    for i in range(0, len(left), 512):
        x, y = _linked(v, unit, left[i : i + 512], right, threshold)
        keep = x < y if whole else slice(None)
        a.append(x[keep])
        b.append(y[keep])
    a, b = np.concatenate(a), np.concatenate(b)
    if not len(a):
        return None
    links = np.zeros(len(v), np.int64)
    for i in range(0, len(a), 100_000):
        p, q = a[i : i + 100_000], b[i : i + 100_000]
        mine = owned(code[p], code[q], table, bucket)
        np.add.at(links, p[mine], weights[q[mine]])
        np.add.at(links, q[mine], weights[p[mine]])
    return links, _roots(len(v), a, b)


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links vectors of equal label whose cosine (double precision) reaches threshold.

    Returns id_col, n_links (other rows linked directly), component_id (the smallest id reachable by links, itself
    included) and kept (id_col = component_id), a row for each input row. Vectors that are null, empty, all zero or hold a
    null or a number that is not finite link with nothing, nor do those without label; vectors of different lengths do not
    link. Every row is a vector of its own, also where rows repeat an id or have none; a null id is no smallest id (a row
    that reaches null ids alone has component_id null and is kept). Equal vectors of a label are compared once, as a class,
    and count in each other's links. Other columns are not read; an empty table gives an empty table. Buckets miss a pair of
    cosine 0.93 in 64 dimensions about once in 2,000 (less often above); none below the threshold is ever linked.
    """
    kind = df.schema[vector_col].dataType.elementType.simpleString()
    number = np.dtype(np.float32 if kind == "float" else np.float64)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>" if kind == "float" else "array<double>").alias("v"))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = rows.select("id", "label", "v", "usable", *[F.when(F.col("usable"), F.xxhash64(F.lit(i), "label", "v")).alias(f"k{i}") for i in (1, 2)])
    grouped = rows.where("usable").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers of written rows: they stay
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    tables, hashes = next((t, h) for room, t, h in SIZES if most <= room)

    def hashed(batches: Iterator[pa.RecordBatch]):
        worker_state(("embedding_dedup",))
        for b in batches:
            sizes = np.diff(b.column(3).offsets.to_numpy())
            flat = b.column(3).flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                v = flat[starts[at][:, None] + np.arange(size)].astype(number)
                code = codes(units(v), tables, hashes)
                small = code.astype("u1" if code.max() < 256 else "<u2" if code.max() < 1 << 16 else "<u4")
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in (0, 1, 2)), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in small], pa.binary()), pa.array(_buckets(code).tolist(), pa.list_(pa.int64()))], names=["node", "label", "weight", "v", "code", "buckets"])

    every = materialize(classes.select("node", "label", "weight", "v").mapInArrow(hashed, "node bigint, label string, weight bigint, v binary, code binary, buckets array<bigint>"), "hashed")
    # A place is a bucket of a label and length; its number mixes them into 64 bits, and rows that it brings together by chance are told apart by their group's label, length and codes.
    keys = every.select("node", "label", "weight", "v", "code", F.explode("buckets").alias("bucket")).withColumn("place", F.xxhash64("label", F.length("v"), "bucket"))
    if most > BLOCK:
        hot = materialize(keys.groupBy("place").count().where(F.col("count") > BLOCK).select("place", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot")
        if hot.limit(1).count():
            dealt = keys.join(hot, "place", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            keys = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            keys = keys.withColumn("group", F.when(F.col("blocks") == 1, F.col("place")).otherwise(F.xxhash64("place", F.least("own", "other"), F.greatest("own", "other"))))
            keys = keys.withColumn("side", F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")))
    if "group" not in keys.columns:
        keys = keys.withColumns({"group": F.col("place"), "side": F.lit(-1)})

    def linked(batches: Iterator[pa.RecordBatch]):
        worker_state(("embedding_dedup",))
        for t in _groups(batches):
            node, weights, side = (t.column(c).to_numpy() for c in ("node", "weight", "side"))
            raw, n = t.column("code").to_pylist(), t.num_rows
            v = np.frombuffer(b"".join(t.column("v").to_pylist()), number).reshape(n, -1)
            size = len(raw[0]) // (tables * hashes * PROBES)
            code = np.frombuffer(b"".join(raw), f"<u{size}").astype(np.int32).reshape(n, tables, hashes, PROBES)
            everyone, bucket = np.arange(n), t.column("bucket")[0].as_py()
            table, own = bucket_of(bucket, hashes)
            left, right = (everyone, everyone) if side[0] < 0 else (everyone[side == side.min()], everyone[side != side.min()])
            found = _group(weights, v, code, table, own, left, right, threshold) if len(left) and len(right) else None
            if found:
                links, root = found
                out = np.flatnonzero((links > 0) | (root != everyone))
                yield pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(links[out]), pa.array(node[root[out]])], names=["node", "links", "root"])

    grouped = keys.select("group", "label", "bucket", "side", "node", "weight", "v", "code").repartition("group").sortWithinPartitions("group", "label", "bucket", F.length("v"), "node")
    found = materialize(grouped.mapInArrow(linked, "node bigint, links bigint, root bigint"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_class = classes.select("k1", "k2", "id", "weight", "node").join(links, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = per_class.groupBy("component").agg(F.min("id").alias("component_id"))
    per_class = materialize(per_class.join(least, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "found")
    out = rows.select("id", "k1", "k2").join(per_class, ["k1", "k2"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _buckets(code: np.ndarray) -> np.ndarray:
    """(rows, buckets) numbers of the buckets of codes: the table, then a code of each hash, 20 bits each."""
    n, tables, hashes, probes = code.shape
    at = np.arange(tables, dtype=np.int64)[None, :, None]
    for k in range(hashes):
        at = (at[:, :, :, None] << 20 | code[:, :, k].astype(np.int64)[:, :, None, :]).reshape(n, tables, -1)
    return at.reshape(n, -1)


def bucket_of(number: int, hashes: int) -> tuple[int, np.ndarray]:
    """The table and the codes of a bucket's number."""
    return number >> 20 * hashes, np.array([number >> 20 * (hashes - 1 - k) & 0xFFFFF for k in range(hashes)])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Groups of at least two rows, from batches sorted by group, label, bucket and length of vector."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        label = t.column("label").combine_chunks().dictionary_encode()
        columns = [t.column("group").to_numpy(), t.column("bucket").to_numpy(), np.asarray((label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices), pc.binary_length(t.column("v")).to_numpy()]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        starts = [0, *cut.tolist()]
        for x, y in zip(starts, cut.tolist(), strict=False):
            if y - x > 1:
                yield t.slice(x, y - x)
        rest = t.slice(starts[-1])
    if rest is not None and rest.num_rows > 1:
        yield rest
