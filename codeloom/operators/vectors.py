"""An inverted-file index over vectors: lists of near vectors, codes of one byte a dimension, exact scores of the best.

Vectors go to the list of their nearest centre. A list is stored in blocks, each one row: ids, codes (INT8, cut at a quantile)
and unit vectors, in a table partitioned by list. A search reads the codes of the lists nearest to its queries, and the
vectors only of blocks that hold one of the best by code. Centres are the only thing that is fitted on a sample and sent to
every task; their number is bounded.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.sources.work import checkpointed, discard

#: At most so many lists, so many sampled vectors a list to place their centres by, and so many bytes of sampled vectors.
MOST_LISTS, SAMPLE_PER_LIST, SAMPLE_BYTES = 16384, 64, 128 << 20
#: Vectors of a block, blocks of a task when a list is written, and queries that go to a block together.
BLOCK, TASK_BLOCKS, QUERY_GROUP = 1024, 64, 256
#: A search reads so many lists that this share of near neighbours in the sample would be met; for k results so many times k are scored exactly.
RECALL, OVERSAMPLE = 0.95, 4
#: Sampled queries and their neighbours that this is judged by.
JUDGED, NEIGHBOURS = 256, 10
ROUNDS, STEPS = 12, 127


def usable(df: DataFrame, dim: int | None = None) -> DataFrame:
    """Rows whose vector has a direction: neither null nor zero, no null or non-finite component, and dim of them if that is given."""
    fine = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    return df.where(fine if dim is None else fine & (F.size("vector") == dim))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of an Arrow list column, a row each."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def centres(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centres of unit vectors, by rounds of assigning and averaging; a centre that nothing is near to moves to a vector far from its own."""
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), lists, replace=len(sample) < lists)].copy()
    for _ in range(ROUNDS):
        nearest, score = _nearest(sample, at)
        sums = np.zeros_like(at)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(norms == 0)
        sums[empty] = sample[np.argsort(score)[np.arange(len(empty)) % len(sample)]]
        at = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return at


def _nearest(v: np.ndarray, at: np.ndarray, slice_rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    best, score = np.zeros(len(v), np.int64), np.zeros(len(v))
    for i in range(0, len(v), slice_rows):
        s = v[i : i + slice_rows] @ at.T
        best[i : i + slice_rows] = s.argmax(axis=1)
        score[i : i + slice_rows] = s.max(axis=1)
    return best, score


def probes_for(sample: np.ndarray, at: np.ndarray, recall: float) -> int:
    """How many of a query's nearest lists hold this share of its near neighbours, judged by sampled vectors. Neighbours in
    the sample are further away than those in all vectors, so that the share is rather higher there."""
    q = sample[:JUDGED]
    scores = q @ sample.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = _ranked(scores, min(NEIGHBOURS, max(len(sample) - 1, 1)))
    home, _ = _nearest(sample, at)
    place = np.argsort(np.argsort(-(q @ at.T), axis=1, kind="stable"), axis=1, kind="stable")
    return int(np.quantile(np.take_along_axis(place, home[near], 1), recall, method="higher")) + 1


def _ranked(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row."""
    if k >= scores.shape[1]:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


class VectorIndex:
    """An index under one folder: `settings` (one row) and `blocks`, partitioned by list."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        row = spark.read.parquet(f"{self.path}/settings").first()
        self.settings = json.loads(row.settings)
        self.dim, self.lists, self.scale, self.points = (self.settings[x] for x in ("dim", "lists", "scale", "points"))
        self.at = np.frombuffer(row.centres).reshape(self.lists, self.dim) if self.points else np.zeros((0, self.dim))

    @classmethod
    def build(cls, points: DataFrame, path: str, lists: int | None = None, quantile: float = 0.99, recall: float = RECALL, block: int = BLOCK) -> VectorIndex:
        """Indexes every row of points (id, vector) that has a direction; all must have one length. Other columns are not read.

        The sample that centres, the codes' range and the number of lists to read are fitted on is chosen by a hash of the
        ids, about SAMPLE_PER_LIST rows a list within SAMPLE_BYTES. Lists that hold many rows are written by many tasks. A repeated id is a point each time.
        """
        spark, path = points.sparkSession, path.rstrip("/")
        rows = usable(points.select("id", "vector"))
        shape = rows.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
        if shape.low != shape.high:
            raise ValueError("vectors must be of one length")
        n, dim, id_kind = shape.n, shape.low or 0, points.schema["id"].dataType.simpleString()
        lists = max(1, min(lists or round(2 * n**0.5), MOST_LISTS, max(n, 1)))
        wanted = min(lists * SAMPLE_PER_LIST, max(lists, SAMPLE_BYTES // (8 * max(dim, 1))))
        place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
        picked = [r.vector for r in rows.where(place < min(1.0, wanted / n)).orderBy(place, "id").select("vector").collect()] if n else []
        if n and not picked:
            picked = [rows.first().vector]
        sample = matrix(pa.array(picked, pa.list_(pa.float64())), dim) if picked else np.zeros((0, dim))
        at = centres(sample, lists) if n else sample
        scale = float(np.quantile(np.abs(sample), quantile)) or 1.0 if n else 1.0
        shared = spark.sparkContext.broadcast(at)

        def assign(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                for i in range(0, b.num_rows, 4096):
                    part = b.slice(i, 4096)
                    nearest, _ = _nearest(matrix(part.column(1), dim), shared.value)
                    yield pa.RecordBatch.from_arrays([pa.array(nearest.astype(np.int32)), part.column(0), part.column(1)], names=["list", "id", "vector"])

        assigned = checkpointed(rows.withColumn("vector", F.col("vector").cast("array<double>")).mapInArrow(assign, f"list int, id {id_kind}, vector array<double>"), "assigned")
        sizes = assigned.groupBy("list").agg(F.count("*").alias("size"))  # a row for each list
        tasks = F.ceil(F.col("size") / (block * TASK_BLOCKS)).cast("int")
        dealt = assigned.join(F.broadcast(sizes.select("list", tasks.alias("tasks"))), "list")
        dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("id", F.lit("salt")), F.col("tasks")))
        parts = max(1, min(lists, -(-n // (block * TASK_BLOCKS)) * 2))
        dealt = dealt.repartition(parts, "list", "salt").sortWithinPartitions("list", "id").select("list", "id", "vector")

        def pack(batches: Iterator[pa.RecordBatch]):
            from pyspark import TaskContext

            task, number, ids, held, current = TaskContext.get().partitionId(), 0, [], [], None

            def done():
                v = np.concatenate(held)
                codes = np.clip(np.round(v / scale * STEPS), -STEPS, STEPS).astype(np.int8)
                columns = [pa.array([current], pa.int32()), pa.array([(task << 32) + number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.concat_arrays(ids)), pa.array([codes.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=["list", "block", "ids", "codes", "vectors"])

            for b in batches:
                which = b.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
                for x, y in zip(edges, edges[1:], strict=False):
                    while x < y:
                        if current != which[x] or sum(map(len, held)) == block:
                            if held:
                                yield done()
                                number += 1
                            current, ids, held = int(which[x]), [], []
                        z = min(y, x + block - sum(map(len, held)))
                        part = b.slice(x, z - x)
                        ids.append(part.column(1))
                        held.append(matrix(part.column(2), dim))
                        x = z
            if held:
                yield done()

        dealt.mapInArrow(pack, f"list int, block bigint, ids array<{id_kind}>, codes binary, vectors binary").write.mode("overwrite").partitionBy("list").parquet(f"{path}/blocks")
        discard(assigned)
        probes = probes_for(sample, at, recall) if n else 0
        settings = json.dumps({"dim": dim, "probes": probes, "recall": recall, "lists": lists, "scale": scale, "points": n, "quantile": quantile, "block": block, "id": id_kind})
        spark.createDataFrame([(settings, bytearray(np.ascontiguousarray(at).tobytes()))], "settings string, centres binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
        return cls(spark, path)

    def blocks(self, lists: list[int]) -> DataFrame:
        """Blocks of these lists; the others' folders are not opened."""
        schema = f"block bigint, ids array<{self.settings['id']}>, codes binary, vectors binary, list int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/blocks").where(F.col("list").isin(lists))

    def probes(self, share: float | None = None) -> int:
        return self.settings["probes"] if share is None else min(self.lists, max(1, math.ceil(self.lists * share)))

    def asks(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, unit and list: each query with each of the lists that are read for it."""
        kind, dim, at = queries.schema["query_id"].dataType.simpleString(), self.dim, self.spark.sparkContext.broadcast(self.at)

        def run(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                for i in range(0, b.num_rows, 1024):
                    part = b.slice(i, 1024)
                    q = matrix(part.column(1), dim)
                    near = _ranked(q @ at.value.T, probes)
                    units = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * dim, pa.int32()), pa.array(q.ravel()))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column(0), units, lists], names=["query_id", "unit", "lists"])

        found = usable(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")), dim).mapInArrow(run, f"query_id {kind}, unit array<double>, lists array<int>")
        return found.select("query_id", "unit", F.explode("lists").alias("list"))

    def search(self, queries: DataFrame, k: int, digits: int = 4, share: float | None = None, oversample: int = OVERSAMPLE, gone: DataFrame | None = None) -> DataFrame:
        """RET-1, RET-14 by the index: query_id, id, score (cosine), place of the k best of each query (query_id, vector).

        share is that of the lists to read, else the index's own number of lists is read; with 1, and an oversample that takes in all points, the result is that of the
        full scan. Queries without a direction find nothing. Points whose id is in gone (id) are left out before the best are
        taken: as long as no more than (oversample - 1) k of a query's best are gone, it loses none. Groups of queries meet the blocks of their lists by a join; a
        list that many queries ask for gets many groups.
        """
        kind = queries.schema["query_id"].dataType.simpleString()
        if not self.points:
            return self.spark.createDataFrame([], f"query_id {kind}, id {self.settings['id']}, score double, place int")
        most, dim, scale, id_kind = k * oversample, self.dim, self.scale, self.settings["id"]
        asks = checkpointed(self.asks(queries, self.probes(share)), "asks")
        counts = asks.groupBy("list").agg(F.count("*").alias("n"))  # a row for each list
        wanted = [r.list for r in counts.collect()]
        groups = F.ceil(F.col("n") / QUERY_GROUP).cast("int")
        grouped = asks.join(F.broadcast(counts.select("list", groups.alias("groups"))), "list").withColumn("g", F.pmod(F.xxhash64("query_id"), F.col("groups")))
        grouped = checkpointed(grouped.groupBy("list", "g").agg(F.collect_list(F.struct("query_id", "unit")).alias("asked")).drop("g"), "asked")

        def by_code(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                for i in range(b.num_rows):
                    codes = np.frombuffer(b.column(2)[i].as_buffer(), np.int8).reshape(-1, dim).astype(np.float32)
                    asked = b.column(3)[i].values
                    q = asked.field(1).flatten().to_numpy().reshape(-1, dim).astype(np.float32)
                    scores = q @ codes.T * np.float32(scale / STEPS)
                    best = _ranked(scores, most)
                    row = np.repeat(np.arange(len(q)), best.shape[1])
                    columns = [asked.field(0).take(pa.array(row)), pa.array(np.full(len(row), b.column(0)[i].as_py(), np.int32)), pa.array(np.full(len(row), b.column(1)[i].as_py())), pa.array(best.ravel().astype(np.int32)), pa.array(np.take_along_axis(scores, best, 1).ravel().astype(float))]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "list", "block", "at", "near"])

        met = self.blocks(wanted).select("list", "block", "codes").join(grouped, "list")
        near = met.select("list", "block", "codes", "asked").mapInArrow(by_code, f"query_id {kind}, list int, block bigint, at int, near double")
        order = Window.partitionBy("query_id").orderBy(F.desc("near"), "list", "block", "at")
        near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r", "near")
        units = asks.groupBy("query_id").agg(F.first("unit").alias("unit"))
        salt = F.pmod(F.xxhash64("query_id"), F.lit(-(-queries.count() // (QUERY_GROUP * 16)) or 1))
        best = near.join(units, "query_id").groupBy("list", "block", salt.alias("g")).agg(F.collect_list(F.struct("query_id", "at", "unit")).alias("asked"))
        best = checkpointed(best.drop("g"), "best")

        def exactly(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                for i in range(b.num_rows):
                    v = np.frombuffer(b.column(1)[i].as_buffer()).reshape(-1, dim)
                    asked = b.column(2)[i].values
                    at = asked.field(1).to_numpy()
                    scores = np.einsum("ij,ij->i", asked.field(2).flatten().to_numpy().reshape(-1, dim), v[at])
                    yield pa.RecordBatch.from_arrays([asked.field(0), b.column(0)[i].values.take(pa.array(at)), pa.array(np.round(scores, digits))], names=["query_id", "id", "score"])

        scored = self.blocks(wanted).select("list", "block", "ids", "vectors").join(best, ["list", "block"])
        scored = scored.select("ids", "vectors", "asked").mapInArrow(exactly, f"query_id {kind}, id {id_kind}, score double")
        scored = scored if gone is None else scored.join(gone.select("id"), "id", "left_anti")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        out = checkpointed(scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k), "nearest")
        discard(asks, grouped, best)
        return out

    def cost(self, queries: DataFrame, share: float | None = None) -> dict[str, int]:
        """What a search compares by code and reads, beside what the full scan does: pairs, all_pairs, lists, all_lists, points, all_points."""
        asks = self.asks(queries, self.probes(share)).groupBy("list").agg(F.count("*").alias("asked"))
        sizes = self.blocks(list(range(self.lists))).groupBy("list").agg(F.sum(F.size("ids")).alias("size"))
        row = asks.join(sizes, "list").agg(F.sum(F.col("asked") * F.col("size")).alias("pairs"), F.count("*").alias("lists"), F.sum("size").alias("points")).first()
        n = usable(queries, self.dim).count()
        return {"pairs": row.pairs or 0, "all_pairs": n * self.points, "lists": row.lists, "all_lists": self.lists, "points": row.points or 0, "all_points": self.points}
