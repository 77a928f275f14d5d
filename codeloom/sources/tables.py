"""The service's tables as DataFrames: filters, upserts, deletes, appends and listings."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from codeloom.functions.text import forward_slashes
from codeloom.operators.graph import node_type
from codeloom.operators.retrieval import dense_search, top
from codeloom.operators.vectors import VectorIndex
from codeloom.sources.files import decoded, file_name
from codeloom.sources.work import checkpointed, work_dir

#: The settings that a collection is created with.
INDEX_SETTINGS = {"distance": "cosine", "m": 16, "ef_construct": 128, "quantization": "int8", "quantile": 0.99}


def filtered(df: DataFrame, **equal) -> DataFrame:
    """FIL-1, FIL-3, FIL-7: rows whose columns have the given values; None does not filter."""
    for k, v in equal.items():
        if v is not None:
            df = df.where(F.col(k) == v)
    return df


def first_chunks(chunks: DataFrame) -> DataFrame:
    """FIL-2: one chunk of each symbol, the smallest id."""
    return chunks.where(F.coalesce("symbol_id", F.lit("")) != "").groupBy("symbol_id").agg(F.min("id").alias("id"))


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """FIL-4, FIL-5"""
    return df.join(ids.select("id"), "id", "left_semi")


def classes_of(df: DataFrame, path: str) -> DataFrame:
    """FIL-8: rows of a file, by its path in either slash style or by its name."""
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    p = F.col("file_path")
    return df.where((p == path) | (forward_slashes(p) == path.replace("\\", "/")) | p.endswith("/" + name))


def without(df: DataFrame, column: str, values: list) -> DataFrame:
    """FIL-13, SRC-20: rows of other values; nulls stay."""
    return df.where(F.coalesce(~F.col(column).isin(values), F.lit(True)))


def cascade(df: DataFrame, key: str, deleted: DataFrame) -> DataFrame:
    """SRC-10: rows that do not belong to what was deleted."""
    return df.join(deleted.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SRC-11: new rows, and the old ones of other keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SRC-21: what a dynamic partition overwrite leaves: new rows in place of all old ones of their keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def distinct_nodes(df: DataFrame, key: str) -> DataFrame:
    """SRC-12: one row for each key, the smallest of each other column."""
    return df.groupBy(key).agg(*[F.min(c).alias(c) for c in df.columns if c != key])


def register(repos: DataFrame, new: DataFrame) -> DataFrame:
    """SRC-19: upsert by root_path: names are new, the state of indexing stays; repositories that are new start at 0."""
    old = repos.select("root_path", F.col("name").alias("old_name"), "indexed")
    both = new.join(old, "root_path", "full")
    return both.select("root_path", F.coalesce("name", "old_name").alias("name"), F.coalesce("indexed", F.lit(0)).alias("indexed"))


def appended(log: DataFrame, new: DataFrame) -> DataFrame:
    """SRC-22, SRC-23: log with new rows, which take the next ids in the order of their text.

    Places are counted in ranges of texts, each sorted by itself, and the ranges' sizes added up, so that no task numbers all rows.
    """
    last = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    ranges = checkpointed(new.repartitionByRange("query").sortWithinPartitions("query").select("query", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "appended")
    sizes = sorted((r.part, r.n, r.least) for r in ranges.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("least")).collect())  # a row for each range
    before, at = {}, last
    for part, n, least in sizes:
        before[part] = at - least + 1
        at += n
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("part")] if before else F.lit(0)
    return log.select("id", "query").unionByName(ranges.select((F.col("place") + offset).cast(log.schema["id"].dataType).alias("id"), "query"))


def latest(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """TOP-2, TOP-3: the rows of largest id, of each key if there is one."""
    if not keys:
        return df.orderBy(F.desc("id")).limit(most)
    order = Window.partitionBy(*keys).orderBy(F.desc("id"))
    return df.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)


def numbered(rows: DataFrame) -> DataFrame:
    """Places of a tree's rows within their directory (TOP-11)."""
    order = Window.partitionBy("parent_path").orderBy(F.col("type") == "file", F.lower("name"), "name", "type")
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def repo_response(repos: DataFrame) -> DataFrame:
    """PRJ-1: skip_dirs decoded from JSON, empty if null."""
    dirs = F.coalesce(F.from_json("skip_dirs", "array<string>"), F.array().cast("array<string>"))
    return repos.select("id", "name", F.array_join(dirs, ",").alias("dirs"), "indexed", (F.col("indexed") == 2).alias("is_ready"))


def node_types(methods: DataFrame) -> DataFrame:
    return methods.select("id", node_type(F.col("chunk_type")).alias("node_type"))


def markdown_name(path: Column) -> Column:
    """SRC-24: name of a generated document: the file's without extension."""
    return F.concat(F.regexp_replace(file_name(path), r"\.[^.]+$", ""), F.lit(".md"))


def encodings(raw: DataFrame) -> DataFrame:
    """SRC-4: encoding and text of binary columns (doc_id, raw, text), and whether the text came back."""

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            found = [decoded(bytes(x)) for x in b["raw"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "encoding": [e for _, e in found], "n_chars": [len(t) for t, _ in found]})

    return raw.select("doc_id", "raw").mapInPandas(run, "doc_id bigint, encoding string, n_chars bigint")


def run_query(spark, sql: str, **shapes: DataFrame) -> DataFrame:
    """SRC-14: SQL over DataFrames, which it names in braces."""
    return spark.sql(sql, **shapes)


def with_retries(write: Callable[[], None], tries: int = 3, wait: float = 1.0) -> None:
    """SRC-13, SRC-22: runs a write that commits as a whole; after a failure again, each time after twice the wait."""
    for k in range(tries):
        try:
            return write()
        except Exception:
            if k + 1 == tries:
                raise
            time.sleep(wait * 2**k)


def stored(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """SRC-13, SRC-16: df written as a table in the work folder, partitioned by columns, and read again; Spark retries tasks and commits as a whole, and the whole write is tried again."""
    path = f"{work_dir(df.sparkSession)}/codeloom-tables/{name}-{uuid.uuid4().hex}"
    with_retries(lambda: df.write.mode("overwrite").partitionBy(*partitions).parquet(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Collection:
    """SRC-15..17: vectors (id, vector and what else they carry) under one folder, kept by id.

    Points are written as segments, with the ids that a segment replaces beside it, and count from the moment that a commit
    (a small file of the next number, which only one writer can make) names both. So a write that dies leaves no trace in
    what is read, and readers see whole commits. An index covers the points of one commit; a search asks it for those that
    are still there, and compares later ones one by one. Beside dim, settings take those of the index: quantile cuts the
    codes; m and ef_construct belong to another kind of index and are kept for whoever asks.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def exists(self) -> bool:
        fs, p = self._files("settings/_SUCCESS")
        return fs.exists(p)

    def create(self, dim: int, **settings) -> None:
        """Does nothing if it is there with the same number of dimensions."""
        if self.exists():
            if self.settings()["dim"] != dim:
                raise ValueError("the collection has vectors of another length")
            return
        one = self.spark.createDataFrame([(json.dumps(INDEX_SETTINGS | settings | {"dim": dim}),)], "settings string")
        with_retries(lambda: one.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/settings"))

    def settings(self) -> dict:
        if not self.exists():
            raise KeyError(self.path)
        return json.loads(self.spark.read.parquet(f"{self.path}/settings").first().settings)

    def commits(self) -> list[dict]:
        """Commits since the last compaction, in order: number, segment and dead (names or None)."""
        fs, p = self._files("commits")
        if not fs.exists(p):
            return []
        rows = sorted((json.loads(r.value) for r in self.spark.read.text(f"{self.path}/commits").collect()), key=lambda c: c["number"])
        last = max((i for i, c in enumerate(rows) if c["compact"]), default=0)
        return rows[last:]

    def _commit(self, after: int, segment: str | None, dead: str | None, compact: bool = False) -> int:
        """Makes the next commit, or fails if another writer made it meanwhile."""
        fs, p = self._files(f"commits/{after + 1:012d}.json")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps({"number": after + 1, "segment": segment, "dead": dead, "compact": compact}).encode()))
        out.close()
        return after + 1

    def _last(self) -> int:
        return max((c["number"] for c in self.commits()), default=0)

    def write(self, points: DataFrame, *partitions: str) -> int:
        """Upserts points by id; those of other lengths are refused before anything is written. Of points of one write that share an id one stays. Returns the commit's number."""
        dim = self.settings()["dim"]
        if points.where(F.size("vector") != dim).limit(1).count():
            raise ValueError(f"vectors must have {dim} dimensions")
        last, segment = self._last(), uuid.uuid4().hex
        with_retries(lambda: points.dropDuplicates(["id"]).write.mode("overwrite").partitionBy(*partitions).parquet(f"{self.path}/points/segment={segment}"))
        written = self.spark.read.schema(points.schema).parquet(f"{self.path}/points/segment={segment}")
        return self._commit(last, segment, self._dead(written.select("id")))

    def delete(self, ids: DataFrame) -> int:
        """Removes the points of ids (id); returns the commit's number."""
        return self._commit(self._last(), None, self._dead(ids.select("id").distinct()))

    def _dead(self, ids: DataFrame) -> str | None:
        """Writes which of ids are there already; their name, or None if none is."""
        if not any(c["segment"] for c in self.commits()):
            return None
        there = self.points(f"id {ids.schema['id'].dataType.simpleString()}").join(ids, "id", "left_semi")
        name = uuid.uuid4().hex
        with_retries(lambda: there.write.mode("overwrite").parquet(f"{self.path}/dead/{name}"))
        return name if self.spark.read.schema(there.schema).parquet(f"{self.path}/dead/{name}").limit(1).count() else None

    def gone(self, id_kind: str, after: int = 0) -> DataFrame | None:
        """id and until: points of id that were written before commit `until` are replaced or deleted; by commits after this one."""
        found = [self.spark.read.schema(f"id {id_kind}").parquet(f"{self.path}/dead/{c['dead']}").withColumn("until", F.lit(c["number"])) for c in self.commits() if c["dead"] and c["number"] > after]
        return reduce(DataFrame.union, found).groupBy("id").agg(F.max("until").alias("until")) if found else None

    def points(self, schema: str | StructType, after: int = 0) -> DataFrame:
        """The points that count, of segments of commits after this one."""
        segments = [(c["segment"], c["number"]) for c in self.commits() if c["segment"] and c["number"] > after]
        names = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if not segments:
            return self.spark.createDataFrame([], names)
        rows = self.spark.read.schema(StructType([*names.fields, StructField("segment", StringType())])).parquet(f"{self.path}/points")
        rows = rows.where(F.col("segment").isin([s for s, _ in segments]))
        gone = self.gone(names["id"].dataType.simpleString()) if "id" in names.fieldNames() else None
        if gone is not None:
            rows = rows.join(F.broadcast(self.spark.createDataFrame(segments, "segment string, number int")), "segment")
            rows = rows.join(gone.withColumnRenamed("id", "gone_id"), (F.col("id") == F.col("gone_id")) & (F.col("number") < F.col("until")), "left_anti")
        return rows.select(*names.fieldNames())

    def compact(self, schema: str | StructType, *partitions: str) -> int:
        """Writes the points that count (with the columns of schema) as one segment, which stands for all before."""
        last, segment = self._last(), uuid.uuid4().hex
        with_retries(lambda: self.points(schema).write.mode("overwrite").partitionBy(*partitions).parquet(f"{self.path}/points/segment={segment}"))
        return self._commit(last, segment, None, compact=True)

    def _id_kind(self) -> str:
        names = [c["segment"] for c in self.commits() if c["segment"]]
        return self.spark.read.parquet(f"{self.path}/points/segment={names[0]}").schema["id"].dataType.simpleString() if names else "string"

    def build_index(self, **options) -> VectorIndex:
        """SRC-15: indexes the points of the last commit."""
        last = self._last()
        return VectorIndex.build(self.points(f"id {self._id_kind()}, vector array<double>"), f"{self.path}/index/{last:012d}", quantile=self.settings()["quantile"], **options)

    def _index(self) -> tuple[int, VectorIndex] | None:
        """The index of the latest commit that has one, and that commit's number."""
        fs, p = self._files("index")
        names = sorted((s.getPath().getName() for s in fs.listStatus(p)), reverse=True) if fs.exists(p) else []
        for name in names:
            if fs.exists(self._files(f"index/{name}/settings/_SUCCESS")[1]):
                return int(name), VectorIndex(self.spark, f"{self.path}/index/{name}")
        return None

    def search(self, queries: DataFrame, k: int, digits: int = 4, exact: bool = False) -> DataFrame:
        """RET-1 over the collection: query_id, id, score, place. By the index where there is one and exact is not asked for; points later than the index are compared with every query."""
        id_kind, index = self._id_kind(), None if exact else self._index()
        if index is None or any(c["compact"] and c["number"] > index[0] for c in self.commits()):
            return dense_search(queries, self.points(f"id {id_kind}, vector array<double>"), k, digits)
        number, found = index
        near = found.search(queries, k, digits, gone=self.gone(id_kind, number)).drop("place")
        later = dense_search(queries, self.points(f"id {id_kind}, vector array<double>", number), k, digits, cut=False)
        return top(near.unionByName(later), k)

    def info(self) -> dict:
        """Settings and number of points."""
        return self.settings() | {"points": self.points(f"id {self._id_kind()}").count()}

    def drop(self) -> None:
        fs, p = self._files()
        fs.delete(p, True)


def collection_info(points: DataFrame, *keys: str) -> DataFrame:
    """SRC-17: number and dimensions of the points of each collection."""
    return points.groupBy(*keys).agg(F.count("*").alias("points"), F.max(F.size("vector")).cast("long").alias("dim"))


def in_roots(path: Column, roots: list[str]) -> Column:
    """SRC-9 as a column: whether a path is one of the roots or below one; without roots everything is."""
    out = F.lit(not roots)
    for r in roots:
        out = out | (path == r.rstrip("/")) | path.startswith(r.rstrip("/") + "/")
    return out


def is_absolute(path: Column) -> Column:
    """SRC-26 as a column"""
    return path.startswith("/") | path.rlike(r"^[A-Za-z]:[\\/]")
