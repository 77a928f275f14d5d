"""Counts, roll-ups and look-ups over the library's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import forward_slashes
from codeloom.operators.graph import CALLS, in_degree

#: Lines of one bin of the join of positions with line ranges.
BIN = 64


def counts_of(df: DataFrame, column: str, values: list, *keys: str) -> DataFrame:
    """AGG-1, AGG-2: rows of each value of a fixed list, those without rows included."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} {df.schema[column].dataType.simpleString()}")
    if keys:
        wanted = df.select(*keys).distinct().withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))
    found = df.groupBy(*keys, column).agg(F.count("*").alias("n"))
    return wanted.join(found, [*keys, column], "left").select(*keys, column, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def by_extension(df: DataFrame, path: str) -> DataFrame:
    """AGG-3: rows by file extension (`<noext>` without one)."""
    ext = F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"\.([^.]+)$", 1))
    return df.groupBy(F.when(ext == "", "<noext>").otherwise(ext).alias("ext")).agg(F.count("*").alias("n"))


def edge_count(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-8: calls by the caller's repository."""
    calls = edges.where(F.col("edge_type") == CALLS)
    return calls.join(methods.select(F.col("id").alias("src"), "repo_id"), "src").groupBy("repo_id").agg(F.count("*").alias("n_edges"))


def repo_rollup(methods: DataFrame, edges: DataFrame, keys: DataFrame) -> DataFrame:
    """AGG-13: chunks, symbols, names and calls of each repository."""
    chunks = methods.groupBy("repo_id").agg(F.count("*").alias("chunk_count"), F.count_if("is_primary").alias("symbol_count"))
    names = keys.join(methods.select("id", "repo_id"), "id").groupBy("repo_id").agg(F.countDistinct("key").alias("name_count"))
    zero = F.lit(0).cast("long")
    return chunks.join(names, "repo_id", "left").join(edge_count(methods, edges), "repo_id", "left").select("repo_id", "chunk_count", "symbol_count", F.coalesce("name_count", zero).alias("name_count"), F.coalesce("n_edges", zero).alias("edge_count"))


def impact_groups(rows: DataFrame, shown: int = 6) -> DataFrame:
    """AGG-14: impact by hop: how many, and the first shown of them."""
    order = Window.partitionBy("target", "depth").orderBy("place")
    placed = rows.withColumn("k", F.row_number().over(order))
    first = F.array_sort(F.collect_list(F.when(F.col("k") <= shown, F.struct("k", "id"))))
    return placed.groupBy("target", "depth").agg(F.count("*").alias("n"), F.array_join(F.transform(first, lambda x: x["id"]), ",").alias("shown"))


def centroids(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """AGG-17"""
    return rows.groupBy(key).agg(F.round(F.avg(x), 6).alias("x"), F.round(F.avg(y), 6).alias("y"), F.count("*").alias("n"))


def bounding_box(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """AGG-18"""
    return rows.groupBy(key).agg(F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))


def symbols_at(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """JOIN-9, FIL-6: the innermost symbol around each place (file_path in either slash style, line); places outside all symbols are left out.

    Places meet the symbols of their file and of their bin of lines by an equi-join, so that large files are dealt out.
    """
    spans = symbols.where("name is not null").select("id", forward_slashes(F.col("file_path")).alias("file_path"), "line_start", "line_end", F.explode(F.sequence(F.floor(F.col("line_start") / BIN), F.floor(F.col("line_end") / BIN))).alias("bin"))
    asked = places.select(forward_slashes(F.col("file_path")).alias("file_path"), "line", F.floor(F.col("line") / BIN).alias("bin"))
    found = asked.join(spans, ["file_path", "bin"]).where("line_start <= line and line_end >= line")
    return found.groupBy("file_path", "line").agg(F.min_by("id", F.struct(F.col("line_end") - F.col("line_start"), F.col("id"))).alias("id"))


def node_looks(methods: DataFrame, edges: DataFrame, kinds: dict[str, list[str]], base: float = 10.0) -> DataFrame:
    """RET-20: kind by keywords in class and path, and radius by in-degree."""
    text = F.lower(F.concat_ws(" ", "class_name", "file_path"))
    kind: Column = F.when(F.col("chunk_type") == "sql", "sql")
    for name, words in kinds.items():
        for w in words:
            kind = kind.when(text.contains(w), name)
    joined = methods.join(in_degree(methods, edges), "id")
    return joined.select("id", kind.otherwise("plain").alias("kind"), F.round(base + F.least(0.6 * F.col("in_degree"), F.lit(6.0)), 6).alias("radius"))


def severity_counts(bugs: DataFrame, *keys: str) -> DataFrame:
    """AGG-15"""
    return bugs.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("high", "medium", "low")])
