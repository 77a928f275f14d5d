"""A Spark data source of source trees: partitions by directory, listed by the executors.

`spark.read.format("source_tree").load(root)` gives a row for each file below root: path (relative, with forward slashes),
size, modified. Planning lists only the upper directories, breadth first, until there are enough subtrees to deal out; each
task then walks its own. Directories that are skipped, or that no path of a pushed filter lies in, are not entered. root is a
path or the address of any file system that Arrow knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

SCHEMA = "path string, size bigint, modified timestamp"
#: Planning stops once it has so many subtrees, or has listed so many directories. Rows of a batch.
SUBTREES, PLANNED, BATCH = 512, 4096, 8192


def file_system(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of root, and root's path in it."""
    fs, base = arrow_fs.FileSystem.from_uri(root) if "://" in root else (arrow_fs.LocalFileSystem(), os.path.abspath(root))
    return fs, base.rstrip("/") or "/"


@dataclass
class Subtree(InputPartition):
    """What one task lists: the files of a directory, and with deep all below it."""

    path: str
    deep: bool


class TreeReader(DataSourceReader):
    """Walks root below the directories that rules do not skip: skip are names of directories at any level, placed are directories at their place from the root."""

    def __init__(self, options: dict[str, str]):
        self.fs, self.base = file_system(options["path"])
        self.skip, self.placed = set(json.loads(options.get("skip", "[]"))), set(json.loads(options.get("placed", "[]")))
        self.starts: list[str] | None = None  # what paths may begin with

    def may_hold(self, directory: str) -> bool:
        """Whether a path that is asked for can lie in directory, which ends with a slash or is empty."""
        return self.starts is None or any(s.startswith(directory) or directory.startswith(s) for s in self.starts)

    def listed(self, directory: str) -> tuple[list[str], list[arrow_fs.FileInfo]]:
        """Subdirectories to enter and files of directory; links to directories are not followed."""
        inner, files = [], []
        for info in self.fs.get_file_info(arrow_fs.FileSelector(f"{self.base}/{directory}".rstrip("/") or "/", allow_not_found=True)):
            if info.type == arrow_fs.FileType.File:
                files.append(info)
            elif info.type == arrow_fs.FileType.Directory and info.base_name not in self.skip and directory + info.base_name not in self.placed:
                below = f"{directory}{info.base_name}/"
                if self.may_hold(below) and not (isinstance(self.fs, arrow_fs.LocalFileSystem) and os.path.islink(info.path)):
                    inner.append(below)
        return sorted(inner), files

    def partitions(self) -> list[Subtree]:
        """Directories are opened level by level; the files of an opened one are a part of their own, a subtree not opened is one."""
        level, done = [""], []
        while level and len(level) + len(done) < SUBTREES and len(done) + len(level) < PLANNED:
            done += [Subtree(d, False) for d in level]
            level = [x for d in level for x in self.listed(d)[0]]
        return done + [Subtree(d, True) for d in level]

    def read(self, part: Subtree) -> Iterator[pa.RecordBatch]:
        held, open_ = [], [part.path]
        while open_:
            directory = open_.pop()
            inner, files = self.listed(directory)
            held += [(directory + f.base_name, f.size, f.mtime) for f in files]
            while len(held) >= BATCH:
                yield self.batch(held[:BATCH])
                held = held[BATCH:]
            open_ += reversed(inner) if part.deep else []
        if held:
            yield self.batch(held)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.timestamp("us", "UTC")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "size", "modified"])


class FilteredTreeReader(TreeReader):
    """Spark refuses a reader that takes filters in a session that does not push them, so this is a class of its own."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Notes what the path is or begins with; Spark applies all filters again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("path",):
                wanted = f.value if isinstance(f, In) else [f.value] if isinstance(f, EqualTo | StringStartsWith) else None
                if wanted is not None and (self.starts is None or len(wanted) < len(self.starts)):
                    self.starts = [x for x in wanted if x is not None]
            yield f


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        options = dict(self.options)
        return (FilteredTreeReader if options.get("pushdown") == "true" else TreeReader)(options)


def read_tree(spark: SparkSession, root: str, skip: set[str] = frozenset(), placed: set[str] = frozenset()) -> DataFrame:
    """Files below root as rows; filters on path are pushed into the walk where the session's spark.sql.python.filterPushdown.enabled is set."""
    spark.dataSource.register(SourceTree)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("source_tree").options(pushdown=pushdown, skip=json.dumps(sorted(skip)), placed=json.dumps(sorted(placed))).load(root)
