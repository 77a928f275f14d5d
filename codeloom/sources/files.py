"""Source files: which paths of a tree are indexed, reading and decoding them, and the tree as rows.

Rules over paths are Column expressions, so that a listing of any size is filtered by Spark. The listing itself is a data
source of its own (trees.py), since Spark's leaves out names that begin with `_` or `.`, and enters skipped directories.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.trees import file_system, read_tree

#: The tables and lists that decide what is indexed.
LANGUAGES = {
    "java": "java", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "go": "go", "kt": "kotlin", "scala": "scala", "rs": "rust", "cpp": "cpp", "cc": "cpp", "c": "c", "cs": "csharp",
    "rb": "ruby", "php": "php", "swift": "swift", "vue": "vue", "md": "markdown", "yaml": "yaml", "yml": "yaml",
    "json": "json", "toml": "toml", "xml": "xml", "sql": "sql", "sh": "bash",
}
INDEXED_EXTENSIONS = ["java", "js", "ts", "jsx", "tsx", "vue", "xml"]
SKIP_DIRS = [
    ".git", ".svn", ".hg", "CVS", "cvs", "node_modules", "bower_components", "jspm_packages", "__pycache__", ".venv", "venv", "env",
    "site-packages", ".tox", ".nox", "target", "build", "dist", ".gradle", ".idea", ".vscode", "out", "bin", ".cache", ".mypy_cache",
    ".pytest_cache", "cmake-build-debug", "cmake-build-release", "classes", "work", "vendor", "vendors", "third_party", "thirdparty",
    "external", "externals", "deps", "Pods", "Carthage", ".bundle", "webjars", "img", "imgs", "images",
]
SKIP_FILES = [
    ".ds_store", "thumbs.db", ".gitignore", ".gitattributes", "pom.xml", "web.xml", "logback.xml", "logback-spring.xml", "log4j.xml",
    "log4j2.xml", "log4j2-spring.xml", "jquery.js", "jquery.slim.js", "bootstrap.js", "bootstrap.bundle.js", "moment.js",
    "moment-with-locales.js", "lodash.js", "underscore.js", "axios.js", "angular.js", "react.js", "react-dom.js", "react.development.js",
    "react-dom.development.js", "react.production.min.js", "react-dom.production.min.js", "vue.js", "vue.global.js", "vue.esm-browser.js",
    "d3.js", "echarts.js", "highcharts.js", "popper.js", "tippy.js", "select2.js", "datatables.js", "swiper.js", "slick.js", "require.js", "requirejs.js",
]
SKIP_SUFFIXES = [".min.js", ".min.css", ".bundle.js", ".chunk.js", "-min.js", "-min.css"]
VENDOR_VERSION = r"(?i)^(?:jquery|bootstrap|angular|moment|lodash|underscore|axios|react(?:-dom)?|vue|d3|echarts|highcharts|select2|datatables|swiper|popper|tippy|require|knockout|backbone|font.?awesome)[.\-]\d"
ENCODINGS = ["utf-8", "cp932", "gb2312", "cp1252", "latin-1"]
MAX_INDEXED_BYTES, MAX_SHOWN_BYTES, MAX_TREE_DEPTH = 500_000, 2 * 1024 * 1024, 8


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; empty for a name without a dot beyond its first character."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def language(path: Column) -> Column:
    """SRC-5: null for unknown extensions."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return table[extension(path)]


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def in_skipped_dir(path: Column) -> Column:
    """SRC-6"""
    return F.arrays_overlap(directories(path), F.array(*[F.lit(d) for d in SKIP_DIRS]))


def in_custom_dir(path: Column, rules: Iterable[str]) -> Column:
    """SRC-7: a bare rule is a directory of that name at any level, one with a slash a directory at that place from the root."""
    out = F.lit(False)
    for rule in rules:
        rule = rule.replace("\\", "/").strip("/")
        out = out | (path.startswith(rule + "/") if "/" in rule else F.array_contains(directories(path), rule))
    return out


def is_indexable(path: Column, size: Column) -> Column:
    """SRC-8: by name, suffix, vendor version, extension (of XML files only mappers) and size."""
    low = F.lower(file_name(path))
    suffix = F.lit(False)
    for s in SKIP_SUFFIXES:
        suffix = suffix | low.endswith(s)
    kind = extension(path)
    wanted = kind.isin(INDEXED_EXTENSIONS) & ((kind != "xml") | low.endswith("mapper.xml"))
    return ~low.isin(SKIP_FILES) & ~suffix & ~file_name(path).rlike(VENDOR_VERSION) & wanted & (size <= MAX_INDEXED_BYTES)


def is_allowed(path: str, roots: Iterable[str]) -> bool:
    """SRC-9: whether path lies in one of the roots; without roots everything is allowed."""
    roots = list(roots)
    real = os.path.realpath(path)
    return not roots or any(os.path.commonpath([real, os.path.realpath(r)]) == os.path.realpath(r) for r in roots)


def checked_root(path: str) -> str:
    """SRC-26: an absolute path of a directory, resolved."""
    if not os.path.isabs(path):
        raise ValueError("the path must be absolute")
    if not os.path.isdir(path):
        raise ValueError("the path is no directory")
    return os.path.realpath(path)


def list_files(spark: SparkSession, root: str, skip: Iterable[str] = ()) -> DataFrame:
    """SRC-1, SRC-2, SRC-6, SRC-7: paths under root, relative and with forward slashes, and sizes; the executors list them, and skipped directories are not entered."""
    rules = {r.replace("\\", "/").strip("/") for r in skip} - {""}
    placed = {r for r in rules if "/" in r}
    return read_tree(spark, root if "://" in root else checked_root(root), set(SKIP_DIRS) | (rules - placed), placed).select("path", "size")


def decoded(raw: bytes) -> tuple[str, str]:
    """SRC-4: text and the first encoding that decodes without loss."""
    for e in ENCODINGS:
        try:
            return raw.decode(e), e
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1"), "latin-1"


def read_files(paths: DataFrame, root: str) -> DataFrame:
    """SRC-1: path, size, language, encoding and source of each path, read by the executors; root must be on a file system that they share."""

    def run(batches: Iterator[pd.DataFrame]):
        fs, base = file_system(root)
        for b in batches:
            texts = []
            for p in b["path"]:
                with fs.open_input_stream(f"{base}/{p}", compression=None) as f:
                    texts.append(decoded(f.read()))
            yield b.assign(source=[t for t, _ in texts], encoding=[e for _, e in texts])

    out = paths.select("path", "size").mapInPandas(run, "path string, size bigint, source string, encoding string")
    return out.withColumn("language", language(F.col("path")))


def scan(spark: SparkSession, root: str, skip: Iterable[str] = ()) -> DataFrame:
    """SRC-1: the indexable files of a tree."""
    listed = list_files(spark, root, skip)
    return read_files(listed.where(is_indexable(F.col("path"), F.col("size"))).repartition(max(1, spark.sparkContext.defaultParallelism)), root if "://" in root else checked_root(root))


def read_one(root: str, path: str) -> dict:
    """SRC-3: one file for viewing: content, encoding, language and line count; refuses paths beyond the root and files over two MiB."""
    full = os.path.realpath(os.path.join(root, path))
    if not is_allowed(full, [root]):
        raise PermissionError("the path leaves the root")
    if os.path.getsize(full) > MAX_SHOWN_BYTES:
        raise ValueError("the file is too large")
    with open(full, "rb") as f:
        text, encoding = decoded(f.read())
    ext = os.path.splitext(path)[1].lstrip(".").lower()
    return {"path": path, "content": text, "encoding": encoding, "language": LANGUAGES.get(ext, "plaintext"), "line_count": text.count("\n") + 1}


def tree(files: DataFrame, max_depth: int = MAX_TREE_DEPTH) -> DataFrame:
    """SRC-2: a row for each file and directory: path, parent_path, name, type, depth, size (files) and files (directories: how many below)."""
    parts = F.split("path", "/")
    files = files.where(F.size(parts) <= max_depth)
    leaves = files.select("path", "size", F.lit("file").alias("type"), F.lit(None).cast("long").alias("files"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = files.where(F.size(parts) > 1).select(F.explode(prefixes).alias("path")).groupBy("path").agg(F.count("*").alias("files"))
    every = leaves.unionByName(dirs.select("path", F.lit(None).cast("long").alias("size"), F.lit("dir").alias("type"), "files"))
    n = F.size(F.split("path", "/"))
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return every.select("path", parent.alias("parent_path"), file_name(F.col("path")).alias("name"), "type", n.alias("depth"), "size", "files")


def in_tree_order(rows: DataFrame) -> DataFrame:
    """TOP-11: directories first, then by name without regard to case."""
    return rows.orderBy("parent_path", F.col("type") == "file", F.lower("name"), "name")


def primary_language(files: DataFrame) -> DataFrame:
    """AGG-5: repo_id and the language of most of its indexable files; of equal counts the first by name."""
    counts = files.where(language(F.col("path")).isNotNull()).groupBy("repo_id", language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))
    return counts.groupBy("repo_id").agg(F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("language"), F.max("n").alias("n"))
