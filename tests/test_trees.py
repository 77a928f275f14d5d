"""The data source of source trees."""

import os
from types import SimpleNamespace

import pytest
from pyarrow import fs as arrow_fs
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from codeloom.sources import files as S
from codeloom.sources import trees
from codeloom.sources.trees import FilteredTreeReader, TreeReader, read_tree


def make(root, *paths):
    for p in paths:
        os.makedirs(root / os.path.dirname(p), exist_ok=True)
        (root / p).write_text("x" * (len(p) % 7))


PATHS = ["a.java", "src/b.ts", "src/_c/.d.js", ".hidden/e.py", "src/node_modules/f.js", "gen/g.java", "src/gen/h.java", "deep/" * 12 + "i.md", "src/x y/é漢.sql"]


def walked(root):
    return sorted((os.path.relpath(os.path.join(top, n), root).replace(os.sep, "/"), os.path.getsize(os.path.join(top, n))) for top, _, names in os.walk(root) for n in names)


def rows(df):
    return sorted((r.path, r.size) for r in df.select("path", "size").collect())


@pytest.mark.parametrize("subtrees", [1, 2, 512])
def test_every_file_comes_once_however_the_tree_is_dealt(tmp_path, monkeypatch, subtrees):
    make(tmp_path, *PATHS)
    os.symlink(tmp_path, tmp_path / "src" / "loop")
    monkeypatch.setattr(trees, "SUBTREES", subtrees)
    reader = TreeReader({"path": str(tmp_path)})
    found = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert sorted((r["path"], r["size"]) for r in found) == walked(tmp_path)


def test_reading_with_spark(spark, tmp_path):
    make(tmp_path, *PATHS)
    assert rows(read_tree(spark, str(tmp_path))) == walked(tmp_path)
    assert rows(read_tree(spark, f"file://{tmp_path}")) == walked(tmp_path)
    kept = [x for x in walked(tmp_path) if "node_modules" not in x[0] and not x[0].startswith("src/gen/")]
    assert rows(S.list_files(spark, str(tmp_path), ["/src/gen/", "none"])) == kept
    assert "gen" not in {x.split("/")[0] for x, _ in rows(S.list_files(spark, str(tmp_path), ["gen"]))}
    (tmp_path / "empty").mkdir()
    assert rows(read_tree(spark, str(tmp_path / "empty"))) == []
    (one,) = read_tree(spark, str(tmp_path)).where("path = 'a.java'").collect()
    assert abs(one.modified.timestamp() - os.path.getmtime(tmp_path / "a.java")) < 2 * 86400
    assert {r.path for r in S.scan(spark, f"file://{tmp_path}", ["gen"]).collect()} == {"a.java", "src/b.ts", "src/_c/.d.js"}
    with pytest.raises(ValueError):
        S.list_files(spark, str(tmp_path / "a.java"))


def test_filters_on_the_path_are_pushed(spark, tmp_path):
    make(tmp_path, *PATHS)
    with_filter = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(with_filter)
    spark.conf.set(with_filter, "true")
    try:
        df = read_tree(spark, str(tmp_path)).where(F.col("path").startswith("src/") & (F.col("size") > 0))
        assert rows(df) == [x for x in walked(tmp_path) if x[0].startswith("src/") and x[1] > 0]
        assert rows(read_tree(spark, str(tmp_path)).where("path in ('gen/g.java', 'a.java', 'none')")) == [x for x in walked(tmp_path) if x[0] in ("gen/g.java", "a.java")]
    finally:
        spark.conf.set(with_filter, before)


class Counted:
    """A file system of made-up directories, which counts what is listed."""

    def __init__(self, directories, files):
        self.directories, self.files, self.listed = directories, files, []

    def get_file_info(self, selector):
        self.listed.append(selector.base_dir)
        kind = arrow_fs.FileType
        depth = selector.base_dir.count("/") - 1
        dirs = [SimpleNamespace(type=kind.Directory, base_name=n, path=f"{selector.base_dir}/{n}") for n in self.directories(depth)]
        return dirs + [SimpleNamespace(type=kind.File, base_name=f"f{i}.java", path="", size=i, mtime=None) for i in range(self.files)]


def reader_over(fs, **options):
    reader = FilteredTreeReader({"path": "/root", **options})
    reader.fs = fs
    return reader


def test_a_million_paths_pass_in_batches():
    fs = Counted(lambda depth: [f"d{i}" for i in range(32)] if depth < 2 else [], 950)
    reader = reader_over(fs)
    parts = reader.partitions()
    planned = len(fs.listed)
    assert planned <= 40 and len(parts) > 500
    sizes = [b.num_rows for p in parts for b in reader.read(p)]
    assert sum(sizes) == 950 * (1 + 32 + 32 * 32) > 1_000_000 - 10_000 and max(sizes) <= trees.BATCH


def test_skipped_and_filtered_directories_are_never_entered():
    fs = Counted(lambda depth: ["src", "node_modules", "gen"] if depth < 4 else [], 1)
    reader = reader_over(fs, skip='["node_modules"]', placed='["src/gen"]')
    n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert n == len(set(fs.listed)) and not any("node_modules" in d or d.startswith("/root/src/gen") for d in fs.listed)
    for pushed, entered in ((StringStartsWith(("path",), "src/src/f"), {"/root", "/root/src", "/root/src/src"}), (EqualTo(("path",), "gen/f0.java"), {"/root", "/root/gen"}), (In(("path",), ("f0.java", None)), {"/root"})):
        fs = Counted(lambda depth: ["src", "node_modules", "gen"] if depth < 4 else [], 1)
        reader = reader_over(fs)
        assert list(reader.pushFilters([pushed])) == [pushed]
        for p in reader.partitions():
            list(reader.read(p))
        assert set(fs.listed) == entered
