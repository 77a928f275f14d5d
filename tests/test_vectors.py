"""The vector index and collections, against the full scan."""

import json

import numpy as np
import pytest

from codeloom.operators.retrieval import dense_search
from codeloom.operators.vectors import VectorIndex, centres, probes_for
from codeloom.queries.retrieval import asked, points
from codeloom.sources.tables import Collection

SF = "/root/testdata/sf0.01"
SCHEMA = "id string, vector array<double>"


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.id] = r.score
    return out


def recall(got, want):
    return sum(len(set(want[q]) & set(got.get(q, ()))) for q in want) / sum(map(len, want.values()))


def random_points(spark, n, dim, seed=1, prefix="p"):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return [(f"{prefix}{i}", [float(x) for x in row]) for i, row in enumerate(v)]


def test_recall_over_every_fiftieth_vector(spark, tmp_path):
    index = VectorIndex.build(points(spark, SF), f"file://{tmp_path}/ix")
    want = found(dense_search(asked(spark, SF), points(spark, SF), 10))
    got = found(index.search(asked(spark, SF), 10))
    assert recall(got, want) >= 0.9
    assert all(score == want[q][i] for q in got for i, score in got[q].items() if i in want[q])  # scores are exact
    cost = index.cost(asked(spark, SF))
    assert cost["pairs"] < 0.8 * cost["all_pairs"] and cost["all_points"] == points(spark, SF).count()
    assert found(index.search(asked(spark, SF), 10, share=1.0, oversample=1000)) == want


def test_vectors_in_groups_are_found_in_few_lists(spark, tmp_path):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 16)) * 4
    rows = [(f"p{i}", [float(x) for x in middle[i % 40] + rng.normal(size=16) * 0.3]) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex.build(df, f"file://{tmp_path}/ix")
    queries = df.where("substring(id, -1, 1) = '7'").withColumnRenamed("id", "query_id")
    cost = index.cost(queries)
    assert recall(found(index.search(queries, 10)), found(dense_search(queries, df, 10))) >= 0.9
    assert cost["pairs"] < 0.2 * cost["all_pairs"]


def test_odd_vectors_and_a_hot_list(spark, tmp_path):
    rows = random_points(spark, 300, 8) + [(f"same{i}", [1.0, 2.0] * 4) for i in range(700)]
    rows += [("null", None), ("zero", [0.0] * 8), ("nan", [float("nan")] + [1.0] * 7), ("inf", [float("inf")] * 8), ("hole", [None] + [1.0] * 7), ("tiny", [1e-200] * 8), ("huge", [1e200] * 8), ("p1", [2.0] * 8), (None, [3.0] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", list string")
    index = VectorIndex.build(df, f"file://{tmp_path}/ix", block=64)
    assert index.points == 1004
    blocks = index.blocks(list(range(index.lists))).selectExpr("list", "block", "size(ids) n").collect()
    assert sum(b.n for b in blocks) == 1004 and max(b.n for b in blocks) <= 64 and len({b.block for b in blocks}) == len(blocks)
    queries = spark.createDataFrame([("a", [1.0, 2.0] * 4), ("b", [1.0] * 8), ("c", None), ("d", [0.0] * 8)], "query_id string, vector array<double>")
    got = found(index.search(queries, 5, share=1.0, oversample=300))
    assert sorted(got) == ["a", "b"] and list(got["a"].values()) == [1.0] * 5 and {"tiny", "huge", "p1"} <= set(got["b"])
    empty = VectorIndex.build(df.limit(0), f"file://{tmp_path}/none")
    assert empty.search(queries, 5).count() == 0
    one = VectorIndex.build(df.where("id = 'p1'").limit(1), f"file://{tmp_path}/one")
    assert len(found(one.search(queries, 5))["b"]) == 1
    with pytest.raises(ValueError):
        VectorIndex.build(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], SCHEMA), f"file://{tmp_path}/x")


def test_centres_and_probes():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(500, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    at = centres(v, 20)
    assert at.shape == (20, 6) and np.allclose(np.linalg.norm(at, axis=1), 1)
    assert 1 <= probes_for(v, at, 0.5) <= probes_for(v, at, 0.95) <= 20
    assert probes_for(v[:1], v[:1], 0.95) == 1
    assert np.isfinite(centres(np.tile(v[:1], (50, 1)), 4)).all()


@pytest.fixture
def collection(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c")
    c.create(3)
    return c


def rows_of(c):
    return sorted((r.id, list(r.vector), r.label) for r in c.points("id string, vector array<double>, label string").collect())


def made(spark, *rows):
    return spark.createDataFrame([(i, [float(x) for x in v], label) for i, v, label in rows], "id string, vector array<double>, label string")


def test_points_are_kept_by_id(spark, collection):
    c = collection
    assert rows_of(c) == [] and c.info()["points"] == 0
    assert c.write(made(spark, ("a", (1, 0, 0), "x"), ("b", (0, 1, 0), "y")), "label") == 1
    c.write(made(spark, ("b", (0, 0, 1), "z"), ("c", (1, 1, 0), "x"), ("c", (1, 1, 0), "x")), "label")
    assert rows_of(c) == [("a", [1, 0, 0], "x"), ("b", [0, 0, 1], "z"), ("c", [1, 1, 0], "x")] and c.info()["points"] == 3
    c.delete(spark.createDataFrame([("a",), ("none",)], "id string"))
    c.write(made(spark, ("a", (5, 5, 5), "x")), "label")
    c.delete(spark.createDataFrame([("c",)], "id string"))
    want = [("a", [5, 5, 5], "x"), ("b", [0, 0, 1], "z")]
    assert rows_of(c) == want
    assert c.compact("id string, vector array<double>, label string", "label") == 6 and len(c.commits()) == 1
    assert rows_of(c) == want
    c.write(made(spark, ("b", (7, 7, 7), "w")), "label")
    assert rows_of(c) == [("a", [5, 5, 5], "x"), ("b", [7, 7, 7], "w")]


def test_a_write_that_dies_or_comes_second_leaves_nothing(spark, collection, monkeypatch):
    c = collection
    c.write(made(spark, ("a", (1, 0, 0), "x")))
    with monkeypatch.context() as m:
        m.setattr(Collection, "_commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            c.write(made(spark, ("a", (9, 9, 9), "y"), ("b", (1, 1, 1), "y")))
    assert rows_of(c) == [("a", [1, 0, 0], "x")]
    with monkeypatch.context() as m:
        m.setattr(Collection, "_last", lambda self: 0)  # another writer has made commit 1 meanwhile
        with pytest.raises(Exception, match="(?i)exist"):
            c.write(made(spark, ("a", (9, 9, 9), "y")))
    assert rows_of(c) == [("a", [1, 0, 0], "x")] and [x["number"] for x in c.commits()] == [1]


def test_search_sees_what_came_and_went_after_the_index(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c")
    c.create(8)
    rows = random_points(spark, 200, 8)
    c.write(spark.createDataFrame(rows, SCHEMA))
    index = c.build_index(lists=1)
    queries = spark.createDataFrame(rows[::20], SCHEMA).withColumnRenamed("id", "query_id")
    assert found(c.search(queries, 5)) == found(c.search(queries, 5, exact=True)) and index.lists == 1
    c.write(spark.createDataFrame([("p0", rows[20][1]), ("new", rows[0][1])], SCHEMA))
    c.delete(spark.createDataFrame([("p40",)], "id string"))
    got = found(c.search(queries, 5))
    assert got == found(c.search(queries, 5, exact=True))
    assert got["p0"]["new"] == 1.0 and "p0" not in got["p0"] and got["p20"]["p0"] == 1.0 and "p40" not in got["p40"]
    c.compact(SCHEMA)
    assert found(c.search(queries, 5)) == got
    c.build_index(lists=1)
    assert found(c.search(queries, 5)) == got
    assert json.loads(spark.read.parquet(f"{c.path}/settings").first().settings)["quantile"] == 0.99
