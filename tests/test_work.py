"""Tables that are written and read again, and how rows are dealt."""

import numpy as np
from pyspark.sql import functions as F

from codeloom.operators import retrieval as R
from codeloom.sources.work import spread


def test_one_group_of_rows_is_dealt_to_all_cores(spark, tmp_path):
    """A file of one group of rows comes in many pieces of bytes, of which one has all the rows."""
    spark.range(20000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(f"file://{tmp_path}/one")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        pieces = spread(spark.read.parquet(f"file://{tmp_path}/one")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(r["count"] for r in pieces) == 20000 and max(r["count"] for r in pieces) < 10000


def test_the_best_places_are_those_of_a_whole_sort():
    rng = np.random.default_rng(3)
    for scores in (np.round(rng.random((50, 300)), 1), np.where(rng.random((50, 300)) < 0.9, -np.inf, 1.0), np.zeros((4, 90)), rng.random((0, 90)), rng.random((3, 5))):
        for k in (1, 7, 21):
            assert (R._first_of(scores, k) == np.argsort(-scores, axis=1, kind="stable")[:, :k]).all()
    odd = np.array([[np.nan, 0.5] * 20])
    assert R._first_of(odd, 3).tolist() == [[1, 3, 5]] and R._first_of(odd, 21)[0, -1] == 0


def test_dense_scores_are_made_in_parts(spark, monkeypatch):
    rows = [(f"p{i:03d}", [float(i % 7), 1.0, float(i % 3)]) for i in range(200)]
    points = spark.createDataFrame(rows, "id string, vector array<double>")
    whole = sorted(map(tuple, R.dense_search(points.withColumnRenamed("id", "query_id"), points, 5).collect()))
    monkeypatch.setattr(R, "SCORES_TOGETHER", 300)
    assert sorted(map(tuple, R.dense_search(points.withColumnRenamed("id", "query_id"), points, 5).collect())) == whole


def test_postings_are_cut_on_all_cores(spark):
    docs = spark.range(1000).select(F.col("id"), F.concat(F.lit("some word"), "id").alias("text")).coalesce(1)
    made = R.postings(docs).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in made) == 3000 - 1000 and max(r["count"] for r in made) < 1000


def test_shared_tokens_are_counted_without_a_row_for_each_pair(spark):
    kind = "id string, weights map<string,double>"
    docs = spark.createDataFrame([(f"p{i}", {"a": 0.0} | {f"t{i % 5}": 2.0}) for i in range(40)] + [("none", {}), ("null", None)], kind)
    queries = spark.createDataFrame([("q", {"a": 9.0, "t1": 0.0}), ("r", {"t1": 1.0, "t2": 1.0}), ("s", {"z": 1.0}), ("t", None)], kind).withColumnRenamed("id", "query_id")
    made = R.shared_tokens(queries, docs)
    assert sorted(map(tuple, made.collect())) == [("q", 40, 48), ("r", 16, 16)]
