from pyspark.sql import functions as F

from codeloom.operators import retrieval as R
from codeloom.plans import search as P

ROWS = [("a", "alpha beta saveOrder", "f", "1", 1, 2, "x"), ("b", "gamma beta", "g", "2", 1, 2, "x"), ("c", "delta", "h", "", 1, 2, "x")]
CHUNKS = "id string, text string, file_path string, symbol_id string, line_start int, line_end int, language string"


def test_texts_are_cut_once(spark):
    index = P.index_of(spark.createDataFrame(ROWS, CHUNKS))
    one = spark.createDataFrame(ROWS, CHUNKS).select(R.bm25_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    assert count(index) == count(one) > 0
    assert {r.id: list(r.vector) for r in index.collect()} == {r.id: list(r.v) for r in spark.createDataFrame(ROWS, CHUNKS).select("id", R.hashed_embedding(F.col("text")).alias("v")).collect()}


def test_nodes_are_asked_for_candidates_alone(spark):
    index = P.index_of(spark.createDataFrame(ROWS, CHUNKS))
    nodes = spark.createDataFrame([("1", "saveOrder", 0.5, 3), ("2", "beta", 0.9, 1), ("9", "other", 9.0, 9)], "id string, name string, pagerank double, in_degree int")
    asked = P.intents(spark.createDataFrame([("q", "beta saveOrder"), ("r", "delta")], "query_id string, text string"))
    seen = []

    def some(ids):
        seen.extend(r.id for r in ids.collect())
        return nodes.join(ids, "id", "left_semi")

    rows = lambda n: sorted((r.query_id, r.id, r.score, r.place) for r in P.search(asked, index, n, 2).collect())
    assert rows(some) == rows(nodes)
    assert sorted(seen) in (["", "1", "2"], ["1", "2"])
