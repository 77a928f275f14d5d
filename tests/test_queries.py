import pytest

from codeloom import queries
from tests.oracle import connect, same_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, con, name):
    same_rows(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_fiftieth_vector_is_a_query(spark):
    from codeloom.queries.retrieval import asked

    ids = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    assert {int(r.query_id) for r in asked(spark, SF).collect()} == {i for i in ids if i % 50 == 0}


def test_prompts_hold_the_whole_text(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    prompts = {r.id: r.prompt for r in queries.queries()["llm4_prompts"](spark, SF).collect()}
    assert max(map(len, texts.values())) > 200
    assert all(prompts[i].endswith(t) for i, t in texts.items() if len(t) < 72000)


def test_hypotheses_bring_documents_of_their_own(spark):
    from codeloom.plans import search as P

    rows = [("a", "alpha beta", "f", "", 1, 2, "x"), ("b", "gamma delta", "g", "", 1, 2, "x")]
    index = P.index_of(spark.createDataFrame(rows, "id string, text string, file_path string, symbol_id string, line_start int, line_end int, language string"))
    texts = spark.createDataFrame([("q", "gamma delta"), ("r", " ")], "query_id string, text string")
    assert [(r.query_id, r.id) for r in P.by_generated_text(texts, index, 1).collect()] == [("q", "b")]
    asked = P.intents(spark.createDataFrame([("q", "alpha beta")], "query_id string, text string"))
    score = lambda **more: {r.id: r.score for r in P.search(asked, index, None, 2, **more).collect()}
    assert score(hypotheses=texts.selectExpr("query_id", "text AS code"))["b"] > score().get("b", 0)
