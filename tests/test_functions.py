import os

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import retrieval as R
from codeloom.plans import chat as C
from codeloom.sources import files as S


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_text_functions(spark):
    assert one(spark, T.split_identifier, "processHTTPRequestId", "get_order_id", "a_bc") == [["process", "http", "request", "id"], ["get", "order", "id"], ["bc"]]
    assert one(spark, T.query_language, "ユーザー認証", "用户认证", "find user", "12345", "", None) == ["ja", "zh", "en", "mixed", "en", "en"]
    assert one(spark, T.search_intent, "who calls save", "impact of save", "getUser", "用户登录在哪实现") == ["call_chain", "impact", "symbol_lookup", "semantic"]
    assert one(spark, T.chat_intent, "any similar code?", "find the bug", "hello") == ["similar", "bug", "chat"]
    assert one(spark, T.estimate_tokens, "0123456789") == [3]
    assert one(spark, lambda c: T.confidence(F.lit("bug"), c), "[{}]", "[]", "x") == [0.95, 0.75, 0.5]
    assert one(spark, lambda c: T.confidence(F.lit("summary"), c), "```" + "x" * 297) == [0.75]
    assert one(spark, T.parse_list, " a, b/c \n,d") == [["a", "b/c", "d"]]
    assert one(spark, lambda c: T.picked_numbers(c, F.lit(5)), "1, 3，9 x 5") == [[1, 3, 5]]
    assert one(spark, T.clean_hypothesis, "```java\nint x = 12345;\n```", "```\nx\n```") == ["int x = 12345;", ""]


def test_locale(spark):
    rows = spark.createDataFrame([("ja", "zh", None), (None, None, "fr, zh-CN"), (None, None, None), ("xx", None, "en-US")], "q string, h string, a string")
    assert [r[0] for r in rows.select(T.locale(F.col("q"), F.col("h"), F.col("a"))).collect()] == ["ja", "zh", "en", "en"]


def test_file_rules(spark):
    rows = spark.createDataFrame([("pom.xml", 10), ("UserMapper.xml", 10), ("app.xml", 10), ("jquery-3.6.0.js", 10), ("x.min.js", 10), ("A.java", 500001), ("B.java", 10)], "path string, size bigint")
    assert [r[0] for r in rows.select(S.is_indexable(F.col("path"), F.col("size"))).collect()] == [False, True, False, False, False, False, True]
    assert one(spark, lambda c: S.in_custom_dir(c, ["gen", "a/b"]), "x/gen/f", "a/b/f", "a/b/c/f", "a/bc/f") == [True, True, True, False]


def test_scan(spark, tmp_path):
    for name, text in {"a/_x.js": b"function f() {\n  g();\n}\n", "node_modules/y.js": b"x", "b/T.java": "class T { String s = \"é\"; }".encode("latin-1"), "skip/me/Z.java": b"class Z {}"}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(text)
    rows = {r.path: (r.language, r.encoding) for r in S.scan(spark, str(tmp_path), ["skip/me"]).collect()}
    assert set(rows) == {"a/_x.js", "b/T.java"} and rows["a/_x.js"] == ("javascript", "utf-8") and rows["b/T.java"][1] != "utf-8"
    assert S.read_one(str(tmp_path), "a/_x.js")["line_count"] == 4
    with pytest.raises(PermissionError):
        S.read_one(str(tmp_path), "../x")
    with pytest.raises(ValueError):
        S.checked_root("relative")


def test_rrf(spark):
    rows = spark.createDataFrame([("q", "dense", x, s) for x, s in (("a", 0.9), ("b", 0.8), ("c", 0.7))] + [("q", "sparse", x, s) for x, s in (("b", 9.0), ("d", 8.0))], "query_id string, channel string, id string, score double")
    assert {r.id: r.score for r in R.rrf(rows).collect()} == pytest.approx({"b": 0.032522, "a": 0.016393, "d": 0.016129, "c": 0.015873})


def test_final_scores(spark):
    schema = "query_id string, id string, rrf double, graph_score double, symbol_score double, struct_score double, rerank double"
    plain = spark.createDataFrame([("q", "a", 1.0, 0.5, 1.0, 0.5, None)], schema)
    assert R.final_scores(plain).first().score == pytest.approx(0.875)
    ranked = spark.createDataFrame([("q", "a", 0.5, 0.5, 0.7, 1.0, 0.8), ("q", "b", 1.0, 0.0, 0.0, 0.0, None)], schema)
    assert {r.id: r.score for r in R.final_scores(ranked).collect()}["a"] == pytest.approx(0.706)


def test_overlaps(spark):
    rows = [("q", "1", 0.9, "s", "f", 1, 10), ("q", "2", 0.8, "t", "f", 8, 12), ("q", "3", 0.7, "u", "f", 7, 12), ("q", "4", 0.6, "v", "f", 10, 20), ("q", "5", 0.5, "s", "g", 1, 2)]
    df = spark.createDataFrame(rows, "query_id string, id string, score double, symbol_id string, file_path string, line_start int, line_end int")
    assert sorted(r.id for r in R.deduplicate(df).collect()) == ["1", "4"]


def test_history(spark):
    turns = [(1, i, r, "x" * n) for i, (r, n) in enumerate([("user", 30), ("assistant", 30), ("system", 30), ("user", 30), ("assistant", 30)])]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    assert sorted(r.turn for r in C.trim_history(df, 30).collect()) == [2, 3, 4]
    long = spark.createDataFrame([(1, 0, "user", "q" * 30), (1, 1, "assistant", "a" * 3000)], df.schema)
    found = {r.role: len(r.text) for r in C.trim_history(long, 200).collect()}
    assert found == {"user": 30, "assistant": 190 * 3 + len(C.CUT_MARK)}


def test_stream_of_events(spark):
    from codeloom.streaming.events import windowed_counts

    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    query = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == 1000


def test_collections_and_retries(spark, tmp_path):
    import pytest

    from codeloom.sources import tables as T

    c = T.Collection(spark, f"file://{tmp_path}/points")
    with pytest.raises(KeyError):
        c.info()
    c.create(2, m=8)
    c.create(2)
    with pytest.raises(ValueError):
        c.create(3)
    points = spark.createDataFrame([("a", [1.0, 2.0], "x"), ("b", [0.0, 1.0], "y")], "id string, vector array<double>, label string")
    c.write(points, "label")
    assert c.info() == {"distance": "cosine", "m": 8, "ef_construct": 128, "quantization": "int8", "quantile": 0.99, "dim": 2, "points": 2}
    with pytest.raises(ValueError):
        c.write(spark.createDataFrame([("c", [1.0], "x")], points.schema))
    assert {r.id for r in c.points(points.schema).where("label = 'x'").collect()} == {"a"}
    c.drop()
    assert not c.exists()
    tries = []

    def fails_twice():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")

    T.with_retries(fails_twice, wait=0.01)
    assert len(tries) == 3
    with pytest.raises(OSError):
        T.with_retries(lambda: (_ for _ in ()).throw(OSError("down")), wait=0.01)
    log = spark.createDataFrame([(5, "old")], "id bigint, query string")
    new = spark.createDataFrame([(x,) for x in ["d", "a", "c", "b", "a"]], "query string")
    assert sorted((r.id, r.query) for r in T.appended(log, new).collect()) == [(5, "old"), (6, "a"), (7, "a"), (8, "b"), (9, "c"), (10, "d")]


def test_postings_are_kept_and_dropped(spark, tmp_path):
    from codeloom.operators import retrieval as R

    path = f"file://{tmp_path}/bm25"
    docs = spark.createDataFrame([("1", "alpha beta"), ("2", "beta gamma")], "id string, text string")
    assert R.load_postings(spark, path) is None
    R.save_postings(docs, path)
    assert sorted((r.id, r.token, r.n_tokens) for r in R.load_postings(spark, path).collect()) == sorted((r.id, r.token, r.n_tokens) for r in R.postings(docs).collect())
    R.drop_postings(spark, path)
    assert R.load_postings(spark, path) is None


def test_names_in_questions(spark, monkeypatch):
    import random

    from codeloom.plans import chat as C

    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abAB_é") for _ in range(rng.randint(1, 6))) for _ in range(300)} | {"İx", "getUser", "GETUSER"})
    texts = [(c, t, None if c == 9 else "".join(rng.choice("abAB_é ") for _ in range(rng.randint(0, 60)))) for c in range(12) for t in range(3)] + [(20, 1, "What does getUser do?"), (21, 1, ""), (22, 1, "i̇x")]
    questions = spark.createDataFrame(texts, "conv_id bigint, turn int, text string")
    symbols = spark.createDataFrame([(n, "x") for n in [*names, names[0], "", None]], "name string, text string").repartition(3)
    want = set()
    for c, t, text in texts:
        hits = sorted((n for n in names if text is not None and n.lower() in text.lower()), key=lambda n: (-len(n), n))[:5]
        want |= {(c, t, n, k + 1) for k, n in enumerate(hits)}
    for together, chars in ((200_000, 32_000_000), (7, 100)):
        monkeypatch.setattr(C, "NAMES_TOGETHER", together)
        monkeypatch.setattr(C, "QUESTION_CHARS", chars)
        assert {tuple(r) for r in C.match_symbols(questions, symbols).collect()} == want
    assert C.match_symbols(questions, symbols.limit(0)).count() == 0 and C.match_symbols(questions.limit(0), symbols).count() == 0
