import pytest
from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.queries.shapes import shape

METHODS = "id string, name string, class_name string, file_path string, chunk_type string, signature string, is_primary boolean"
EDGES = "src string, dst string, edge_type string, confidence double, call_count bigint"


def edges(spark, *pairs, kind="CALLS"):
    return spark.createDataFrame([(a, b, kind, 1.0, 1) for a, b in pairs], EDGES)


def methods(spark, *rows):
    return spark.createDataFrame([(i, n, c, f"{c}.java", t, "", True) for i, n, c, t in rows], METHODS)


def test_call_resolution(spark):
    m = methods(spark, ("1", "save", "S", "method"), ("2", "f", "U", "method"), ("3", "f", "U", "method"), ("7", "g", "C", "method"), ("9", "z", "", "method"))
    calls = spark.createDataFrame([("9", "U.f", 1), ("9", "x.save", 2), ("9", "x.f", 3), ("9", "f", 4), ("2", "f", 1), ("7", "C.g", 1)], "caller string, ref string, pos int")
    found = {(r.caller, r.ref, r.callee, round(r.confidence, 2)) for r in G.resolve_calls(calls, m).collect()}
    assert found == {("9", "U.f", "2", 0.5), ("9", "U.f", "3", 0.5), ("9", "x.save", "1", 1.0), ("9", "f", "2", 0.35), ("9", "f", "3", 0.35), ("2", "f", "3", 0.7)}


def test_edges_keep_first_confidence(spark):
    m = methods(spark, ("1", "save", "S", "method"), ("9", "z", "", "method"))
    calls = spark.createDataFrame([("9", "a.save", 1), ("9", "S.save", 2), ("9", "save", 3)], "caller string, ref string, pos int")
    (e,) = G.call_edges(G.resolve_calls(calls, m)).collect()
    assert (e.src, e.dst, e.call_count, e.confidence) == ("9", "1", 3, 1.0)


def test_pagerank(spark):
    m = methods(spark, *[(x, x, "C", "method") for x in "ABCD"])
    found = {r.id: r.pagerank for r in G.pagerank(m, edges(spark, ("A", "B"), ("A", "C"), ("B", "C"))).collect()}
    assert found == pytest.approx({"A": 0.15, "B": 0.21375, "C": 0.3954375, "D": 0.15})


def _ranks(ids, calls, damping=0.85, rounds=20):
    out, rank = {}, {i: 1.0 - damping for i in ids}
    for a, _ in calls:
        out[a] = out.get(a, 0) + 1
    for _ in range(rounds):
        given = {}
        for a, b in calls:
            given[b] = given.get(b, 0.0) + rank.get(a, 0.0) / out[a]
        rank = {i: 1.0 - damping + damping * given.get(i, 0.0) for i in ids}
    return rank


def test_pagerank_over_a_grid_equals_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(11)
    ids = [str(i) for i in range(300)]
    ends = [*ids[:200], "unknown", "other", "7", "7", "7"]  # 200 and beyond are isolated, unknown ends are no methods
    calls = [(rng.choice(ends), rng.choice(["7", *ends])) for _ in range(1500)] + [("3", "3"), ("3", "3"), ("4", "unknown")]
    calls += calls[:200]
    m = methods(spark, *[(x, x, "C", "method") for x in [*ids, *ids[:9]]])
    e = edges(spark, *calls).unionByName(edges(spark, ("250", "7"), kind="IMPLEMENTS"))
    monkeypatch.setattr(G, "LEAST_CELL", 100)
    for most, piece, side, rounds in ((8_000_000, 7, 4, 20), (50, 1000, 6, 2)):
        monkeypatch.setattr(G, "MOST_CELL", most)
        monkeypatch.setattr(G, "SLICE", piece)
        assert G._side(len(calls), 4) == side
        found = [(r.id, r.pagerank) for r in G.pagerank(m, e, rounds=rounds).collect()]
        assert len(found) == 300 and dict(found) == pytest.approx(_ranks(ids, calls, rounds=rounds), rel=1e-12)
    found = {r.id: r.pagerank for r in G.pagerank(m, e.limit(0), rounds=2).collect()}
    assert found == pytest.approx({i: 0.15 for i in ids})


def test_pagerank_shuffles_no_row_for_each_call(spark, monkeypatch):
    sc, at = spark.sparkContext, []

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    def watched(df, name, real=G.checkpointed):
        out = real(df, name)
        if name == "pagerank":
            at.append(written())
        return out

    monkeypatch.setattr(G, "checkpointed", watched)
    monkeypatch.setattr(G, "LEAST_CELL", 100, raising=False)
    m = methods(spark, *[(str(x), "f", "C", "method") for x in range(300)])
    e = edges(spark, *[(str(x), str(x * y % 300)) for x in range(300) for y in range(1, 11)])
    assert G.pagerank(m, e).count() == 300
    assert at[-1] - at[0] < 15 * 300  # fifteen rounds: fewer than a row a method, let alone a call


def test_impact(spark):
    m = methods(spark, *[(x, x, "C", "method") for x in "abcd"])
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"))
    targets = spark.createDataFrame([("c",)], "target string")
    ranks = m.select("id", F.lit(0.5).alias("pagerank"))
    assert {(r.id, r.depth) for r in G.impact(targets, m, e, ranks, 2).collect()} == {("b", 1), ("a", 2), ("d", 2)}


def test_paths_and_layers(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "c"))
    pairs = spark.createDataFrame([("a", "c"), ("c", "a"), ("a", "a")], "from_id string, to_id string")
    found = {(r.from_id, r.to_id): (r.path, r.found) for r in G.call_paths(pairs, e).collect()}
    assert found == {("a", "c"): (["a", "b", "c"], True), ("c", "a"): (None, False), ("a", "a"): (["a"], True)}
    m = methods(spark, *[(x, x, "C", "method") for x in "abcxq"])
    layers = {r.node: r.layer for r in G.layers(m, e, spark.createDataFrame([("b",)], "centre string"), 3).collect()}
    assert layers == {"a": -1, "b": 0, "c": 1, "x": 0, "q": 0}


def test_empty(spark):
    m, e = spark.createDataFrame([], METHODS), spark.createDataFrame([], EDGES)
    assert G.pagerank(m, e).count() == 0 and G.class_graph(m, e).count() == 0 and G.call_chain(m, e).count() == 0


def test_registered_queries_walk_as_deep_as_the_operators(spark, monkeypatch):
    from codeloom.queries import graph as Q

    ids = [str(i) for i in range(94, 101)]  # a chain of calls: 0 > 95 > 96 > ... > 100
    chain = [("0", "95"), *zip(ids[1:], ids[2:], strict=False)]
    edges = spark.createDataFrame([(a, b, "CALLS", 1.0, 1) for a, b in chain], "src string, dst string, edge_type string, confidence double, call_count long")
    names = sorted({n for e in chain for n in e})
    methods = spark.createDataFrame([(n, n, "", "f", "method", "s", 1, 2, True) for n in names], "id string, name string, class_name string, file_path string, chunk_type string, signature string, line_start int, line_end int, is_primary boolean")
    tables = {"edges": edges, "all_edges": edges, "methods": methods, "ranks": methods.selectExpr("id", "1.0D AS pagerank")}
    tables["targets"] = spark.createDataFrame([("0",), ("100",)], "target string")
    monkeypatch.setattr(Q, "shape", lambda s, d, name: tables[name])
    assert {(r.id, r.hop) for r in Q.join11(spark, "").where("target = '100'").collect()} == {("99", 1), ("98", 2), ("97", 3)}
    assert {(r.id, r.depth) for r in Q.ret15(spark, "").where("target = '100'").collect()} == {("99", 1), ("98", 2), ("97", 3)}
    assert [(r.path, r.path_length, r.found) for r in Q.join18(spark, "").where("from_id = '0'").collect()] == [("0>95>96>97>98>99>100", 6, True)]
    assert {r.node: r.layer for r in Q.ret18(spark, "").where("centre = '0'").collect()} == {"0": 0, "95": 1, "96": 2, "97": 3, "98": 4, "99": 5, "100": 0}


def test_many_centres(spark):
    from codeloom.operators import graph as G

    ids = spark.range(150).selectExpr("CAST(id AS STRING) AS id")
    edges = spark.createDataFrame([(str(i), str(i + 1), "CALLS") for i in range(149)], "src string, dst string, edge_type string")
    found = {(r.centre, r.node): r.layer for r in G.layers(ids, edges, ids.selectExpr("id AS centre"), 2).collect()}
    assert len(found) == 150 * 150
    assert all(layer == (int(n) - int(c) if abs(int(n) - int(c)) <= 2 else 0) for (c, n), layer in found.items())
    assert G.layers(ids, edges, ids.limit(0).selectExpr("id AS centre"), 2).count() == 0


def test_edges_by_groups_equal_edges_of_resolved_calls(spark):
    import random

    rng = random.Random(5)
    names, classes = ["f", "g", "h", "i", "A.f"], ["", "A", "B", "C"]
    m = methods(spark, *[(str(k), rng.choice(names), rng.choice(classes), "method") for k in range(40)], ("90", "lone", "A", "method"), ("90", "lone", "B", "method"), ("91", "only", "", "method"))
    refs = [*names, *[f"{c}.{n}" for c in ("A", "B", "v") for n in names], "v.only", "only", "x.lone", "none", "x.none"]
    calls = [(str(rng.choice([*range(40), 90, 91])), rng.choice(refs), rng.randint(1, 9)) for _ in range(600)]
    calls = spark.createDataFrame(calls + calls[:50], "caller string, ref string, pos int")
    resolved = G.resolve_calls(calls, m)
    rows = lambda df: sorted((r.src, r.dst, r.call_count, round(r.confidence, 12), r.edge_type) for r in df.collect())
    assert rows(G.resolved_edges(calls, m)) == rows(G.call_edges(resolved))
    per = {}
    for r in resolved.collect():
        per.setdefault((r.caller, r.ref, r.pos), []).append(r.confidence)
    assert all(abs(sum(v) - (1.0 if "." in k[1] else 0.7)) < 1e-9 for k, v in per.items())


def test_no_row_for_each_callee_is_shuffled(spark):
    m = methods(spark, *[(str(k), "f", "A", "method") for k in range(3)])
    calls = spark.createDataFrame([("9", "f", 1)], "caller string, ref string, pos int")
    assert "Window" not in G.resolve_calls(calls, m)._jdf.queryExecution().executedPlan().toString()


def test_paths_meet_half_way(spark, monkeypatch):
    import itertools
    import random

    rng = random.Random(8)
    nodes = [str(i) for i in range(30)]
    some = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(48)}
    written = []
    monkeypatch.setattr(G, "checkpointed", lambda df, name, real=G.checkpointed: written.append(real(df, name)) or written[-1])
    pairs = list(itertools.product(nodes[:8], nodes))
    for longest in (6, 3, 1):
        written.clear()
        found = {(r.from_id, r.to_id): r.path for r in G.call_paths(spark.createDataFrame(pairs, "from_id string, to_id string"), edges(spark, *some), longest).collect()}
        best = {}
        for a in nodes[:8]:
            level, seen = {a: [a]}, {}
            for _ in range(longest + 1):
                seen |= {n: p for n, p in level.items() if n not in seen}
                level = {n: min(p + [n] for m, p in level.items() if (m, n) in some) for n in {y for x, y in some if x in level} - set(seen)}
            best |= {(a, n): seen.get(n) for n in nodes}
        assert found == best
        assert max((len(r.path) for w in written if "path" in w.columns for r in w.collect()), default=0) <= -(-longest // 2) + 1


def test_starts_walk_together(spark, monkeypatch):
    import random

    rng = random.Random(3)
    nodes = [str(i) for i in range(90)]
    some = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(150)]
    written = []
    monkeypatch.setattr(G, "checkpointed", lambda df, name, real=G.checkpointed: written.append((name, real(df, name))) or written[-1][1])
    starts = spark.createDataFrame([(s, n) for i, s in enumerate(nodes) for n in {s, nodes[i // 2]}], "start string, node string")
    for backwards in (True, False):
        want = {}
        for s, n in starts.collect():
            level = {n}
            for hop in range(1, 5):
                level = {a if backwards else b for a, b in some if (b if backwards else a) in level}
                want |= {(s, x): min(hop, want.get((s, x), 9)) for x in level}
        written.clear()
        found = [(r.start, r.node, r.hop) for r in G.reach(starts, edges(spark, *some, *some[:20]), 4, backwards).collect()]
        assert sorted(found) == sorted((s, x, hop) for (s, x), hop in want.items())
        # 90 starts are two or three words: a round has a row a node and word, not one a node and start.
        assert max(df.count() for name, df in written if name == "reach") <= 3 * len(nodes) < len(found)


def test_only_links_of_the_starts_are_made(spark):
    edges(spark, ("a", "b"), ("c", "d"), ("e", "a"), kind="IMPLEMENTS").createOrReplaceTempView("made_links")
    made = spark.sql("SELECT DISTINCT src, dst, edge_type FROM made_links")
    own = spark.createDataFrame([("a", "a")], "start string, node string")
    out = G.with_peers(own, made)
    assert sorted((r.start, r.node) for r in out.collect()) == [("a", "a"), ("a", "b"), ("a", "e")]
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "LeftSemi" in line:
            assert any("Aggregate [src" in other and depth(other) < depth(line) for other in lines[:i])
    assert sum("LeftSemi" in line for line in lines) == 2


def test_impact_counts_degrees_of_placed_rows_alone(spark):
    m = methods(spark, *[(x, x, "C", "method") for x in "abcdef"])
    e = edges(spark, ("a", "b"), ("b", "c"), ("d", "b"), ("e", "a"), ("f", "a"), ("a", "f"))
    ranks = m.select("id", F.lit(0.5).alias("pagerank"))
    out = G.impact(spark.createDataFrame([("c",)], "target string"), m, e, ranks, 2, 2)
    assert [(r.id, r.in_degree, r.depth, r.place) for r in out.orderBy("place").collect()] == [("b", 2, 1, 1), ("a", 2, 2, 2)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(out.select("target", "place", "id"))
    assert "Join LeftSemi" in plan(out)


def test_induced_edges_are_made_of_the_nodes_alone(spark, tmp_path):
    spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c")], "group string, id string").write.parquet(f"{tmp_path}/nodes")
    edges(spark, ("a", "b"), ("b", "c"), ("c", "c"), ("b", "b")).createOrReplaceTempView("made_edges")
    made = spark.sql("SELECT src, dst, edge_type, min(confidence) AS confidence, count(*) AS call_count FROM made_edges GROUP BY 1, 2, 3")
    out = G.induced(spark.read.parquet(f"{tmp_path}/nodes"), made)
    assert sorted((r.group, r.src, r.dst) for r in out.collect()) == [("g", "a", "b"), ("g", "b", "b"), ("h", "c", "c")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and plan.index("Aggregate [src") < plan.index("LeftSemi")


@pytest.mark.parametrize(("piece", "few"), [(2, 100_000), (2, 0), (4_000_000, 100_000)])
def test_references_of_shared_names_go_in_pieces(spark, monkeypatch, piece, few):
    monkeypatch.setattr(G, "PIECE", piece)
    monkeypatch.setattr(G, "FEW", few)
    m = spark.createDataFrame([(str(i), "f" if i < 7 else f"g{i}", "C" if i % 2 else "", "method", True) for i in range(10)], "id string, name string, class_name string, chunk_type string, is_primary boolean")
    calls = [(str(i % 10), ref, i) for i in range(20) for ref in ("f", "C.f", "x.g8", "x.f", "h", None)]
    found = G.resolve_calls(spark.createDataFrame(calls * 2, "caller string, ref string, pos int"), m, digits=3)
    ends = {"f": range(7), "C.f": (1, 3, 5), "x.g8": (8,)}
    want = [(c, ref, pos, str(i)) for c, ref, pos in calls for i in ends.get(ref, ()) if str(i) != c]
    share = lambda r: round((1.0 if "." in r.ref else 0.7) / (2 * sum(x[:3] == (r.caller, r.ref, r.pos) for x in want)), 3)
    rows = found.collect()
    assert sorted((r.caller, r.ref, r.pos, r.callee) for r in rows) == sorted(want * 2)
    assert all(r.confidence == share(r) for r in rows)


@pytest.mark.parametrize("name", ["join3_call_resolution", "agg7_call_edges"])
def test_methods_do_not_go_through_the_driver(spark, name):
    from codeloom.queries.graph import QUERIES

    methods, calls = (shape(spark, "/root/testdata/sf0.001", x) for x in ("methods", "calls"))
    assert "Broadcast" not in calls._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in G.resolved_edges(calls, methods)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in G._references(calls, G.name_map(methods))._jdf.queryExecution().executedPlan().toString()
    assert "round" not in QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
