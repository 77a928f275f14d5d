import os

import pytest

from codeloom.config import Settings
from codeloom.engine import DONE, Engine
from codeloom.plans import models as M
from tests.test_parse import JAVA, MAPPER

CONTROLLER = """package demo;
public class OrderController {
    private OrderService orderService;
    public void submit(Order o) {
        validate(o);
        orderService.save(o);
    }
    public void validate(Order o) {
        log(o);
        check(o);
    }
}
"""
REPO = """package demo;
public interface OrderRepo {
    Order findAll(int x);
    void insert(Order o);
}
"""


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in {"src/OrderService.java": JAVA, "src/OrderController.java": CONTROLLER, "src/OrderRepo.java": REPO, "src/OrderMapper.xml": MAPPER, "gen/Skipped.java": CONTROLLER, "build/X.java": JAVA}.items():
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_from_registering_to_searching(spark, repo, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/engine")
    rid = e.register_repo(repo, "orders", ["gen"])
    assert e.status(rid) == (0, "repo.status.not_indexed")
    with pytest.raises(RuntimeError):
        e.search(rid, "save")
    counts = e.index_repo(rid)
    assert counts["file_count"] == 4 and counts["edge_count"] >= 3
    assert e.register_repo(repo, "renamed") == rid and e.get_repo(rid)["indexed"] == DONE and e.get_repo(rid)["name"] == "renamed"
    ids = {(r.class_name, r.name, r.chunk_type): r.id for r in e.table("methods", rid).collect()}
    save, submit, insert = (ids[k] for k in (("OrderService", "save", "method"), ("OrderController", "submit", "method"), ("OrderRepo", "insert", "method")))
    edges = {(r.src, r.dst, r.edge_type) for r in e.table("edges", rid).collect()}
    assert {(submit, save, "CALLS"), (save, insert, "CALLS")} <= edges
    assert (ids["OrderRepo", "findAll", "method"], ids["OrderRepo", "findAll", "sql"], "IMPLEMENTS") in edges
    assert {(r.id, r.depth) for r in e.impact(rid, insert).collect()} == {(save, 1), (submit, 2)}
    assert [r.id for r in e.symbol_at(rid, "src\\OrderService.java", 6).collect()] == [save]
    found = e.search(rid, "save order").collect()
    assert found[0].symbol == "save" and e.history(rid).count() == 1
    assert e.call_path(rid, submit, insert).first().path == [submit, save, insert]
    assert {(r.from_class, r.to_class) for r in e.class_graph(rid).collect()} == {("OrderController", "OrderService"), ("OrderService", "OrderRepo")}
    assert e.similar_code(rid, save, 2).count() == 2 and e.call_context(rid, save).first().callers[0].name == "submit"
    assert e.method_graph(rid, save, 1).count() >= 3 and {r.chunk_type: r.n for r in e.stats(rid)["chunk_type"].collect()}["class"] == 0
    assert e.read_file(rid, "src/OrderRepo.java")["language"] == "java" and e.file_tree(rid).count() > 4 and e.logs(rid).count() == 1
    e.delete_history(rid, [1])
    assert e.history(rid).count() == 0
    e.index_repo(rid)
    assert e.table("methods", rid).count() == len(ids)
    e.delete_repo(rid)
    assert e.list_repos().count() == 0 and e.table("chunks", rid).count() == 0


def test_settings(spark, repo, tmp_path, monkeypatch):
    monkeypatch.setenv("CODELOOM_TOP_K", "3")
    assert Settings.from_env().top_k == 3
    with pytest.raises(PermissionError):
        Engine(spark, str(tmp_path), Settings(allowed_roots=(str(tmp_path),))).register_repo(repo)


def test_models(spark):
    queries = spark.createDataFrame([("1", "用户认证", "zh", "semantic"), ("2", "find user", "en", "symbol_lookup")], "query_id string, text string, language string, intent string")
    assert {r.query_id: r.expansion for r in M.expansions(queries, lambda p: ["user 认证 login a"] * len(p)).collect()} == {"1": "user login", "2": ""}
    assert {r.query_id: r.code for r in M.hypotheses(queries, lambda p: ["```java\nlogin(user, password)\n```"] * len(p)).collect()} == {"1": "login(user, password)", "2": ""}
    assert {r.expansion for r in M.expansions(queries).collect()} == {""}

    def down(prompts):
        raise OSError("down")

    assert {r.code for r in M.hypotheses(queries, down).collect()} == {""}
    rows = spark.createDataFrame([("a", "q", "1 | x", 3)], "id string, question string, listing string, n int")
    assert M.picked_symbols(rows, lambda p: ["2, 9, 3"]).first().picked == [2, 3]
    turns = spark.createDataFrame([(1, i, "user", "x") for i in range(30)], "conv_id bigint, turn bigint, role string, text string")
    assert M.legacy_messages(turns).count() == 20


def test_analysis_and_documents(spark, repo, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/engine")
    rid = e.register_repo(repo, "orders", ["gen"])
    before = e.get_repo(rid)["updated_at"]
    assert before is not None
    e.index_repo(rid)
    assert e.get_repo(rid)["updated_at"] > before and list(e.progress(rid, every=0)) == [DONE]
    found = e.search(rid, "save order", text_model=lambda prompts: ["orderRepo insert order save"] * len(prompts)).collect()
    save = next(r for r in found if r.symbol == "save")
    assert [c.name for c in save.callers] == ["submit"] and save.n_callers == 1 and {"insert"} <= {c.name for c in save.callees} and "{" in save.snippet
    prompts = []

    def model(asked):
        prompts.extend(asked)
        return ["an answer"] * len(asked)

    code = "\n".join(CONTROLLER.splitlines())
    events = e.analyze(rid, "custom", code, model, "src/OrderController.java", 4, 7, "what breaks if I change submit?", [{"role": "user", "text": "hello"}, {"role": "assistant", "text": "hi"}])
    assert [x["kind"] for x in events][0] == "intent" and [x["kind"] for x in events][-2:] == ["text", "done"]
    assert "submit" in prompts[-1] and "assistant: hi" in prompts[-1] and prompts[-1].endswith("change submit?")
    long = code + "\n// filler of a file that is too long to go whole" * 2000
    events = e.analyze(rid, "custom", long, model, "src/OrderController.java", 1, 9, "explain the validate method, please")
    (resolved,) = [x for x in events if x["kind"] == "smart_resolve"]
    assert len(resolved["symbols"]) == 1 and "validate" in prompts[-1] and "filler" not in prompts[-1]
    assert [x["kind"] for x in e.analyze(rid, "summary", code, model, "src/OrderController.java")] == ["intent", "text", "done"] and "class OrderController" in prompts[-1]

    def down(asked):
        raise OSError("down")

    assert e.analyze(rid, "bug", code, down, "a.java")[-1] == {"kind": "error", "message": "down"}
    for bad in (("nothing", code), ("bug", "  ")):
        with pytest.raises(ValueError):
            e.analyze(rid, *bad, model)
    docs = e.file_docs(rid, "src/OrderController.java", model)
    assert [x["kind"] for x in docs] == ["header", "progress", "text", "done"] and docs[2]["text"] == "an answer" and "public void submit" in prompts[-1]
    assert e.file_docs(rid, "src/OrderController.java", down)[-1]["kind"] == "error"


def test_a_writer_that_finds_its_version_taken(spark, repo, tmp_path, monkeypatch):
    e = Engine(spark, f"file://{tmp_path}/engine")
    rid = e.register_repo(repo, "first")
    versions, real = [0], Engine._version
    monkeypatch.setattr(Engine, "_version", lambda self: versions.pop() if versions else real(self))
    e._set(rid, indexed=3)  # believes that there is no version yet, finds the first taken, and goes on from it
    assert e.get_repo(rid)["indexed"] == 3 and e.get_repo(rid)["name"] == "first"
    os.makedirs(tmp_path / "engine/repos/v9")  # a writer that died
    assert e.get_repo(rid)["name"] == "first"
