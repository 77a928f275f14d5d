from codeloom.operators.parse import annotations, brace_end, has_body, is_trivial, leading_comment, mapper_chunks, parse_chunks, parse_files, regex_chunks, symbols, windows

JAVA = """package demo;
public class OrderService {
    private OrderRepo repo;
    // stores an order
    public void save(Order o) {
        repo.insert(o);
        check(o);
    }
    public Order getLast() {
        return last;
    }
}
"""
MAPPER = """<mapper namespace="demo.OrderRepo">
  <sql id="cols">id, total</sql>
  <select id="findAll" resultType="Order">
    select <include refid="cols"/> from orders
  </select>
</mapper>
"""


def test_java():
    (c,) = parse_chunks(JAVA, "java", "a/OrderService.java")
    assert (c.class_name, c.symbol, c.line_start, c.line_end, c.calls) == ("OrderService", "save", 4, 8, ["OrderRepo.insert", "check"])
    assert "[COMMENT] stores an order" in c.text and c.signature == "public void save(Order o)"


def test_mapper():
    a, b = mapper_chunks(MAPPER, "m/OrderMapper.xml")
    assert (a.symbol, a.class_name, a.line_start, a.line_end, a.calls) == ("cols", "OrderRepo", 2, 2, [])
    assert (b.symbol, b.line_start, b.line_end, b.calls, b.signature) == ("findAll", 3, 5, ["cols"], "<select id='findAll'> resultType=Order")
    assert mapper_chunks("<a/>", "x") == []


def test_typescript():
    text = """import { UserApi as Api } from './x';
export async function load(a) {
  const r = await Api.get(a);
  return new Foo(r);
}
class Store {
  private api: UserApi;
  constructor(private repo: Repo) {}
  async save(x) {
    this.repo.put(x);
    this.api.send(x);
  }
}
const add = (a, b) => {
  return sum(a, b);
};
"""
    found = {c.symbol: (c.class_name, c.calls) for c in parse_chunks(text, "typescript", "s.ts")}
    assert found == {"load": ("", ["UserApi.get", "Foo"]), "save": ("Store", ["Repo.put", "UserApi.send"]), "add": ("", ["sum"])}


def test_small_rules():
    assert is_trivial("getX", "int getX() {\n return x;\n}") and not is_trivial("isX", "int isX() {\n return x;\n}") and not is_trivial("getX", "int getX() {\n return f(x);\n}")
    assert annotations("\n".join(f"@A{i}" for i in range(7))) == ["@A0", "@A1", "@A2", "@A3", "@A4"]
    assert leading_comment("/** one\n * two\n */\n@X\n// three\n// four\nint f()") == "one two three"
    assert has_body("int f() {\n a();\n}", "java") and not has_body("int f() {\n}", "java")
    assert brace_end(['a {', ' "}"', "}"], 0, 2) == 2


def test_windows_and_long_methods():
    body = "\n".join(f"        call{i}(a, b, c, d);" for i in range(400))
    text = f"class A {{\n    void big(int a) {{\n{body}\n    }}\n}}\n"
    chunks = parse_chunks(text, "java", "A.java")
    assert len(chunks) > 1 and [c.is_primary for c in chunks] == [True] + [False] * (len(chunks) - 1)
    assert {(c.method_line_start, c.method_line_end) for c in chunks} == {(2, 403)} and all("[METHOD] big" in c.text for c in chunks)
    assert windows("}\n}\n// x\n") == [] and windows("") == []
    assert parse_chunks("a: 1\nb: 2", "yaml", "x.yaml")[0].chunk_type == "block"
    assert regex_chunks("public void run(int a) {\n  go();\n}\n", "java", "x")[0].symbol == "run"


def test_parse_files(spark):
    files = spark.createDataFrame([("r", "A.java", "java", JAVA), ("r", "OrderMapper.xml", "xml", MAPPER), ("r", "e.java", "java", None)], "repo_id string, path string, language string, source string")
    rows = parse_files(files)
    assert sorted(r.name for r in symbols(rows).collect()) == ["cols", "findAll", "save"]
    assert rows.select("symbol_id").distinct().count() == 3


def test_tokens_of_a_long_file_share_their_strings():
    from codeloom.operators.syntax import Tokens

    t = Tokens("step(one, two);\n" * 3000, script=False)
    assert t.n == 21000 and len({id(x) for x in t.x}) == 8
    assert t.start.itemsize == 8 and len(t.broken) == t.n + 1 and t.broken[7] and not t.broken[8]


def test_a_files_chunks_leave_in_several_batches(spark, monkeypatch):
    from codeloom.operators import parse as P

    monkeypatch.setattr(P, "MOST_ROWS", 3)
    monkeypatch.setattr(P, "MOST_CHARS", 10**9)
    methods = "".join(f"    void m{i}() {{\n        go();\n        f();\n    }}\n" for i in range(10))
    rows = parse_files(spark.createDataFrame([("r", "A.java", "java", f"class A {{\n{methods}}}\n")], "repo_id string, path string, language string, source string")).collect()
    assert [(r.pos, r.symbol, r.calls) for r in sorted(rows, key=lambda r: r.pos)] == [(i, f"m{i}", ["go", "f"]) for i in range(10)]


def test_few_bytes_of_much_work_are_dealt_to_all_cores(spark):
    from codeloom.queries import parsing as Q

    least = 4 * spark.sparkContext.defaultParallelism
    frames = [Q.sources(spark, "/root/testdata/sf0.001", "long"), Q.sources(spark, "/root/testdata/sf0.001", "ts_varied")]
    frames += [Q._mixed_files(spark, "/root/testdata/sf0.001"), Q.QUERIES["par17_java_types"][0](spark, "/root/testdata/sf0.001")]
    assert all(f.rdd.getNumPartitions() >= least for f in frames)
