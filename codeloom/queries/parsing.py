"""Queries of the parsers (PAR) over source files made of the methods' table: a file for each path, a method for each row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators import parse as P
from codeloom.queries.shapes import duck, shape

QUERIES: dict = {}

#: Members that a class of the varied files holds in turn: text, name of the chunk that it makes (None: none), the chunk's
#: first and last line in it, and its calls. These rows are read off the text by hand.
JAVA_MEMBERS = [
    ("    // makes {name}\n    public void {name}(Order o) {{\n        repo.{name}(o);\n        check(o);\n    }}\n", "{name}", 0, 4, "Repo.{name},check"),
    ("    static {{ init(); go(); }}\n", None, 0, 0, ""),
    ("    private Runnable later = () -> {{ {name}(); }};\n", None, 0, 0, ""),
    ("    public byte[] {name}() {{\n        return List.<String>of(codec.{name}());\n    }}\n", "{name}", 0, 2, "List.of,codec.{name}"),
    ('    @RequestMapping(value = {{"/a", "/b"}})\n    @A(b = @B(1), c = f())\n    public <T extends Comparable<T>> Map<String, T> {name}(T[] in, int... n) throws E, F {{\n        for (Order o : in) o.{name}();\n        return new Box<T>(in).{name}(q -> q.put(1));\n    }}\n', "{name}", 0, 5, "Order.{name},Box.{name},Box,q.put"),
    ("    abstract int {name}(int a);\n", "{name}", 0, 0, ""),
    ('    int size = "}}{{".length(), {name}_size;\n', None, 0, 0, ""),
    ("    int getA{name}() {{\n        return {name};\n    }}\n", None, 0, 0, ""),
    ("    Comparator<X> by_{name} = new Comparator<X>() {{\n        public int {name}(X a, X b) {{\n            return a.rank(b) - b.rank(a);\n        }}\n    }};\n", "{name}", 1, 3, "X.rank"),
    ("    /* {{ */ char brace = '{{';\n", None, 0, 0, ""),
    ("    {name}(int a) {{\n        super(a);\n        this.open(a, switch_of(a));\n    }}\n", "{name}", 0, 3, "this.open,switch_of"),
]
SCRIPT_MEMBERS = [
    ("  async {name}(x) {{\n    this.repo.{name}(x);\n    Api.go(x);\n  }}\n", "{name}", 0, 3, "Repo.{name},Api.go"),
    ("  static {{ init(); }}\n", None, 0, 0, ""),
    ('  {name} = (x: number): string => {{\n    const r = /[{{]"/.test(x);\n    return this.svc.{name}(`a ${{r ? `b ${{f(x)}}` : "}}"}}`);\n  }}\n', "{name}", 0, 3, "test,Svc.{name},f"),
    ("  items: Map<string, () => void> = new Map()\n", None, 0, 0, ""),
    ("  @Input({{ a: [1] }}) set {name}(x: {{ a: string }}) {{\n    this.all = x / 2 / y;\n    p.then(x => go(x)).catch(y);\n  }}\n", "{name}", 0, 3, "then.catch,p.then,go"),
    ("  abstract {name}(a: string): void;\n", None, 0, 0, ""),
    ("  get size(): number {{ return 1; }}\n", None, 0, 0, ""),
    ("  public *[Symbol.iterator]() {{\n    yield* this.repo.all();\n    this.svc.x!(1);\n  }}\n", "", 0, 3, "Repo.all,Svc.x"),
    ("  private handlers = {{\n    {name}(e) {{\n      e.stop();\n      return {{ m() {{ return inner(); }} }};\n    }},\n  }};\n", "{name}", 1, 4, "e.stop,inner"),
]
VARIED = {
    "java_varied": ("java", ".java", "package demo;\npublic class {class} {{\n    private Repo repo;\n", JAVA_MEMBERS, "}}\n"),
    "ts_varied": ("typescript", ".ts", "import {{ Api }} from './api';\nclass {class} {{\n  constructor(private repo: Repo) {{}}\n  svc?: Svc;\n", SCRIPT_MEMBERS, "}}\n"),
}

#: For each kind of file: language, name of the file, its first lines, the lines of a method, its last lines.
FORMS = {
    "java": ("java", ".java", "package demo;\npublic class {class} {{\n    private Repo repo;\n", "    // makes {name}\n    public void {name}(Order o) {{\n        repo.{name}(o);\n        check(o);\n    }}\n", "}}\n"),
    "ts": ("typescript", ".ts", "import {{ Api }} from './api';\nclass {class} {{\n  constructor(private repo: Repo) {{}}\n", "  async {name}(x) {{\n    this.repo.{name}(x);\n    Api.go(x);\n  }}\n", "}}\n"),
    "xml": ("xml", "Mapper.xml", '<mapper namespace="demo.{class}">\n', '  <select id="{name}" resultType="T">\n    select 1\n  </select>\n', "</mapper>\n"),
    "getters": ("java", ".java", "class {class} {{\n", "    int getA{name}() {{\n        return {name};\n    }}\n    int is{name}() {{\n        return {name};\n    }}\n", "}}\n"),
    "long": ("java", ".java", "class {class} {{\n", "    void {name}() {{\n" + "        step(one, two, three, four, five, six, seven, eight);\n" * 120 + "    }}\n", "}}\n"),
}


def _fill(text: str, class_name=None, name=None):
    """text as a column, with the row's class and name, or those given, in it."""
    class_name, name = F.col("class_name") if class_name is None else class_name, F.col("name") if name is None else name
    parts = text.replace("{{", "\0").replace("}}", "\1").replace("{class}", "\2").replace("{name}", "\3")
    cols, rest = [], ""
    for c in parts:
        if c in "\2\3":
            cols += [F.lit(rest), class_name if c == "\2" else name]
            rest = ""
        else:
            rest += {"\0": "{", "\1": "}"}.get(c, c)
    return F.concat(*cols, F.lit(rest))


def sources(spark, d, form: str) -> DataFrame:
    """repo_id, path, language, source. In varied files the kinds of members take turns."""
    language, end, head, bodies, tail = FORMS[form] if form in FORMS else VARIED[form]
    texts = [bodies] if form in FORMS else [b[0] for b in bodies]
    rows = shape(spark, d, "methods").withColumn("class_name", F.when(F.col("class_name") == "", "X").otherwise(F.col("class_name")))
    # Files are put together of their rows' names; texts are written out only where a file's rows are already together.
    made = rows.repartition(_pieces(spark), "file_path").groupBy("file_path").agg(F.min("class_name").alias("class_name"), F.array_sort(F.collect_list(F.struct("id", "class_name", "name"))).alias("m"))
    member = lambda m, i: F.coalesce(*[F.when(i % len(texts) == k, _fill(x, m["class_name"], m["name"])) for k, x in enumerate(texts)])
    source = F.concat(_fill(head), F.array_join(F.transform("m", member), ""), _fill(tail))
    return made.select(F.lit("r").alias("repo_id"), F.concat("file_path", F.lit(end)).alias("path"), F.lit(language).alias("language"), source.alias("source"))


def _pieces(spark) -> int:
    """Pieces that rows are dealt into whose parsing costs much more than their bytes tell: a file or a few each, which is what a task holds."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _parsed(form: str, *columns, parse=P.parse_chunks):
    return lambda spark, d: P.parse_files(sources(spark, d, form), parse=parse).selectExpr("file_path", "cast(line_start as bigint) line_start", *columns)


def _expected(form: str, first: int, size: int, columns: str) -> str:
    return duck(f"""+k AS (SELECT *, CASE WHEN class_name = '' THEN 'X' ELSE class_name END AS cls, row_number() OVER (PARTITION BY file_path ORDER BY id) - 1 AS k FROM methods),
        c AS (SELECT file_path, min(cls) AS cls FROM k GROUP BY 1)
        SELECT k.file_path || '{FORMS[form][1]}' AS file_path, {first} + {size} * k AS line_start, {columns} FROM k JOIN c USING (file_path)""", "methods")


def _expected_varied(form: str, columns: str) -> str:
    _, end, head, members, _ = VARIED[form]
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {text.count(chr(10))}, {quoted(name)}, {first}, {last}, {quoted(calls)})" for k, (text, name, first, last, calls) in enumerate(members))
    return duck(f"""+v(j, size, symbol, low, high, calls) AS (VALUES {values}),
        k AS (SELECT *, CASE WHEN class_name = '' THEN 'X' ELSE class_name END AS cls, (row_number() OVER (PARTITION BY file_path ORDER BY id) - 1) % {len(members)} AS j FROM methods),
        p AS (SELECT file_path, name, v.*, {head.count(chr(10)) + 1} + coalesce(sum(size) OVER (PARTITION BY file_path ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top,
                     min(cls) OVER (PARTITION BY file_path) AS class_name FROM k JOIN v USING (j))
        SELECT file_path || '{end}' AS file_path, CAST(top + low AS BIGINT) AS line_start, replace(symbol, '{{name}}', name) AS symbol, {columns} FROM p WHERE symbol IS NOT NULL""", "methods")


_END = "cast(line_end as bigint) line_end"
_CALLS = "array_join(calls, ',') calls"
QUERIES["par2_java_methods"] = (_parsed("java_varied", "symbol", "class_name", "chunk_type", _END), _expected_varied("java_varied", "class_name, 'method' AS chunk_type, CAST(top + high AS BIGINT) AS line_end"))
QUERIES["par14_java_calls"] = (_parsed("java_varied", "symbol", _CALLS), _expected_varied("java_varied", "replace(calls, '{name}', name) AS calls"))
QUERIES["par13_comment_above"] = (_parsed("java", "symbol", r"regexp_extract(text, '\\[COMMENT\\] ([^\n]*)', 1) comment"), _expected("java", 4, 5, "name AS symbol, 'makes ' || name AS comment"))
QUERIES["par15_ts_calls"] = (_parsed("ts_varied", "symbol", "class_name", _CALLS, _END), _expected_varied("ts_varied", "class_name, replace(calls, '{name}', name) AS calls, CAST(top + high AS BIGINT) AS line_end"))
QUERIES["par3_regex_methods"] = (_parsed("java", "symbol", _END, parse=P.regex_chunks), _expected("java", 5, 5, "name AS symbol, 8 + 5 * k AS line_end"))
QUERIES["par20_mapper_statements"] = (_parsed("xml", "symbol", "class_name", "chunk_type", "signature", _END), _expected("xml", 2, 3, "name AS symbol, c.cls AS class_name, 'sql' AS chunk_type, '<select id=''' || name || '''> resultType=T' AS signature, 4 + 3 * k AS line_end"))
QUERIES["par6_accessors"] = (_parsed("getters", "symbol"), _expected("getters", 5, 6, "'is' || name AS symbol"))
QUERIES["par8_long_methods"] = (
    lambda spark, d: P.parse_files(sources(spark, d, "long")).groupBy("file_path", "symbol_id").agg(F.count_if("is_primary").alias("n_primary"), (F.max("method_line_end") - F.min("method_line_start")).cast("long").alias("lines"), (F.count("*") > 1).alias("cut")).groupBy("file_path").agg(F.count("*").alias("n"), F.sum("n_primary").alias("n_primary"), F.min("lines").alias("lines"), F.every("cut").alias("cut")),
    duck("SELECT file_path || '.java' AS file_path, count(*) AS n, count(*) AS n_primary, 121::BIGINT AS lines, true AS cut FROM methods GROUP BY 1", "methods"),
)


def _per_text(spark, d, function, kind: str) -> DataFrame:
    """function of every document's text."""

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "found": [function(t or "") for t in b["text"]]})

    return shape(spark, d, "documents").select("doc_id", "text").mapInPandas(run, f"doc_id bigint, found {kind}")


QUERIES["par4_brace_end"] = (lambda spark, d: _per_text(spark, d, lambda t: P.brace_end(["f {", "x {", "}", "}", *t.split("\n")], 0, 9), "bigint"), "SELECT doc_id, 3::BIGINT AS found FROM documents")
QUERIES["par7_windows"] = (lambda spark, d: _per_text(spark, d, lambda t: sum(c.is_primary for c in P.windows(t, max_tokens=400)), "bigint"), None)
QUERIES["par12_leading_comment"] = (lambda spark, d: _per_text(spark, d, lambda t: P.leading_comment("/**\n" + "\n".join(f" * {x}" for x in t.split("\n")) + "\n */\n@A\n// last\nx // after"), "string"), "SELECT doc_id, array_to_string(list_filter(list_append(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: trim(regexp_replace(l, '^[/*\\s]+', ''))), 'last'), lambda l: l <> '')[1:3], ' ') AS found FROM documents")
QUERIES["par17_java_types"] = (lambda spark, d: shape(spark, d, "methods").repartition(_pieces(spark)).select("id", F.lit("Repo repo; List<Foo> all = x; void f(Order o, int n) {}").alias("code")).mapInPandas(lambda it: (pd.DataFrame({"id": b["id"], "found": [",".join(f"{k}:{v}" for k, v in sorted(P.java_types(c).items())) for c in b["code"]]}) for b in it), "id string, found string"), duck("SELECT id, 'all:List,n:int,o:Order,repo:Repo' AS found FROM methods", "methods"))
QUERIES["par18_js_types"] = (lambda spark, d: shape(spark, d, "methods").repartition(_pieces(spark)).select("id", F.concat(F.lit("import { A as B, C } from 'x';\nimport D from 'y';\nconst "), "name", F.lit(" = require('z');")).alias("code")).mapInPandas(lambda it: (pd.DataFrame({"id": b["id"], "found": [",".join(f"{k}:{v}" for k, v in sorted(P.js_imports(c).items())) for c in b["code"]]}) for b in it), "id string, found string"), duck("SELECT id, 'B:A,C:C,D:D,' || name || ':' || name AS found FROM methods", "methods"))
QUERIES["par19_type_precedence"] = (lambda spark, d: P.parse_files(sources(spark, d, "java").withColumn("source", F.replace("source", F.lit("check(o);"), F.lit("Other repo = x; repo.go(o);")))).selectExpr("file_path", "symbol", "cast(line_start as bigint) line_start", _CALLS), _expected("java", 4, 5, "name AS symbol, 'Other.' || name || ',Other.go' AS calls"))


def _mixed_files(spark, d) -> DataFrame:
    """A file for each method, of four kinds in turn: a mapper with a namespace, one without, Java, YAML. The last lines of a file without a parser are windows of their own, each a line shorter."""
    kinds = [("Mapper.xml", "xml", '<mapper namespace="a.{class}">\n<select id="{name}">\nselect 1\n</select>\n</mapper>\n'), ("Mapper.xml", "xml", '<mapper>\n<select id="{name}">\nselect 1\n</select>\n</mapper>\n'), (".java", "java", "class {class} {{\n  int {name}() {{\n    return run();\n  }}\n}}\n"), (".yaml", "yaml", "a: {name}\nb: 1\n")]
    k = F.col("id").cast("long") % len(kinds)
    pick = lambda i: F.coalesce(*[F.when(k == n, _fill(x[i])) for n, x in enumerate(kinds)])
    rows = shape(spark, d, "methods").withColumn("class_name", F.when(F.col("class_name") == "", "X").otherwise(F.col("class_name")))
    return rows.repartition(_pieces(spark)).select(F.lit("r").alias("repo_id"), F.concat("id", pick(0)).alias("path"), pick(1).alias("language"), pick(2).alias("source"))


QUERIES["par1_chunk_kinds"] = (
    lambda spark, d: P.parse_files(_mixed_files(spark, d)).selectExpr("file_path", "chunk_type", "symbol", "class_name", "cast(line_start as bigint) line_start", _END),
    duck("""SELECT id || ['Mapper.xml', 'Mapper.xml', '.java', '.yaml'][CAST(id AS BIGINT) % 4 + 1] AS file_path, ['sql', 'block', 'method', 'block'][CAST(id AS BIGINT) % 4 + 1] AS chunk_type,
        CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN name ELSE '' END AS symbol, CASE WHEN CAST(id AS BIGINT) % 2 <> 0 THEN '' WHEN class_name = '' THEN 'X' ELSE class_name END AS class_name,
        CAST(unnest([[2], [1, 2, 3, 4, 5], [2], [1, 2]][CAST(id AS BIGINT) % 4 + 1]) AS BIGINT) AS line_start, [4, 5, 4, 2][CAST(id AS BIGINT) % 4 + 1]::BIGINT AS line_end FROM methods""", "methods"),
)
