"""Declarations and calls of hand-made files. Each case holds the source and what must be found: name, class and calls of each function in order."""

import random
import textwrap

import pytest

from codeloom.operators.parse import java_types, js_imports, parse_chunks
from codeloom.operators.syntax import Java, Script, Tokens, calls, functions, java_variables

JAVA = {
    "static initialiser": ("class S { static { init(); go(); } void m() { a(); } }", [("m", "S", "a")]),
    "instance initialiser with a local class": ("class S { { class L { void q() { a(); } } } void m() { b(); } }", [("q", "L", "a"), ("m", "S", "b")]),
    "lambda in a field": ("class S { Runnable r = () -> { a(); }; void m() { b(); } }", [("m", "S", "b")]),
    "array types": ("class S { byte[] one() { a(); } int[][] two(int[] x)[] { b(); } void three(String... s) { s.c(); } }", [("one", "S", "a"), ("two", "S", "b"), ("three", "S", "String.c")]),
    "annotation with braces": ('class S { @RequestMapping(value = {"/a", "/b"}) public void m() { a(); } }', [("m", "S", "a")]),
    "nested annotation": ("class S { @A(b = @B(1), c = f(\")\")) @x.y.C void m(@D(1) final Foo p) { p.a(); } }", [("m", "S", "Foo.a")]),
    "type arguments": ("class S { public <T extends Comparable<? super T>> Map<String, List<T>> m(Map<String, Map.Entry<K, V>> in) { in.a(); } }", [("m", "S", "Map.a")]),
    "explicit type arguments": ("class S { Repo<X> repo; void m() { List.<String>of(x); this.<T>g(); repo.<A, B>h(1); } }", [("m", "S", "List.of this.g Repo.h")]),
    "interface": ("interface I { int a(int x); default void b() { c(); } static void d() { e(); } private void f() { g(); } }", [("a", "I", ""), ("b", "I", "c"), ("d", "I", "e"), ("f", "I", "g")]),
    "enum": ("enum E { A(1, x()) { int f() { return a(); } }, @D B, C { }; final int n; E(int n) { this.n = b(n); } int f() { return c(); } }", [("f", "E", "a"), ("E", "E", "b"), ("f", "E", "c")]),
    "enum without members": ("enum E { A, B } class S { void m() { a(); } }", [("m", "S", "a")]),
    "record": ("record P<T>(int x, Repo repo) implements I { P { check(x); } P(int x) { this(x, null); } int z() { return repo.k(); } }", [("P", "P", ""), ("z", "P", "Repo.k")]),
    "record as a name": ("class S { Record record; void m() { record.a(); var record = new B(); record.c(); } }", [("m", "S", "var.a B var.c")]),
    "annotation type": ("@interface An { String value() default \"x\"; int n(); class K { void m() { a(); } } } class S { void n() { b(); } }", [("m", "K", "a"), ("n", "S", "b")]),
    "anonymous class in a field": ("class S { C<X> c = new C<X>() { X own; public int compare(X a, X b) { return a.r(b); } }; void m() { own.b(); } }", [("compare", "S", "X.r"), ("m", "S", "own.b")]),
    "anonymous class in a method": ("class S { void m() { run(new C(1) { void q(int z) { a(z); } }); } }", [("m", "S", "run C a")]),
    "nested classes": ("class A { F f; static class B { G f; void m() { f.a(); } } void n() { f.b(); } }", [("m", "B", "G.a"), ("n", "A", "F.b")]),
    "fields after methods": ("class S { void m() { f.a(); g.b(); h.c(); } private final x.y.F f; G g = new G(), h = null; }", [("m", "S", "F.a G.b G.c")]),
    "comparisons are no type arguments": ("class S { boolean m() { if (a < b(c) && d > e(f)) { return g(h) > (i); } return j < k; } }", [("m", "S", "b e g")]),
    "strings and comments with braces": ('class S { /* } */ String a = "}"; char b = \'}\'; // }\n void m() { a("{\\"", \'\\\'\'); /* ( */ b(); } void n() { c(); } }', [("m", "S", "a b"), ("n", "S", "c")]),
    "text block": ('class S { String a = """\n  } "quoted" {\n  """; void m() { b(); } }', [("m", "S", "b")]),
    "chains": ("class S { R r; void m() { r.a(b()).c(d.e()); new F().g(); new x.Y(1).z(); \"s\".h(); r.x[0].i(); super.j(); } }", [("m", "S", "a.c R.a b d.e F.g F Y.z Y h x.i super.j")]),
    "locals": ("class S { F x; void m(List<A> as) { for (A a : as) { a.b(); } try (In i = open()) { i.c(); } catch (final Ex | Ey e) { e.d(); } G x = new G(), y; x.e(); y.f(); if (o instanceof H h && h.g()) { } } }", [("m", "S", "A.b open In.c Ey.d G G.e G.f H.g")]),
    "throws and abstract": ("abstract class S { abstract int a(int x) throws E, F; native void b(); synchronized void c() throws E { d(); } protected S() { e(); } }", [("a", "S", ""), ("b", "S", ""), ("c", "S", "d"), ("S", "S", "e")]),
    "switch expressions and lambdas": ("class S { int m(int k) { return switch (k) { case 1 -> a(); case 2, 3 -> { yield b(); } default -> c(x -> d(x), E::f); }; } }", [("m", "S", "a b c d")]),
    "names that are reserved elsewhere": ("class S { void m() { List.of(1); s.with(2); f.delete(); p.function(x); } }", [("m", "S", "List.of s.with f.delete p.function")]),
    "what cannot be read is skipped alone": ("class S { int = 5; ??? garbage !!! ; void m() { a(); } ] ) void n() { b(); } }", [("m", "S", "a"), ("n", "S", "b")]),
    "two types and imports": ("package a.b; import static x.Y.*; @Entity final class A { void m() { a(); } } sealed interface B permits C { void n(); } non-sealed class C { void o() { b(); } }", [("m", "A", "a"), ("n", "B", ""), ("o", "C", "b")]),
    "unclosed": ("class S { void m() { a(); } void n() { b(", [("m", "S", "a"), ("n", "S", "b")]),
}

SCRIPT = {
    "regular expression with a brace": ('function f(a) { const r = /[{]"/.test(a); return r; } function g() { h(); }', [("f", "", "test"), ("g", "", "h")]),
    "division": ("function f(a) { return a / b / g(c) / 2; } function h() { if (x) /'{/.test(y); }", [("f", "", "g"), ("h", "", "test")]),
    "regular expression after a block": ("function f() { if (a) { b(); } /}'/.exec(c); } function g() { d(); }", [("f", "", "b exec"), ("g", "", "d")]),
    "object methods": ("export default { m() { a(); }, q: () => { b(); }, async r(x) { c(); }, get s() { d(); }, t: function () { e(); }, 'u-v'() { f(); }, *w() { g(); }, [k]: x => { h(); }, }", [("m", "", "a"), ("q", "", "b"), ("r", "", "c"), ("s", "", "d"), ("t", "", "e"), ("u-v", "", "f"), ("w", "", "g"), ("", "", "h")]),
    "arrow as an argument": ("app.get('/x', async (req, res) => { const u = new Svc(); res.json(await u.find(req)); }); app.use(x => { a(); })", [("", "", "Svc res.json Svc.find"), ("", "", "a")]),
    "nested templates": ("const f = () => { return `a ${b ? `n ${c(`${d()}`)} }` : '}'} ${{ e: g() }.e}`; }; function h() { i(); }", [("f", "", "c d g"), ("h", "", "i")]),
    "tagged template": ("function f() { return html`<b>${g()}</b>` + a.css`x`; }", [("f", "", "html g a.css")]),
    "class": ("class A extends mixin(B, { x: 1 }) { constructor(r) { super(r); this.r = new R(); } static s() { a(); } #p() { this.r.b(); } get v() { c(); } }", [("constructor", "A", "R"), ("s", "A", "a"), ("#p", "A", "R.b"), ("v", "A", "c")]),
    "class fields": ("class A { x = 1\n y = () => { a(); }\n z = { m() { b(); } }\n static w = function () { c(); };\n n() { d(); } }", [("y", "A", "a"), ("m", "A", "b"), ("w", "A", "c"), ("n", "A", "d")]),
    "typed class": ("class A<T extends { a: string }> implements I<T> { private readonly api: UserApi<X>; svc?: Svc; n: number; constructor(private repo: Repo, @Inject() public o?: Other) { } m(): Promise<{ a: string }> { this.api.a(); this.svc!.b(); this.repo.c(); this.o?.d(); this.n.e(); } }", [("constructor", "A", ""), ("m", "A", "UserApi.a Svc.b Repo.c Other.d n.e")]),
    "decorators": ("@Component({ selector: 'x', template: `}` }) export class A { @Input() a; @Output({ b: [1] }) set c(x: { d: string }) { e(x); } @x.y f() { g(); } }", [("c", "A", "e"), ("f", "A", "g")]),
    "signatures have no body": ("declare function a(x): void; function a(x: string): void; abstract class A { abstract b(): { c: string }; d(x: number): void; e() { f(); } }", [("e", "A", "f")]),
    "types are no functions": ("interface I { a: (e: Event) => void; b(): { c: string } } type H<X> = (a: string) => void; type U = | 'a' | { b: () => void }; const f: (a: number) => void = (a) => { g(a); };", [("f", "", "g")]),
    "typed arrows": ("export const a = async <T,>(x: T, y = { c: 1 }): Promise<T> => { b(x); }; const c: Handler<X, Y> = (r) => { d(r); }", [("a", "", "b"), ("c", "", "d")]),
    "arrow without braces": ("const a = (x) =>\n  b({ x: x })\nconst c = y => d(y), e = 1", [("a", "", "b"), ("c", "", "d")]),
    "nested arrows are one": ("const a = (x) => (y) => { b(() => c()); }", [("a", "", "b c")]),
    "wrapped file": ("(function () { function a() { b(); } var c = function d() { e(); }; })(); define(['x'], function (x) { return { f() { g(); } }; })", [("a", "", "b"), ("d", "", "e"), ("f", "", "g")]),
    "assigned members": ("A.prototype.m = function (x) { a(); }; module.exports.n = x => { b(); }; exports.o = async () => { c(); }", [("m", "", "a"), ("n", "", "b"), ("o", "", "c")]),
    "generators and async": ("async function* a() { for await (const x of b()) { yield* c(x); } } export default async function () { d(); }", [("a", "", "b c")]),
    "calls": ("function f() { a.b(c()).d(); this.x.y(); this.m(); g?.(1); h?.i?.(2); p.then(q).catch(r); import('z'); new K; new n.L(1); (e || j)(k); if (l(1)) { } o[0].s(); t()(); u.delete(1); Observable.of(2); }", [("f", "", "b.d a.b c x.y this.m g h.i then.catch p.then K L l o.s t u.delete Observable.of")]),
    "type arguments of calls": ("function f() { a<T>(x); b.c<Map<K, V>>(y); useRef<(z: Z) => void>(null); if (d < e && g > (h)) { i(); } }", [("f", "", "a b.c useRef i")]),
    "imports": ("import { A as B, type C } from 'x'; import D from 'y'; import * as N from 'z'; const { F, G: H } = require('w'); const R = require('v'); function f() { B.a(); C.b(); D.c(); N.d(); F.e(); H.g(); R.h(); }", [("f", "", "A.a C.b D.c N.d F.e H.g R.h")]),
    "objects made in a method": ("class A { m() { const x = new Foo(); this.y = new a.Bar(); x.b(); this.y.c(); } n() { x.d(); } }", [("m", "A", "Foo Bar Foo.b Bar.c"), ("n", "A", "x.d")]),
    "blocks are no objects": ("function f() { a(); } { b(); } if (c) { d(); } while (e()) { g(); } switch (h) { case 1: { i(); } }", [("f", "", "a")]),
    "ternaries are no arrow types": ("const a = b ? (c) : (d), e = () => { f(); }", [("e", "", "f")]),
    "comments and strings": ("// function x() {\n/* class Y { */ const s = '}', t = \"{\"; function f() { a('('); } // }\nfunction g() { b(); }", [("f", "", "a"), ("g", "", "b")]),
    "static block and index signature": ("class A { static { init(); } [key: string]: unknown; declare x: number; accessor y = 1; async *[Symbol.iterator]() { a(); } get = 1; set() { b(); } async() { c(); } }", [("", "A", "a"), ("set", "A", "b"), ("async", "A", "c")]),
    "class expression": ("const A = class extends B { m() { a(); } }; export default class { n() { b(); } }", [("m", "A", "a"), ("n", "", "b")]),
    "conditional types and assertions": ("const a = <T>(x: T extends (y: any) => infer R ? R : never): x is Foo => { b(x as (z: Z) => void); }; function c(x: keyof typeof y): asserts x is Z { d(); }", [("a", "", "b"), ("c", "", "d")]),
}


def found(source, script):
    t = Tokens(source, script)
    out = []
    for f in functions(t):
        types = {}
        if f.body is not None:
            types = Script(t).imports() | f.fields | Script(t).created(f.body, f.stop) if script else f.fields | java_variables(t, f.start, f.stop)
        out.append((f.name, f.owner, " ".join(calls(t, f.body, f.stop, types)) if f.body is not None else ""))
    return out


@pytest.mark.parametrize("name", JAVA)
def test_java(name):
    source, want = JAVA[name]
    assert found(source, False) == want
    if not set("\"'") & set(source) and "//" not in source:
        assert found(source.replace(" ", "\n\t "), False) == want  # white space does not matter


@pytest.mark.parametrize("name", SCRIPT)
def test_script(name):
    source, want = SCRIPT[name]
    assert found(source, True) == want


#: A member of a class and the methods that it must give, whatever stands beside it.
JAVA_MEMBERS = [
    ("int a, b = f(1), c[] = {1, 2};", []), ("static { go(); }", []), ("{ go(); }", []), (";", []), ("Map<String, int[]> m = new HashMap<>() {{ put(1, 2); }};", []), ("Runnable r = () -> { x(); };", []),
    ("@A({1, 2}) private final x.Y<Z>[] y = z ? a : b;", []), ("void one() { a(); }", ["one"]), ("public <T> List<T> two(T... t) throws E { return b(t); }", ["two"]), ("byte[] three() { return \"}\".c(); }", ["three"]),
    ("abstract int four(int a);", ["four"]), ("@A(b = @B({})) @C synchronized void five() { if (a) { d(); } }", ["five"]), ("class K { void six() { e(); } }", ["six"]), ("enum E { A { void seven() { f(); } }; }", ["seven"]),
    ("interface I { void eight(); }", ["eight"]), ("Object o = new Object() { public String nine() { return g(); } };", ["nine"]), ("record R(int a) { int ten() { return h(); } }", ["ten"]), ("S(int a) { super(a); }", ["S"]),
    ("@interface An { int v() default 1; }", []), ("private int eleven()[] { return i(); }", ["eleven"]), ("char q = '{', p = '\\'';", []), ("/* } */ // {\n", []), ("native void twelve();", ["twelve"]),
]
SCRIPT_MEMBERS = [
    ("a = 1;", []), ("b;", []), ("static { go(); }", []), ("c: Map<string, () => void> = new Map();", []), ("one() { a(); }", ["one"]), ("async two(x: { a: b }): Promise<{ c: d }> { e(); }", ["two"]),
    ("three = async (x) => { f(/[}]/); };", ["three"]), ("get four() { return `${{ a: 1 }.a}}`; }", ["four"]), ("@A({ b: [1] }) five() { g(); }", ["five"]), ("abstract six(a: string): void;", []), ("private static readonly s = 'x}';", []),
    ("#seven() { h(); }", ["#seven"]), ("*eight() { yield i(); }", ["eight"]), ("h = { nine() { j(); } };", ["nine"]), ("constructor(private r: R) { super(); }", ["constructor"]), ("[k: string]: any;", []), ("k = function () { l(); };", ["k"]),
    ("ten<T>(x: T extends U ? V : W) { m(); }", ["ten"]), ("w = class { eleven() { n(); } };", ["eleven"]), ("x = a ? (b) : (c);", []), ("// }\n", []), ("'twelve'() { o(); }", ["twelve"]),
]


@pytest.mark.parametrize("seed", range(60))
def test_a_member_is_found_whatever_stands_beside_it(seed):
    rng = random.Random(seed)
    for members, reader, script in ((JAVA_MEMBERS, Java, False), (SCRIPT_MEMBERS, Script, True)):
        chosen = [rng.choice(members) for _ in range(12)]
        source = "class S {\n" + "\n".join(text for text, _ in chosen) + "\n}\n" + "class After { void_() { z(); } }" * script
        r = reader(Tokens(source, script))
        r.read()
        want = [n for _, names in chosen for n in names] + ["void_"] * script
        assert [f.name for f in r.found] == want, source


def test_lines_and_signatures_of_chunks():
    code = textwrap.dedent("""\
        class S {
            static { init(); }

            /**
             * Stores an order.
             */
            @RequestMapping(value = {"/a", "/b"})
            public void save(Order o) {
                repo.insert(o);
                check(o);
            }
            private OrderRepo repo;
        }
        """)
    (c,) = parse_chunks(code, "java", "S.java")
    assert (c.symbol, c.class_name, c.line_start, c.line_end, c.calls) == ("save", "S", 4, 11, ["OrderRepo.insert", "check"])
    assert c.signature == '@RequestMapping(value = {"/a", "/b"})\n    public void save(Order o)' and "[COMMENT] Stores an order." in c.text


def test_types_of_a_piece_of_code():
    assert java_types("Repo repo; List<Foo> all = x; void f(Order o, int n) {} x(a, b); return y; final Z[] z = {1}, w;") == {"repo": "Repo", "all": "List", "o": "Order", "n": "int", "z": "Z", "w": "Z"}
    assert js_imports("import 'side'; import T, { type E, F as G } from 'x'; import('y'); const { ...rest } = require('z')") == {"T": "T", "E": "E", "G": "F"}


@pytest.mark.parametrize("script", [False, True])
def test_any_text_is_read_to_its_end(script):
    rng = random.Random(7)
    for _ in range(300):
        source = "".join(rng.choice(["{", "}", "(", ")", "[", "]", "<", ">", "class ", "x ", "=>", "=", ";", ",", ":", "`", "${", "/", "'", '"', "\\", "\n", "function ", "new ", "@", ".", "?", "*", "static ", "1"]) for _ in range(rng.randint(0, 80)))
        t = Tokens(source, script)
        for f in functions(t):
            assert 0 <= f.start < f.stop <= t.n
            calls(t, f.body if f.body is not None else f.start, f.stop, {})
        assert sorted(t.start) == t.start


def test_a_large_file_takes_linear_time():
    source = "class S {\n" + "\n".join(f"  public Map<String, List<T{i}>> m{i}(int a) {{ return repo.f{i}(g(a < {i}), b > c); }}" for i in range(5000)) + "\n}"
    assert len(functions(Tokens(source, False))) == 5000


class Counting:
    """A pattern that counts how often it is asked."""

    def __init__(self, pattern):
        self.pattern, self.asked = pattern, 0

    def __getattr__(self, name):
        self.asked += 1
        return getattr(self.pattern, name)


def test_equal_lines_are_cut_and_counted_once(monkeypatch):
    from codeloom.operators import parse as P
    from codeloom.operators import syntax as S

    source = "class A {\n" + "".join(f"  void f{i}() {{\n" + "    step(one, two);\n" * 500 + "  }\n" for i in range(4)) + "}\n"
    tokens, words = Counting(S._TOKEN), Counting(P._WORDS)
    monkeypatch.setattr(S, "_TOKEN", tokens)
    monkeypatch.setattr(P, "_WORDS", words)
    P._line_tokens.cache_clear()
    found = P.parse_chunks(source, "java", "A.java")
    assert [sum(c.symbol == f"f{i}" and c.is_primary for c in found) for i in range(4)] == [1] * 4
    assert tokens.asked < 20 and words.asked < 100


def test_lines_are_cut_as_the_whole_text_is():
    from codeloom.operators import syntax as S

    rng = random.Random(11)
    parts = ['"', "'", '"""', "\\", "\n", "\r\n", "\u2028", "/*", "*/", "//", "/", "*", "a", " ", "\t", "1.5", ".", "...", "(", ")", "{", "}", "->", "::", "\n  x(y);\n"]
    for _ in range(3000):
        source = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        want, broken = [], True
        for m in S._TOKEN.finditer(source):
            if m.lastgroup == "space":
                broken = broken or "\n" in m[0]
            else:
                want.append((m[0], m.lastgroup, m.start(), broken))
                broken = False
        t = Tokens(source, False)
        assert list(zip(t.x, t.kind, t.start, map(bool, t.broken), strict=True)) == [*want, ("", "end", len(source), True)]
