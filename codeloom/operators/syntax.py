"""Tokens and declarations of Java, JavaScript and TypeScript files.

A lexer cuts a file into tokens; whether a slash begins a regular expression and where a template's text goes on depends on
what was open before. Recursive descent over the tokens then finds types, members and functions wherever they stand: a
member that cannot be read is skipped alone and never ends its class.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field

#: Reserved words by what they mean to the rules below.
CONTROL = {"if", "for", "while", "switch", "catch", "with", "function"}
OPERATORS = {"return", "throw", "new", "else", "do", "case", "typeof", "void", "delete", "in", "of", "instanceof", "await", "yield", "assert", "default", "as", "extends", "try", "finally", "satisfies"}
SCRIPT_ONLY = {"with", "function", "typeof", "void", "delete", "in", "of", "await", "as", "satisfies"}
NOT_CALLED = CONTROL | OPERATORS | {"super", "this", "import", "class", "enum"}
JAVA_NOT_CALLED = (NOT_CALLED - SCRIPT_ONLY) | {"synchronized", "interface"}
JAVA_NOT_TYPES = JAVA_NOT_CALLED | {"package", "implements", "throws", "public", "private", "protected", "static", "final", "break", "continue", "goto", "null", "true", "false"}
JAVA_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "strictfp", "default", "transient", "volatile", "sealed"}
SCRIPT_MODIFIERS = {"public", "private", "protected", "static", "async", "get", "set", "readonly", "override", "abstract", "declare", "accessor"}
PREDEFINED = {"any", "number", "boolean", "string", "symbol", "void", "unknown", "never", "object", "bigint", "undefined", "null", "this", "typeof", "keyof", "unique", "readonly", "asserts", "infer"}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")", "]", "}"}

_TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"
    r"|(?P<word>\#?(?:[^\W\d]|\$)[\w$]*)"
    r"|(?P<number>\.?\d[\w.]*)"
    r"|(?P<string>\"\"\"(?:\\.|.)*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z))"
    r"|(?P<mark>=>|\?\.(?!\d)|\.\.\.|\+\+|--|->|::|===?|!==?|<=|&&|\|\||\?\?|\*\*|.)",
    re.S,
)
_PATTERN = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)


#: What may let a token go on past its line.
_GOES_ON = re.compile(r'/\*|"""|\\')


class Places(array):
    """Numbers of eight bytes each, equal to any row of the same numbers."""

    def __eq__(self, other) -> bool:
        return len(self) == len(other) and all(a == b for a, b in zip(self, other, strict=True))

    __hash__ = None


class Tokens:
    """The tokens of a file as parallel lists, with an empty token at the end; match pairs brackets, broken marks tokens that begin a line."""

    def __init__(self, source: str, script: bool):
        self.source, self.script = source, script
        self.x: list[str] = []
        self.kind: list[str] = []
        self.start = Places("q")
        self.broken = bytearray()
        same: dict[str, str] = {}  # equal tokens share one string, so that a long file's tokens take few bytes each
        self.match: dict[int, int] = {}
        self._stack: list[int] = []
        self._statement: dict[int, bool] = {}
        (self._cut if script else self._cut_lines)(source, same)
        self.n = len(self.x)
        for each, value in ((self.x, ""), (self.kind, "end"), (self.start, len(source)), (self.broken, True)):
            each.append(value)

    def _cut(self, source: str, same: dict[str, str]) -> None:
        """Scripts: token by token, since a slash, a backtick and a brace mean what was open before."""
        at, broken = 0, True
        while at < len(source):
            m = _TOKEN.match(source, at)
            kind, text = m.lastgroup, m[0]
            if kind == "space":
                broken, at = broken or "\n" in text, m.end()
                continue
            if text == "/" and self._pattern_may_begin() and (p := _PATTERN.match(source, at)):
                kind, text = "string", p[0]
            elif text == "`":
                at = self._template(at, at + 1, broken)
                broken = False
                continue
            elif text == "}" and self._open() == "${":
                self._add("mark", "}", at, broken)
                at = self._template(at + 1, at + 1, False)
                broken = False
                continue
            self._add(kind, same.setdefault(text, text), at, broken)
            at, broken = at + len(text), False

    def _cut_lines(self, source: str, same: dict[str, str]) -> None:
        """Without scripts' patterns and templates a token depends on nothing before it, so equal rests of lines are cut once; those with a token that may go on in the next line, each by itself."""
        at, broken, known = 0, True, {}
        while at < len(source):
            stop = source.find("\n", at) + 1 or len(source)
            rest = source[at:stop]
            if _GOES_ON.search(rest):
                m = _TOKEN.match(source, at)
                if m.lastgroup == "space":
                    broken = broken or "\n" in m[0]
                else:
                    self._add(m.lastgroup, same.setdefault(m[0], m[0]), at, broken)
                    broken = False
                at = m.end()
                continue
            cut = known.get(rest)
            if cut is None:
                found = [m for m in _TOKEN.finditer(rest) if m.lastgroup != "space"]
                x, kind = [same.setdefault(m[0], m[0]) for m in found], [m.lastgroup for m in found]
                cut = known[rest] = x, kind, [m.start() for m in found], [(i, a) for i, (a, k) in enumerate(zip(x, kind, strict=True)) if k == "mark" and (a in OPEN or a in CLOSE)]
            x, kind, places, brackets = cut
            if x:
                first = len(self.x)
                self.x += x
                self.kind += kind
                self.start.extend([at + i for i in places])
                self.broken += bytes(len(x))
                self.broken[first] = broken
                for i, text in brackets:
                    self._bracket(first + i, text)
            broken = rest[-1] == "\n" or broken and not x
            at = stop

    def end(self, i: int) -> int:
        """Where token i ends in the source."""
        return self.start[i] + len(self.x[i])

    def word(self, i: int) -> bool:
        return 0 <= i <= self.n and self.kind[i] == "word"

    def _open(self) -> str:
        return self.x[self._stack[-1]] if self._stack else ""

    def _add(self, kind: str, text: str, at: int, broken: bool) -> None:
        i = len(self.x)
        if kind == "mark" and text in OPEN:
            before = self.x[-1] if self.x else ""
            # what a closing bracket means for a slash after it: the end of a statement's head or block, or of an operand
            if self.script:
                self._statement[i] = before in ("if", "while", "for", "with") if text == "(" else text == "{" and (before in ("", ")", "{", "}", ";", "=>") or self.kind[-1] == "word" and before not in OPERATORS - {"else", "do", "try", "finally"})
        if kind == "mark" and (text in OPEN or text in CLOSE):
            self._bracket(i, text)
        self.x.append(text)
        self.kind.append(kind)
        self.start.append(at)
        self.broken.append(broken)

    def _bracket(self, i: int, text: str) -> None:
        """Notes the bracket at i, and what it closes."""
        if text in OPEN:
            self._stack.append(i)
            return
        back = next((k for k in reversed(range(len(self._stack))) if OPEN[self.x[self._stack[k]]] == text), None)
        if back is not None:
            opened = self._stack[back]
            del self._stack[back:]
            self.match[opened], self.match[i] = i, opened

    def _pattern_may_begin(self) -> bool:
        if not self.x:
            return True
        before, i = self.x[-1], len(self.x) - 1
        if self.kind[-1] == "word":
            return before in OPERATORS and self.x[-2:-1] != ["."]
        if before in (")", "}"):
            return self._statement.get(self.match.get(i), False)
        return self.kind[-1] == "mark" and before not in ("]", "++", "--")

    def _template(self, begin: int, at: int, broken: bool) -> int:
        """Text of a template from at on, up to its end or the next expression inside it."""
        stop = _TEMPLATE.match(self.source, at).end()
        after = stop + 1 if self.source.startswith("`", stop) else stop
        if after > begin:
            self._add("string", self.source[begin:after], begin, broken)
        if after == stop and self.source.startswith("${", stop):
            self._add("mark", "${", stop, False)
            after = stop + 2
        return after

    def angles(self, i: int) -> int | None:
        """After the type arguments that open at i."""
        depth = 0
        while i < self.n:
            t = self.x[i]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif t in OPEN and i in self.match:
                i = self.match[i]
            elif t in CLOSE or t in (";", "&&", "||", "==", "===", "="):
                return None
            i += 1
        return None

    def angles_back(self, i: int) -> int | None:
        """Where the type arguments that close at i open."""
        depth = 0
        while i >= 0:
            t = self.x[i]
            if t == ">":
                depth += 1
            elif t == "<":
                depth -= 1
                if not depth:
                    return i
            elif t in CLOSE and i in self.match:
                i = self.match[i]
            elif t in OPEN or t in (";", "&&", "||", "==", "===", "="):
                return None
            i -= 1
        return None


@dataclass
class Function:
    """A method, constructor or function: tokens from start up to stop, its body from token body on (None if it has none). fields are its class's, complete once the file is read."""

    name: str
    owner: str
    start: int
    body: int | None
    stop: int
    fields: dict[str, str] = field(default_factory=dict)


def functions(t: Tokens) -> list[Function]:
    """Outermost first; what lies inside one is not looked for again."""
    reader = Script(t) if t.script else Java(t)
    reader.read()
    return reader.found


class Java:
    def __init__(self, t: Tokens):
        self.t, self.x, self.found = t, t.x, []

    def read(self) -> None:
        self.body(0, self.t.n, "", {}, True)

    def body(self, i: int, end: int, owner: str, fields: dict[str, str], declare: bool, keep: bool = True) -> None:
        """Members of a class from i to end. Fields are noted if declare, methods found if keep."""
        while i < end:
            i = max(self.member(i, end, owner, fields, declare, keep), i + 1)

    def skipped(self, i: int) -> int:
        return self.t.match.get(i, i) + 1 if self.x[i] in OPEN else i + 1

    def until(self, i: int, end: int, *stops: str) -> int:
        """The next of stops at the depth of i."""
        while i < end and self.x[i] not in stops:
            i = self.skipped(i)
        return min(i, end)

    def annotations(self, i: int) -> int:
        x, t = self.x, self.t
        while x[i] == "@" and x[i + 1] != "interface" and t.word(i + 1):
            i += 2
            while x[i] == "." and t.word(i + 1):
                i += 2
            if x[i] == "(" and i in t.match:
                i = t.match[i] + 1
        return i

    def modifiers(self, i: int) -> int:
        x = self.x
        while True:
            i = self.annotations(i)
            if x[i] == "non" and x[i + 1 : i + 3] == ["-", "sealed"]:
                i += 3
            elif x[i] in JAVA_MODIFIERS and x[i + 1] not in ("(", "=", ",", ".", ")"):
                i += 1
            else:
                return i

    def type(self, i: int) -> tuple[int, str] | None:
        """After the type at i, and its simple name: neither package nor type arguments nor array brackets."""
        x, t = self.x, self.t
        i = self.annotations(i)
        if not t.word(i) or x[i] in JAVA_NOT_TYPES:
            return None
        name = x[i]
        i += 1
        while True:
            if x[i] == "<":
                after = t.angles(i)
                if after is None:
                    return None
                i = after
            elif x[i] == "." and t.word(after := self.annotations(i + 1)):
                name = x[after]
                i = after + 1
            elif x[i] == "[" and x[i + 1] == "]":
                i += 2
            elif x[i] == "...":
                i += 1
            elif (after := self.annotations(i)) > i:
                i = after
            else:
                return i, name

    def kind_of_type(self, i: int) -> str | None:
        """The keyword, if a type is declared at i."""
        x, t = self.x, self.t
        if x[i] == "@" and x[i + 1] == "interface":
            return "@interface"
        if x[i] in ("class", "interface", "enum") and t.word(i + 1) and x[i - 1] not in (".", "::"):
            return x[i]
        return "record" if x[i] == "record" and t.word(i + 1) and x[i + 2] in ("(", "<") else None

    def declared_type(self, i: int, end: int, kind: str) -> int:
        x, t = self.x, self.t
        name = i + (2 if kind == "@interface" else 1)
        fields: dict[str, str] = {}
        opened = self.until(name + 1, end, "{", ";")
        if kind == "record":
            first = self.until(name + 1, end, "(", "{")
            if x[first] == "(" and first in t.match:
                p = first + 1
                while p < t.match[first]:
                    found = self.type(self.modifiers(p))
                    if found and t.word(found[0]):
                        fields[x[found[0]]] = found[1]
                    p = self.until(p, t.match[first], ",") + 1
        if x[opened] != "{":
            return opened + 1
        close = t.match.get(opened, end)
        p = opened + 1
        if kind == "enum":
            stop = self.until(p, close, ";")
            self.constants(p, stop, x[name], fields)
            p = stop
        self.body(p, close, x[name], fields, True, kind != "@interface")
        return close + 1

    def constants(self, i: int, end: int, owner: str, fields: dict[str, str]) -> None:
        """An enum's constants, with what stands in their arguments and bodies."""
        while i < end:
            i = self.modifiers(i)
            if not self.t.word(i):
                i = self.skipped(i)
                continue
            i += 1
            for opened in ("(", "{"):
                if self.x[i] == opened and i in self.t.match:
                    close = self.t.match[i]
                    if opened == "(":
                        self.inside(i + 1, close, owner, fields)
                    else:
                        self.body(i + 1, close, owner, fields, False)
                    i = close + 1

    def inside(self, i: int, end: int, owner: str, fields: dict[str, str]) -> None:
        """Classes inside initialisers and values."""
        while i < end:
            if kind := self.kind_of_type(i):
                i = self.declared_type(i, end, kind)
            elif self.x[i] == "{" and i in self.t.match and self.anonymous(i):
                self.body(i + 1, self.t.match[i], owner, fields, False)
                i = self.t.match[i] + 1
            else:
                i += 1

    def anonymous(self, i: int) -> bool:
        """Whether the brace at i opens the body of `new Name(...)`."""
        x, t = self.x, self.t
        if x[i - 1] != ")" or i - 1 not in t.match:
            return False
        k = t.match[i - 1] - 1
        while True:
            if x[k] == ">":
                back = t.angles_back(k)
                if back is None:
                    return False
                k = back - 1
            if not t.word(k):
                return False
            if x[k - 1] == ".":
                k -= 2
            else:
                return x[k - 1] == "new"

    def member(self, i: int, end: int, owner: str, fields: dict[str, str], declare: bool, keep: bool) -> int:
        """Reads the member at i and says where the next begins."""
        x, t, begin = self.x, self.t, i
        if x[i] in ("package", "import"):
            return self.until(i, end, ";") + 1
        i = self.modifiers(i)
        if kind := self.kind_of_type(i):
            return self.declared_type(i, end, kind)
        if x[i] == "{" or t.word(i) and x[i + 1] == "{" and x[i] == owner:  # an initialiser, or a record's compact constructor
            opened = i if x[i] == "{" else i + 1
            close = t.match.get(opened, opened)
            self.inside(opened + 1, close, owner, fields)
            return close + 1
        if x[i] == "<":
            i = t.angles(i) or i + 1
            i = self.annotations(i)
        simple = ""
        if not (t.word(i) and x[i + 1] == "(" and x[i] not in JAVA_NOT_CALLED):
            found = self.type(i)
            if not found or not t.word(found[0]):
                return self.skipped(i)
            i, simple = found
        if x[i + 1] == "(":
            close = t.match.get(i + 1)
            if close is None:
                return i + 2
            j = close + 1
            while x[j] == "[":
                j = self.skipped(j)
            if x[j] == "throws":
                j = self.until(j, end, "{", ";")
            if x[j] == "{" or x[j] == ";" and simple:
                stop = t.match.get(j, end - 1) + 1 if x[j] == "{" else j + 1
                if keep:
                    self.found.append(Function(x[i], owner, begin, j if x[j] == "{" else None, stop, fields))
                return stop
            return self.until(j, end, ";") + 1 if x[j] == "default" else j
        if x[i + 1] not in ("=", ";", ",", "["):
            return self.skipped(i)
        stop = self.until(i + 1, end, ";")
        if declare:
            fields[x[i]] = simple
            k = i + 1
            while k < stop:
                if x[k] == "," and t.word(k + 1) and x[k + 2] in ("=", ",", ";", "["):
                    fields[x[k + 1]] = simple
                k = self.skipped(k)
        self.inside(i + 1, stop, owner, fields)
        return stop + 1


def java_variables(t: Tokens, i: int, end: int) -> dict[str, str]:
    """PAR-17: variables and parameters declared between two tokens, and their simple type names; the last declaration of a name holds."""
    reader, x, kind, found = Java(t), t.x, t.kind, {}
    for k in range(i, end):
        if kind[k] != "word" or kind[k + 1] != "word" and x[k + 1] not in ("<", ".", "[", "...", "@"):  # no name can follow
            continue
        if k > i and x[k - 1] not in (";", "{", "}", "(", ",", "final", "instanceof", ":", "->", "|") and not (x[k - 1] == ")" and t.match.get(k - 1, 0) > 1 and x[t.match[k - 1] - 2] == "@"):
            continue
        if t.word(k) and x[k] not in JAVA_NOT_TYPES and (type_ := reader.type(k)):
            j, simple = type_
            first = True
            while t.word(j) and x[j] not in JAVA_NOT_TYPES and x[j + 1] in ("=", ";", ":", ",", ")", "[", "&&"):
                found[x[j]] = simple
                stop = reader.until(j + 1, end, ";", ",") if x[j + 1] in ("=", ",", "[") else end
                if not first and x[j + 1] == ")" or stop >= end or x[stop] != "," or not (t.word(stop + 1) and x[stop + 2] in ("=", ",", ";")) or x[k - 1] in ("(", ","):
                    break
                j, first = stop + 1, False
    return found


class Script:
    """JavaScript and TypeScript."""

    def __init__(self, t: Tokens):
        self.t, self.x, self.found = t, t.x, []

    def read(self) -> None:
        self.walk(0, self.t.n, "", {})

    def skipped(self, i: int) -> int:
        return self.t.match.get(i, i) + 1 if self.x[i] in OPEN else i + 1

    def walk(self, i: int, end: int, owner: str, fields: dict[str, str]) -> None:
        """Functions and classes anywhere between two tokens."""
        while i < end:
            i = max(self.item(i, end, owner, fields), i + 1)

    def item(self, i: int, end: int, owner: str, fields: dict[str, str]) -> int:
        x, t, before = self.x, self.t, self.x[i - 1] if i else ""
        if t.kind[i] == "word":
            if before in (".", "?."):
                return i + 1
            if x[i] == "class" and (t.word(i + 1) or x[i + 1] == "{"):
                return self.class_(i, end, owner)
            if x[i] == "function":
                return self.function(i, end, owner, fields)
            if x[i] == "interface" and t.word(i + 1) and not t.broken[i + 1]:
                k = i + 2
                while k < end and x[k] != "{":
                    k = (t.angles(k) or k + 1) if x[k] == "<" else k + 1
                return self.skipped(k)
            if x[i] == "type" and t.word(i + 1) and x[i + 2] in ("=", "<"):
                k = (t.angles(i + 2) or i + 3) if x[i + 2] == "<" else i + 2
                return self.type(k + 1, end) if x[k] == "=" else k
            if x[i] in ("as", "satisfies") and i and (t.word(i - 1) or before in CLOSE or t.kind[i - 1] == "string"):
                return self.type(i + 1, end)
            if x[i] in ("const", "let", "var") and t.word(i + 1) and x[i + 2] == ":":
                return self.type(i + 3, end)
        if (arrow := self.arrow(i)) is not None:
            name, begin = self.named(i)
            body = arrow + 1
            stop = t.match.get(body, end - 1) + 1 if x[body] == "{" else self.expression_end(body, end)
            self.found.append(Function(name, owner, begin, body, stop, fields))
            return stop
        if before in ("{", ",") and (method := self.method(i)):
            name, body = method
            if x[name] not in CONTROL:
                stop = t.match.get(body, end - 1) + 1
                self.found.append(Function(self.text(name), owner, i, body, stop, fields))
                return stop
        if x[i] == "<" and t.word(i - 1) and (after := t.angles(i)) and x[after] == "(":
            return after
        return i + 1

    def text(self, i: int) -> str:
        """A name, without the quotes of a string."""
        return self.x[i][1:-1] if self.t.kind[i] == "string" else self.x[i]

    def type(self, i: int, end: int, returned: bool = False) -> int:
        """After the type at i. What an arrow returns cannot itself be a function's type without parentheses."""
        x, t = self.x, self.t
        while x[i] in ("|", "&"):
            i += 1
        while i < end:
            if x[i] in ("keyof", "typeof", "readonly", "unique", "infer", "asserts", "new", "abstract", "-") and (t.kind[i + 1] != "mark" or x[i + 1] in OPEN):
                i += 1
                continue
            if x[i] == "<":  # parameters of a function's type
                i = t.angles(i) or i + 1
                continue
            if x[i] in OPEN:
                i = self.skipped(i)
                while t.kind[i] == "string" and x[i - 1] == "}" and x[i][-1:] == "`":
                    i += 1
            elif t.kind[i] in ("word", "number", "string"):
                i += 1
            else:
                return i
            while True:
                if x[i] == "." and t.word(i + 1):
                    i += 2
                elif x[i] == "<" and (after := t.angles(i)):
                    i = after
                elif x[i] == "[" and not t.broken[i]:
                    i = self.skipped(i)
                else:
                    break
            if x[i] in ("|", "&", "is", "extends") or x[i] == "=>" and not returned:
                i += 1
            elif x[i] == "?" or x[i] == ":" and self._conditional(i):
                i += 1
            else:
                return i
        return i

    def _conditional(self, i: int) -> bool:
        """Whether the colon at i belongs to a conditional type: some tokens before it stand `extends` and a question mark."""
        depth = i - 1
        while depth > 0 and self.x[depth] not in (";", "{", "=", ","):
            if self.x[depth] == "?":
                return "extends" in self.x[max(0, depth - 12) : depth]
            depth = self.t.match[depth] - 1 if self.x[depth] in CLOSE and depth in self.t.match else depth - 1
        return False

    def arrow(self, i: int) -> int | None:
        """Where the => is, if the parameters of an arrow function begin at i."""
        x, t, p = self.x, self.t, i
        if x[p] == "async" and not t.broken[p + 1] and x[p + 1] != "=>":
            p += 1
        if x[p] == "<":
            p = t.angles(p) or p
        if x[p] == "(" and p in t.match:
            after = t.match[p] + 1
            if x[after] == ":" and (not i or x[i - 1] != "?"):
                after = self.type(after + 1, t.n, returned=True)
            return after if x[after] == "=>" else None
        return p + 1 if t.word(p) and x[p + 1] == "=>" and x[p] not in OPERATORS else None

    def named(self, i: int) -> tuple[str, int]:
        """What the value at i is assigned to, with the token at which that declaration begins; no name and i if it is not."""
        x, t, k = self.x, self.t, i - 1
        if k > 0 and x[k] == "=":
            k -= 1
            if not (t.word(k) and (x[k - 1] in ("const", "let", "var", ".", ",", ";", "{", "}", "") or x[k - 1] in SCRIPT_MODIFIERS or t.broken[k])):
                # a type stands between the name and its value
                while k > 0 and x[k] not in (":", ";", "const", "let", "var"):
                    k = t.match[k] - 1 if x[k] in CLOSE and k in t.match else k - 1
                k = k - 1 if x[k] == ":" else -1
            if t.word(k):
                return x[k], k - 1 if x[k - 1] in ("const", "let", "var") else k
        elif k > 0 and x[k] == ":" and (t.word(k - 1) or t.kind[k - 1] == "string") and x[k - 2] in ("{", ","):
            return self.text(k - 1), k - 1
        return "", i

    def function(self, i: int, end: int, owner: str, fields: dict[str, str]) -> int:
        """A function of its own name or the name of what it is assigned to; one without a name is looked into."""
        x, t = self.x, self.t
        first = i - 1 if x[i - 1] == "async" and i else i
        p = i + 1 + (x[i + 1] == "*")
        name, begin = (x[p], first) if t.word(p) else self.named(first)
        p += t.word(p)
        p = (t.angles(p) or p) if x[p] == "<" else p
        if x[p] != "(" or p not in t.match:
            return i + 1
        after = t.match[p] + 1
        if x[after] == ":":
            after = self.type(after + 1, end)
        if x[after] != "{":
            return after
        stop = t.match.get(after, end - 1) + 1
        if not name:
            return after + 1
        self.found.append(Function(name, owner, begin, after, stop, fields))
        return stop

    def method(self, i: int) -> tuple[int, int] | None:
        """Tokens of the name and of the body's brace, if a method is defined at i."""
        x, t, p = self.x, self.t, i
        while x[p] in SCRIPT_MODIFIERS and x[p + 1] not in ("(", ",", ":", "=", "}", "<", "?", ";"):
            p += 1
        p += x[p] == "*"
        name = p
        if x[p] == "[" and p in t.match:
            p = t.match[p] + 1
        elif t.kind[p] in ("word", "string", "number"):
            p += 1
        else:
            return None
        p += x[p] in ("?", "!")
        p = (t.angles(p) or p) if x[p] == "<" else p
        if x[p] != "(" or p not in t.match:
            return None
        after = t.match[p] + 1
        if x[after] == ":":
            after = self.type(after + 1, t.n)
        return (name, after) if x[after] == "{" else None

    def class_(self, i: int, end: int, owner: str) -> int:
        x, t = self.x, self.t
        own = t.word(i + 1) and x[i + 1] not in ("extends", "implements")
        name = x[i + 1] if own else self.named(i)[0] or owner
        k = i + 1 + own
        while k < end and x[k] != "{":
            k = (t.angles(k) or k + 1) if x[k] == "<" else self.skipped(k)
        close = t.match.get(k, end)
        fields: dict[str, str] = {}
        p = k + 1
        while p < close:
            p = max(self.member(p, close, name, fields), p + 1)
        return close + 1

    def simple_type(self, i: int, end: int) -> str | None:
        """The name of the type at i, if it is one name with or without arguments."""
        x, t = self.x, self.t
        after = self.type(i, end)
        k = i + 1
        if x[k] == "<":
            k = t.angles(k) or k
        return x[i] if t.word(i) and k == after and x[i] not in PREDEFINED else None

    def member(self, i: int, end: int, owner: str, fields: dict[str, str]) -> int:
        """Reads the member of a class at i and says where the next begins."""
        x, t, begin = self.x, self.t, i
        if x[i] == ";":
            return i + 1
        while x[i] == "@" and t.word(i + 1):
            i += 2
            while x[i] == "." and t.word(i + 1):
                i += 2
            if x[i] == "(":
                i = self.skipped(i)
        if x[i] == "static" and x[i + 1] == "{":
            close = t.match.get(i + 1, end)
            self.walk(i + 2, close, owner, fields)
            return close + 1
        if method := self.method(i):
            name, body = method
            stop = t.match.get(body, end - 1) + 1
            if x[name] == "constructor":
                self.constructor(name, body, stop, fields)
            self.found.append(Function("" if x[name] == "[" else self.text(name), owner, begin, body, stop, fields))
            return stop
        while x[i] in SCRIPT_MODIFIERS and (t.kind[i + 1] in ("word", "string") or x[i + 1] == "["):
            i += 1
        name = i
        if x[i] in OPEN and i not in t.match:
            return i + 1
        i = self.skipped(i)
        if x[i] in ("?", "!"):
            i += 1
        i = (t.angles(i) or i) if x[i] == "<" else i
        if x[i] == "(":  # a signature without a body
            i = self.skipped(i)
            i = self.type(i + 1, end) if x[i] == ":" else i
            return i + 1 if x[i] == ";" else i
        if x[i] == ":":
            if t.word(name) and (kind := self.simple_type(i + 1, end)):
                fields[x[name]] = kind
            i = self.type(i + 1, end)
        if x[i] != "=":
            return i + 1 if x[i] in (";", ",") else i
        stop = self.expression_end(i + 1, end)
        if x[i + 1] == "new" and t.word(i + 2) and x[name] not in fields:
            fields[x[name]] = self.last_name(i + 2)
        arrow = self.arrow(i + 1)
        if arrow is not None:
            self.found.append(Function(self.text(name), owner, begin, arrow + 1, stop, fields))
        else:
            self.walk(i + 1, stop, owner, fields)
        return stop

    def last_name(self, i: int) -> str:
        while self.x[i + 1] == "." and self.t.word(i + 2):
            i += 2
        return self.x[i]

    def constructor(self, name: int, body: int, stop: int, fields: dict[str, str]) -> None:
        """PAR-18: types of a constructor's parameters, and of fields that get a new object in it."""
        x, t = self.x, self.t
        opened = name + 1
        k = opened + 1
        while k < t.match.get(opened, opened):
            if t.word(k) and x[k + 1] in (":", "?") and (kind := self.simple_type(k + (3 if x[k + 1] == "?" else 2), t.n)):
                fields[x[k]] = kind
            k = self.skipped(k) if x[k] != ":" else max(self.type(k + 1, t.n), k + 1)
        fields.update(self.created(body, stop))

    def created(self, i: int, end: int) -> dict[str, str]:
        """PAR-18: names that get a new object, and its class."""
        return {self.x[k]: self.last_name(k + 3) for k in range(i, end - 2) if self.t.word(k) and self.x[k + 1] == "=" and self.x[k + 2] == "new" and self.t.word(k + 3)}

    def expression_end(self, i: int, end: int) -> int:
        """Where the expression at i ends: before a comma, a semicolon, a closing bracket, or a line that begins anew."""
        x, t, first = self.x, self.t, i
        while i < end and x[i] not in (",", ";") and x[i] not in CLOSE:
            if i > first and t.broken[i] and self._ends(i - 1) and (t.kind[i] in ("word", "string", "number") and x[i] not in ("in", "instanceof", "as", "of", "satisfies") and not x[i].startswith("`") or x[i] in ("@", "*", "[")):
                return i
            i = self.skipped(i)
        return min(i, end)

    def _ends(self, i: int) -> bool:
        """Whether an expression can end with token i."""
        return self.t.kind[i] in ("string", "number") or self.t.kind[i] == "word" and self.x[i] not in OPERATORS or self.x[i] in CLOSE or self.x[i] in ("++", "--")

    def imports(self) -> dict[str, str]:
        """PAR-18: imported and required names of the file; an alias stands for what it renames."""
        x, t, found, i = self.x, self.t, {}, 0
        while i < t.n:
            if x[i] == "import" and x[i + 1] not in ("(", "."):
                i += 1
                i += x[i] == "type" and x[i + 1] not in ("from", ",")
                while i < t.n and x[i] not in ("from", ";") and t.kind[i] != "string":
                    if x[i] == "{":
                        found.update(self.bound(i, "as"))
                    elif x[i] == "*" and x[i + 1] == "as":
                        found[x[i + 2]] = x[i + 2]
                        i += 2
                    elif t.word(i):
                        found[x[i]] = x[i]
                    i = self.skipped(i)
            elif x[i] in ("const", "let", "var"):
                target = i + 1
                after = self.skipped(target)
                if x[after : after + 3] == ["=", "require", "("]:
                    found.update(self.bound(target, ":") if x[target] == "{" else {x[target]: x[target]})
                i = after
            else:
                i = self.skipped(i) if x[i] in OPEN else i + 1
        return found

    def bound(self, opened: int, alias: str) -> dict[str, str]:
        """Names bound between braces: import { name as alias } is known by its name, const { key: name } by the bound name."""
        x, found, part = self.x, {}, []
        for k in range(opened + 1, self.t.match.get(opened, opened) + 1):
            if x[k] in (",", "}"):
                if part and part[0] == "type" and len(part) > 1 and part[1] != alias:
                    part = part[1:]
                if len(part) >= 3 and part[1] == alias:
                    found[part[2]] = part[0] if alias == "as" else part[2]
                elif part and part[0] != "...":
                    found[part[0]] = part[0]
                part = []
            else:
                part.append(x[k])
        return found


def calls(t: Tokens, i: int, end: int, types: dict[str, str]) -> list[str]:
    """PAR-14 to PAR-16: distinct calls between two tokens, outer ones first, as `Receiver.method` or `method`. A receiver whose type is known is called by it; constructors count by their class."""
    x, kind, found, reserved = t.x, t.kind, [], NOT_CALLED if t.script else JAVA_NOT_CALLED
    for p in range(i, end):
        if x[p] == "new" and t.word(p + 1) and x[p - 1] != ".":
            q = p + 1
            while x[q + 1] == "." and t.word(q + 2):
                q += 2
            after = (t.angles(q + 1) or q + 1) if x[q + 1] == "<" else q + 1
            if t.script or x[after] == "(":
                found.append((p, -t.match.get(after, q), x[q]))
            continue
        n = p - 1
        if x[p] == "(":
            n -= x[n] == "?." or t.script and x[n] == "!"
            if x[n] == ">":
                opened = t.angles_back(n)
                n = -1 if opened is None or opened <= i else opened - 1
        elif not (t.script and kind[p] == "string" and x[p][0] == "`" and not t.broken[p]):
            continue
        if n < i or not t.word(n):
            continue
        dot, close = n - 1, t.match.get(p, p)
        if not t.script and x[dot] == ">" and (opened := t.angles_back(dot)) is not None and x[opened - 1] == ".":
            dot = opened - 1
        if x[dot] not in (".", "?."):
            if x[n] not in reserved and not _declares(t, n, close) and not _constructs(t, n):
                found.append((n, -close, x[n]))
            continue
        if dot < i or _constructs(t, n):
            continue
        first, receiver = _receiver(t, dot, i)
        receiver = types.get(receiver, receiver)
        found.append((first, -close, f"{receiver}.{x[n]}" if receiver else x[n]))
    return list(dict.fromkeys(ref for _, _, ref in sorted(found)))


def _constructs(t: Tokens, n: int) -> bool:
    """Whether the name that ends at n is what `new` makes."""
    while t.x[n - 1] == "." and t.word(n - 2):
        n -= 2
    return t.x[n - 1] == "new" and t.x[n - 2] != "."


def _declares(t: Tokens, n: int, close: int) -> bool:
    """Whether the name at n, with parameters that close at close, is being declared."""
    after = t.x[close + 1]
    if not t.script:
        return after in ("{", "throws")
    if t.x[n - 1] == "function" or t.x[n - 2 : n] == ["function", "*"]:
        return True
    if after == "{" or after == ":" and t.x[n - 1] in ("{", ",", "async", "get", "set", "*"):
        return not t.broken[close + 1]
    return after == "=>" and t.x[n] == "async"


def _receiver(t: Tokens, dot: int, least: int) -> tuple[int, str]:
    """Where the operand before the dot begins, and the name it goes by: the last of its chain, in scripts the one after `this`."""
    x, q, parts, start = t.x, dot - 1, [], dot
    while q >= least:
        if t.script and x[q] == "!":
            q -= 1
        if x[q] in CLOSE:
            opened = t.match.get(q)
            if opened is None or opened < least:
                break
            start, before = opened, opened - 1
            if x[before] == ">" and (angle := t.angles_back(before)) is not None:
                before = angle - 1
            if x[q] == "}" and x[before] == ")" or x[q] == "]" and (t.word(before) and x[before] not in OPERATORS or x[before] in CLOSE):
                q = before
                continue
            if x[q] != ")" or not t.word(before) or x[before] in (NOT_CALLED if t.script else JAVA_NOT_CALLED) - {"this", "super"}:
                parts.append("")
                break
            q = before
        if t.kind[q] == "string" or not t.word(q):
            parts.append("")
            start = q if t.kind[q] in ("string", "number") else start
            break
        parts.append(x[q])
        start = q
        if x[q - 1] in (".", "?.") and q - 2 >= least:
            q -= 2
            continue
        start -= x[q - 1] == "new"
        break
    parts.reverse()
    return start, (parts[1] if t.script and parts[0] == "this" and len(parts) > 1 else parts[-1]) if parts else ""
