"""Scalar functions over queries, code and chat text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word lists, tables and patterns that results depend on.
CJK = "぀-ゟ゠-ヿ一-鿿"
IDENTIFIER = f"[a-zA-Z_{CJK}][a-zA-Z0-9_{CJK}]+"
CHAIN_WORDS = ["调用", "谁调用", "被调用", "呼び出", "caller", "who calls"]
IMPACT_WORDS = ["影响", "依赖", "影響", "依存", "impact", "affect", "depend"]
CHAT_WORDS = {
    "impact": ["影响", "impact", "affect", "改了会", "波及", "影響", "依赖"],
    "similar": ["相似", "类似", "similar", "一样的", "類似", "有没有类似"],
    "bug": ["bug", "问题", "缺陷", "风险", "隐患", "バグ", "漏洞"],
    "docs": ["文档", "document", "注释", "ドキュメント", "生成文档"],
}
CODE_WORDS = [
    "代码", "方法", "函数", "类", "变量", "参数", "返回", "调用", "实现",
    "逻辑", "循环", "判断", "异常", "报错", "性能", "优化", "重构",
    "行", "这段", "这个", "这里", "上面", "下面", "怎么", "为什么",
    "什么意思", "作用", "功能", "流程", "接口", "数据库", "SQL",
    "code", "method", "function", "class", "variable", "param", "return",
    "call", "implement", "logic", "loop", "error", "bug", "performance",
    "refactor", "line", "this", "how", "why", "what", "explain",
    "コード", "メソッド", "関数", "クラス", "変数", "なぜ", "どう",
]
STRUCTURE_TAGS = ["FILE", "CLASS", "METHOD", "SIGNATURE", "ANNOTATIONS", "CALLS", "COMMENT"]
MARKDOWN_LANGUAGE = {"java": "java", "py": "python", "ts": "typescript", "js": "javascript", "go": "go", "kt": "kotlin", "rs": "rust", "cpp": "cpp", "cs": "csharp", "vue": "vue", "sql": "sql", "sh": "bash"}
STATUS_KEYS = {0: "repo.status.not_indexed", 1: "repo.status.running", 2: "repo.status.done", 3: "repo.status.failed"}


def any_of(text: Column, words: list[str]) -> Column:
    """Whether text holds one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def identifiers(text: Column) -> Column:
    """SCL-1: identifiers and runs of kana and kanji of two characters or more."""
    return F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), 1)


def camel_spaced(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")


def split_identifier(ident: Column) -> Column:
    """SCL-2: parts of a camel-case or underscored name, lower-cased, of two characters or more; names with kana or kanji stay whole."""
    parts = F.split(F.trim(F.regexp_replace(F.replace(camel_spaced(ident), F.lit("_"), F.lit(" ")), r"\s+", " ")), " ")
    return F.when(ident.rlike(f"[{CJK}]"), F.array(ident)).otherwise(F.transform(F.filter(parts, lambda p: F.length(p) >= 2), F.lower))


def expanded_tokens(text: Column) -> Column:
    return F.flatten(F.transform(identifiers(text), split_identifier))


def query_language(text: Column) -> Column:
    """SCL-3: ja with any kana, zh beyond 40 % kanji, en beyond 50 % ASCII letters or if empty, else mixed."""
    n = F.length(text)
    return (
        F.when(text.isNull() | (n == 0), "en")
        .when(text.rlike("[぀-ゟ゠-ヿ]"), "ja")
        .when(F.regexp_count(text, F.lit("[一-鿿]")) / n > 0.4, "zh")
        .when(F.regexp_count(text, F.lit("[a-zA-Z]")) / n > 0.5, "en")
        .otherwise("mixed")
    )


def needs_expansion(language: Column) -> Column:
    """SCL-4"""
    return language.isin("zh", "ja", "mixed")


def search_intent(text: Column) -> Column:
    """SCL-5: call_chain, impact, symbol_lookup (an identifier, four words at most, no kana or kanji) or semantic."""
    low = F.lower(text)
    n_words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    short = text.rlike(IDENTIFIER) & (n_words <= 4) & ~text.rlike(f"[{CJK}]")
    return F.when(any_of(low, CHAIN_WORDS), "call_chain").when(any_of(low, IMPACT_WORDS), "impact").when(short, "symbol_lookup").otherwise("semantic")


def chat_intent(text: Column) -> Column:
    """SCL-6: the first of impact, similar, bug, docs of which a keyword occurs, else chat."""
    low, out = F.lower(text), None
    for intent, words in CHAT_WORDS.items():
        out = F.when(any_of(low, words), intent) if out is None else out.when(any_of(low, words), intent)
    return out.otherwise("chat")


def is_code_related(text: Column) -> Column:
    """SCL-7"""
    return (F.length(text) >= 5) & any_of(F.lower(text), [w.lower() for w in CODE_WORDS])


def clean_expansion(text: Column) -> Column:
    """SCL-8: the ASCII words of two characters or more, joined by one space."""
    return F.array_join(F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"^[\x00-\x7F]{2,}$")), " ")


def clean_hypothesis(text: Column) -> Column:
    """SCL-9: without code fences, trimmed; empty if under ten characters."""
    bare = F.trim(F.regexp_replace(text, r"(?m)^```\w*\s*|\s*```$", ""))
    return F.when(F.length(bare) < 10, "").otherwise(bare)


def bm25_tokens(text: Column) -> Column:
    """SCL-10: whole identifiers, then their parts, lower-cased, each once, in order; structure tags left out."""
    bare = F.regexp_replace(text, r"\[(?:" + "|".join(STRUCTURE_TAGS) + r")\]", " ")
    whole = F.transform(F.regexp_extract_all(bare, F.lit("([a-zA-Z_][a-zA-Z0-9_]+)"), 1), F.lower)
    parts = F.filter(F.split(F.regexp_replace(camel_spaced(bare), "[^a-zA-Z0-9]+", " "), " "), lambda t: F.length(t) >= 2)
    both = F.array_distinct(F.concat(whole, F.transform(parts, F.lower)))
    return F.array_except(both, F.array(*[F.lit(t.lower()) for t in STRUCTURE_TAGS]))


def estimate_tokens(text: Column) -> Column:
    """SCL-11"""
    return F.floor(F.length(text) / 3)


def truncate_code(code: Column, max_tokens: int) -> tuple[Column, Column]:
    """SCL-12: code up to the last line that fits into the budget of three characters a token, and whether it was cut."""
    cut = estimate_tokens(code) > max_tokens
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("kept"))
    step = lambda s, x: F.struct((s["used"] + F.length(x) + 1).alias("used"), F.when(s["used"] + F.length(x) + 1 <= max_tokens * 3, s["kept"] + 1).otherwise(s["kept"]).alias("kept"))
    lines = F.split(code, "\n")
    return F.when(cut, F.array_join(F.slice(lines, F.lit(1), F.aggregate(lines, zero, step)["kept"]), "\n")).otherwise(code), cut


def confidence(mode: Column, output: Column) -> Column:
    """SCL-18: bug: 0.95 for a JSON array with elements, 0.75 for other JSON, 0.5 else; other modes by length, and 0.05 more with a code fence."""
    trimmed = F.trim(output)
    is_json = F.try_parse_json(trimmed).isNotNull()
    filled = F.size(F.from_json(F.when(trimmed.startswith("["), trimmed), "array<string>")) > 0
    bug = F.when(is_json & F.coalesce(filled, F.lit(False)), 0.95).when(is_json, 0.75).otherwise(0.5)
    score = F.least(F.lit(0.95), 0.60 + F.length(output) / 3000)
    return F.when(mode == "bug", bug).otherwise(F.round(F.when(output.contains("```"), F.least(F.lit(0.97), score + 0.05)).otherwise(score), 2))


def bug_json(output: Column) -> Column:
    """SCL-19: from the first `[` to the last `]`, without code fences; null if there is none."""
    found = F.regexp_extract(output, r"(?s)(\[.*\])", 1)
    return F.when(found != "", found)


def markdown_language(path: Column) -> Column:
    """SCL-20: by the lower-cased end after the last dot, which stands for itself if unknown; `text` without a dot."""
    end = F.lower(F.substring_index(path, ".", -1))
    table = F.create_map(*[F.lit(x) for kv in MARKDOWN_LANGUAGE.items() for x in kv])
    return F.when(path.contains("."), F.coalesce(table[end], end)).otherwise("text")


def repo_id(path: Column) -> Column:
    """SCL-21"""
    return F.substring(F.sha1(path), 1, 12)


def short_name(name: Column) -> Column:
    """SCL-22"""
    return F.substring_index(name, ".", -1)


def line_at(text: Column, offset: Column) -> Column:
    """SCL-23: number of the line, from 1, that holds the character at offset, from 0."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1


def forward_slashes(path: Column) -> Column:
    """SCL-24"""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def parse_list(text: Column) -> Column:
    """SCL-26: entries between commas or line ends, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, "[,\n]"), lambda x: F.trim(x)), lambda x: x != "")


def picked_numbers(text: Column, n: Column) -> Column:
    """SCL-16: numbers from 1 to n between commas or white space."""
    words = F.filter(F.split(text, r"[,，\s]+"), lambda w: w.rlike(r"^[0-9]{1,9}$"))
    return F.filter(F.transform(words, lambda w: w.cast("int")), lambda k: (k >= 1) & (k <= n))


def symbol_label(class_name: Column, name: Column) -> Column:
    return F.concat(F.when(F.coalesce(class_name, F.lit("")) != "", F.concat(class_name, F.lit("."))).otherwise(""), F.coalesce(name, F.lit("")))


def short_path(path: Column) -> Column:
    """SCL-27: the last two segments of a path with more than three."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 3, F.concat(F.lit("…/"), F.array_join(F.slice(parts, -2, 2), "/"))).otherwise(path)


def score_band(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.65, "mid").otherwise("low")


def percent(x: Column) -> Column:
    """SCL-29"""
    return F.round(x * 100, 0).cast("int")


def locale(query: Column, header: Column, accept: Column) -> Column:
    """SCL-30: query parameter, else header, if one of zh, en, ja; else the first accepted language that begins so; else en."""
    given = lambda c: F.when(F.lower(c).isin("zh", "en", "ja"), F.lower(c))
    tags = F.transform(F.split(accept, ","), lambda t: F.left(F.lower(F.trim(F.split(t, ";")[0])), F.lit(2)))
    return F.coalesce(given(query), given(header), F.try_element_at(F.filter(tags, lambda t: t.isin("zh", "ja", "en")), F.lit(1)), F.lit("en"))


def status_key(status: Column) -> Column:
    """SCL-32"""
    table = F.create_map(*[x for k, v in STATUS_KEYS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(table[status], F.lit("repo.status.unknown"))
