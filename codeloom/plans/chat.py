"""Chat plans: history within a budget, symbols named in questions, prompts and messages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import estimate_tokens, markdown_language, symbol_label, truncate_code
from codeloom.operators.retrieval import known_kind
from codeloom.plans.models import Model, no_model, picked_symbols

#: Added to an answer that was cut; a cut answer keeps more than so many tokens.
CUT_MARK, LEAST_CUT = "…(cut)", 100
#: Prompts where the caller brings none.
TEMPLATES = {
    "summary": "Sum up {file_path} L{line_start}-L{line_end} ({language}).\n{call_context}\n{code}",
    "bug": "Find bugs in {file_path} ({language}); answer with a JSON array.\n{call_context}\n{code}",
    "deps": "What does {file_path} L{line_start}-L{line_end} depend on?\n{call_context}\n{code}",
    "docs": "Write documents for {file_path} ({language}).\n{call_context}\n{code}",
}


def trim_history(turns: DataFrame, budget: int) -> DataFrame:
    """SCL-13: of each conversation (conv_id, turn, role, text) the newest turns within a budget of tokens.

    A user's turn and the assistant's next go together. From the newest back, the first pair (or lone turn) that does not
    fit ends the history; if that is the newest pair, its answer is cut to what remains, if that is over LEAST_CUT tokens.
    """
    forward, back = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    ends = turns.withColumn("ends", F.coalesce((F.col("role") == "assistant") & (F.lag("role").over(forward) == "user"), F.lit(False)))
    begins = ends.withColumn("begins", F.coalesce(F.lead("ends").over(forward), F.lit(False)))
    tokens = estimate_tokens(F.col("text"))
    units = begins.withColumns({"unit": F.sum(F.when(F.col("begins"), 0).otherwise(1)).over(back), "tokens": tokens})
    own = Window.partitionBy("conv_id", "unit")
    # A unit's user turn comes after its answer when counted from the newest: the unit's end is the running sum's maximum.
    sized = units.withColumns({"used": F.sum("tokens").over(back), "n": F.count("*").over(own), "asked": F.max(F.when(F.col("role") == "user", F.col("tokens"))).over(own)})
    sized = sized.withColumn("used", F.max("used").over(own))
    left = budget - F.col("asked")
    cut = (F.col("used") > budget) & (F.col("unit") == 1) & (F.col("n") == 2) & (left > LEAST_CUT)
    text = F.when(cut & (F.col("role") == "assistant"), F.concat(F.substring(F.col("text"), F.lit(1), (left * 3).cast("int")), F.lit(CUT_MARK))).otherwise(F.col("text"))
    return sized.where((F.col("used") <= budget) | F.coalesce(cut, F.lit(False))).select("conv_id", "turn", "role", text.alias("text"))


#: Names of one automaton, and characters of the questions that are broadcast together.
NAMES_TOGETHER, QUESTION_CHARS = 200_000, 32_000_000
#: Rows that a task holds before it gives them on.
ROWS_TOGETHER = 20_000


def match_symbols(questions: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """SCL-14, TOP-10: names that occur in each question (conv_id, turn, text), whatever their case, the longest first, most at most.

    The names stay where Spark has them: each task makes automata of its own, of NAMES_TOGETHER names, and passes over the
    questions once for each. The questions are what is collected and broadcast, in blocks of QUESTION_CHARS characters; most
    names an automaton and question are shuffled. Questions with one key count as one; null texts hold no name.
    """
    names = symbols.select("name").where("name <> ''").distinct().select("name", F.lower("name").alias("key"))
    asked = questions.select("conv_id", "turn", F.lower("text").alias("text")).where("text is not null")
    blocks = -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // QUESTION_CHARS)
    kinds = [asked.schema[c].dataType.simpleString() for c in ("conv_id", "turn")] + ["string"]
    schema = "conv_id {}, turn {}, name {}".format(*kinds)
    arrow = pa.schema([(c, known_kind(k)) for c, k in zip(("conv_id", "turn", "name"), kinds, strict=True)])
    found = questions.sparkSession.createDataFrame([], schema)
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(blocks)) == k).collect()
        found = found.unionByName(names.mapInArrow(_names_in(questions.sparkSession.sparkContext.broadcast([tuple(r) for r in rows]), most, arrow), schema))
    order = Window.partitionBy("conv_id", "turn").orderBy(F.desc(F.length("name")), "name")
    return found.distinct().select("conv_id", "turn", "name", F.row_number().over(order).cast("long").alias("place")).where(F.col("place") <= most)


def _names_in(shared, most: int, schema: pa.Schema):
    """Passes over the questions of shared with each automaton of a task's names (name, key)."""

    def occurring(held: dict[str, list[str]]):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for key, names in held.items():
            automaton.add_word(key, names)
        automaton.make_automaton()
        out = []
        for conv, turn, text in shared.value:
            there = {name for _, names in automaton.iter(text) for name in names}
            out += [(conv, turn, name) for name in sorted(there, key=lambda n: (-len(n), n))[:most]]
            if len(out) >= ROWS_TOGETHER:
                yield out
                out = []
        yield out

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[str, list[str]] = {}

        def found():
            for rows in occurring(held):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 3, schema.types, strict=True)], schema=schema)

        for b in batches:
            for name, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(key, []).append(name)
            if len(held) >= NAMES_TOGETHER:
                yield from found()
                held = {}
        if held:
            yield from found()

    return run


def symbol_list(symbols: DataFrame) -> DataFrame:
    """SCL-15, FIL-7: each file's symbols in order of their lines, numbered."""
    order = Window.partitionBy("file_path").orderBy("line_start", "id")
    line = F.format_string("%d | %s | L%d-L%d", "k", symbol_label(F.col("class_name"), F.col("name")), "line_start", "line_end")
    rows = symbols.withColumn("k", F.row_number().over(order)).select("file_path", F.struct("k", line.alias("line")).alias("x"))
    return rows.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("listing"))


def symbol_code(rows: DataFrame) -> DataFrame:
    """SCL-17: the lines of a symbol (id, text, line_start, line_end, class_name, name) under a header."""
    lines = F.array_join(F.slice(F.split("text", "\n"), F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    head = F.format_string("// --- %s.%s (L%d-L%d) ---\n", "class_name", "name", "line_start", "line_end")
    return rows.select("id", F.concat(head, lines).alias("code"))


def selected_code(text: Column, selection: Column, first: Column, last: Column, most: int = 300) -> Column:
    """SCL-33: the selection, else the highlighted lines, else the first lines."""
    lines = F.split(text, "\n")
    part = lambda a, n: F.array_join(F.slice(lines, a, n), "\n")
    return F.coalesce(F.when(selection != "", selection), F.when(first.isNotNull(), part(first, last - first + 1)), part(F.lit(1), F.lit(most)))


def messages(rows: DataFrame, tables: dict[str, dict[str, str]]) -> DataFrame:
    """SCL-31: the message of each key (id, key, locale, value) in its locale, else in English, else the key, with {name} filled in."""
    flat = [F.lit(x) for loc, t in tables.items() for k, v in t.items() for x in (f"{loc}/{k}", v)]
    table = F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")
    at = lambda loc: table[F.concat_ws("/", loc, F.col("key"))]
    return rows.select("id", F.replace(F.coalesce(at(F.col("locale")), at(F.lit("en")), F.col("key")), F.lit("{name}"), F.col("value")).alias("message"))


def prompts(rows: DataFrame, templates: dict[str, str], max_tokens: int = 24000) -> DataFrame:
    """LLM-4: the prompt of each request (id, mode, file_path, line_start, line_end, code, call_context); unknown modes are summaries."""
    code, cut = truncate_code(F.col("code"), max_tokens)
    table = F.create_map(*[F.lit(x) for kv in templates.items() for x in kv])
    out = F.coalesce(table[F.col("mode")], table[F.lit("summary")])
    values = {"file_path": F.col("file_path"), "line_start": F.col("line_start").cast("string"), "line_end": F.col("line_end").cast("string"), "language": markdown_language(F.col("file_path")), "call_context": F.col("call_context"), "code": F.concat(code, F.when(cut, "\n\n... [cut]").otherwise(""))}
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return rows.select("id", out.alias("prompt"))


def budgets(has_repo_context: Column) -> tuple[Column, Column]:
    """LLM-5: tokens for code and for history."""
    return F.when(has_repo_context, 5000).otherwise(8000), F.when(has_repo_context, 6000).otherwise(8000)


def chat_messages(requests: DataFrame, turns: DataFrame, system: str, budget: int = 8000, code_budget: int | None = None) -> DataFrame:
    """LLM-5, LLM-6: system message, trimmed history and question of each request (conv_id, question, code), as one array; budgets in tokens of the history and of the code."""
    kept = trim_history(turns, budget).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("history"))
    code, _ = truncate_code(F.col("code"), code_budget or budget)
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    history = F.transform(F.coalesce("history", F.array().cast("array<struct<turn:bigint,role:string,text:string>>")), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    return requests.join(kept, "conv_id", "left").select("conv_id", F.concat(F.array(message("system", F.replace(F.lit(system), F.lit("{code}"), F.coalesce(code, F.lit(""))))), history, F.array(message("user", F.coalesce("question", F.lit(""))))).alias("messages"))


def injects_code(intent: Column, related: Column) -> Column:
    """LLM-8: code goes into the prompt unless the question is mere chat about something else."""
    return ~((intent == "chat") & ~related)


#: Fixed value: what ends code that was cut.
CUT_NOTE = "\n\n... [代码过长，已截断]"


def smart_resolve(rows: DataFrame, symbols: DataFrame, model: Model = no_model, named_tokens: int = 12000, whole_tokens: int = 8000) -> DataFrame:
    """LLM-7: code and symbols (ids) for each question (conv_id, turn, text, code, intent) about a file with these symbols (id, name, class_name, file_path, line_start, line_end).

    A file that is short enough goes whole, and so do questions about impact or similar code. Of a longer one the symbols
    that the question names are taken; if it names none, those that the model picks from the numbered list. Their lines go
    under headers, cut to named_tokens with a line that says so; where nothing is found, the file itself is cut to whole_tokens.
    """
    keys = ["conv_id", "turn"]
    long = rows.where(needs_narrowing(F.col("code"), F.col("intent")))
    named = match_symbols(long.select(*keys, "text"), symbols).join(symbols.select("id", "name"), "name").select(*keys, "id")
    listed = symbol_list(symbols).select("listing").first()
    order = Window.partitionBy("file_path").orderBy("line_start", "id")
    numbered = symbols.select("id", "file_path", F.row_number().over(order).alias("k"))
    rest = long.join(named.select(*keys).distinct(), keys, "left_anti")
    asked = rest.select(F.struct(*keys).alias("id"), F.col("text").alias("question"))
    picked = picked_symbols(asked if listed else asked.limit(0), model, listed.listing if listed else "").select("id.conv_id", "id.turn", F.explode("picked").alias("k")).join(numbered, "k").select(*keys, "id")
    found = named.union(picked).distinct().join(symbols, "id").join(long.select(*keys, "code"), keys)
    pieces = symbol_code(found.select(F.struct(*keys, "line_start", "id").alias("id"), F.col("code").alias("text"), "line_start", "line_end", "class_name", "name"))
    joined = pieces.groupBy("id.conv_id", "id.turn").agg(F.array_sort(F.collect_list(F.struct("id.line_start", F.col("id.id").alias("symbol"), "code"))).alias("x"))
    joined = joined.select(*keys, F.transform("x", lambda x: x["symbol"]).alias("symbols"), F.array_join(F.transform("x", lambda x: x["code"]), "\n\n").alias("narrow"))
    both = rows.join(joined, keys, "left")
    narrow, cut = truncate_code(F.col("narrow"), named_tokens)
    narrow = F.when(cut, F.concat(narrow, F.lit(CUT_NOTE))).otherwise(narrow)
    code = F.coalesce(narrow, truncate_code(F.col("code"), whole_tokens)[0])
    whole = ~needs_narrowing(F.col("code"), F.col("intent"))
    return both.select(*keys, "text", "intent", F.when(whole, F.col("code")).otherwise(code).alias("code"), F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"))


def needs_narrowing(code: Column, intent: Column) -> Column:
    """LLM-7: whether a file is so long that the symbols asked about are looked for."""
    return (estimate_tokens(code) > 6000) & ~intent.isin("similar", "impact")
