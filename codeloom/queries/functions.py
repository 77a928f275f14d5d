"""Queries of the scalar functions (SCL, PRJ) over conversations, pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.plans import chat as C
from codeloom.queries.shapes import duck, shape

QUERIES: dict = {}
CHAT = ("conv_id", "turn")


def over_chats(name: str, sql: str, **columns):
    """A query of functions of a turn's text."""

    def run(spark, d):
        rows = shape(spark, d, "chats")
        return rows.select(*CHAT, *[f(F.col("text")).alias(k) for k, f in columns.items()])

    QUERIES[name] = (run, duck(f"SELECT conv_id, turn, {sql} FROM chats", "chats"))


def any_like(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def joined(f):
    return lambda c: F.array_join(f(c), ",")


_IDENTS = f"regexp_extract_all(text, '{T.IDENTIFIER}')"
_CAMEL = "regexp_replace(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
_SPLIT = f"CASE WHEN regexp_matches(x, '[{T.CJK}]') THEN [x] ELSE list_transform(list_filter(regexp_split_to_array(replace({_CAMEL.format('x')}, '_', ' '), '\\s+'), lambda t: length(t) >= 2), lambda t: lower(t)) END"

over_chats("scl1_identifiers", f"array_to_string({_IDENTS}, ',') AS idents", idents=joined(T.identifiers))
over_chats("scl2_split_identifiers", f"array_to_string(flatten(list_transform({_IDENTS}, lambda x: {_SPLIT})), ',') AS tokens", tokens=joined(T.expanded_tokens))
over_chats("scl3_query_language", """CASE WHEN text IS NULL OR text = '' THEN 'en' WHEN regexp_matches(text, '[぀-ゟ゠-ヿ]') THEN 'ja' WHEN len(regexp_extract_all(text, '[一-鿿]')) / length(text) > 0.4 THEN 'zh'
    WHEN len(regexp_extract_all(text, '[a-zA-Z]')) / length(text) > 0.5 THEN 'en' ELSE 'mixed' END AS language""", language=T.query_language)
over_chats("scl4_needs_expansion", "CASE WHEN text IS NULL OR text = '' THEN false WHEN regexp_matches(text, '[぀-ゟ゠-ヿ]') THEN true WHEN len(regexp_extract_all(text, '[一-鿿]')) / length(text) > 0.4 THEN true ELSE len(regexp_extract_all(text, '[a-zA-Z]')) / length(text) <= 0.5 END AS needed", needed=lambda c: T.needs_expansion(T.query_language(c)))
over_chats("scl5_search_intent", f"""CASE WHEN {any_like('lower(text)', T.CHAIN_WORDS)} THEN 'call_chain' WHEN {any_like('lower(text)', T.IMPACT_WORDS)} THEN 'impact'
    WHEN regexp_matches(text, '{T.IDENTIFIER}') AND len(regexp_extract_all(text, '\\S+')) <= 4 AND NOT regexp_matches(text, '[{T.CJK}]') THEN 'symbol_lookup' ELSE 'semantic' END AS intent""", intent=T.search_intent)
over_chats("scl6_chat_intent", "CASE " + " ".join(f"WHEN {any_like('lower(text)', w)} THEN '{k}'" for k, w in T.CHAT_WORDS.items()) + " ELSE 'chat' END AS intent", intent=T.chat_intent)
over_chats("scl7_code_related", f"length(text) >= 5 AND {any_like('lower(text)', [w.lower() for w in T.CODE_WORDS])} AS related", related=T.is_code_related)
over_chats("scl8_clean_expansion", "array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_full_match(w, '[\\x00-\\x7F]{2,}')), ' ') AS words", words=T.clean_expansion)
over_chats("scl9_clean_hypothesis", "CASE WHEN length(trim(text)) < 10 THEN '' ELSE trim(text) END AS code", code=lambda c: T.clean_hypothesis(F.concat(F.lit("```java\n"), c, F.lit("\n```"))))
over_chats("scl10_bm25_tokens", f"""array_to_string(list_filter(list_distinct_ordered, lambda t: NOT list_contains(['file','class','method','signature','annotations','calls','comment'], t)), ',') AS tokens FROM (SELECT conv_id, turn,
    list_reduce(list_prepend([]::VARCHAR[], list_transform(list_concat(list_transform(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]+'), lambda t: lower(t)),
    list_transform(list_filter(regexp_split_to_array({_CAMEL.format('text')}, '[^a-zA-Z0-9]+'), lambda t: length(t) >= 2), lambda t: lower(t))), lambda t: [t])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_ordered FROM chats) --""", tokens=joined(T.bm25_tokens))
over_chats("scl11_token_estimate", "length(text) // 3 AS tokens", tokens=T.estimate_tokens)


def _truncated(spark, d):
    code, cut = T.truncate_code(F.col("text"), 100)
    return shape(spark, d, "documents").select("doc_id", code.alias("code"), cut.alias("was_cut"))


QUERIES["scl12_truncate_code"] = (_truncated, """
    WITH l AS (SELECT doc_id, text, length(text) // 3 > 100 AS was_cut, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
    u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS used FROM l)
    SELECT doc_id, CASE WHEN any_value(was_cut) THEN coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE used <= 300), '') ELSE any_value(text) END AS code, any_value(was_cut) AS was_cut FROM u GROUP BY doc_id""")

QUERIES["scl13_history_pairs"] = (lambda spark, d: C.trim_history(shape(spark, d, "chats"), 700).select("conv_id", "turn", "role", F.length("text").alias("n_chars")), duck("""+
    back AS (SELECT *, lag(role) OVER w AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM chats WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    ends AS (SELECT *, role = 'assistant' AND before = 'user' AS ends_pair FROM back),
    heads AS (SELECT *, coalesce(lead(ends_pair) OVER (PARTITION BY conv_id ORDER BY turn), false) AS begins_pair FROM ends),
    units AS (SELECT *, sum(CASE WHEN begins_pair THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS unit FROM heads),
    cost AS (SELECT conv_id, unit, sum(length(text) // 3) AS n, count(*) AS k, max(CASE WHEN role = 'user' THEN length(text) // 3 END) AS user_n FROM units GROUP BY 1, 2),
    run AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY unit) AS used FROM cost)
    SELECT u.conv_id, u.turn, u.role, CASE WHEN run.used > 700 AND u.role = 'assistant' THEN least(length(u.text), (700 - user_n) * 3)::INT + 6 ELSE length(u.text)::INT END AS n_chars
    FROM units u JOIN run ON u.conv_id = run.conv_id AND u.unit = run.unit WHERE run.used <= 700 OR (run.unit = 1 AND run.k = 2 AND 700 - user_n > 100)""", "chats"))


def _confidence(spark, d):
    rows = shape(spark, d, "chats")
    mode = F.when(F.col("role") == "assistant", "bug").otherwise("summary")
    output = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), F.lit('[{"severity": "high"}]')).when((F.col("role") == "assistant") & (F.col("turn") % 3 == 1), F.lit("[]")).otherwise(F.concat("text", F.when(F.col("turn") % 2 == 0, "```").otherwise("")))
    return rows.select(*CHAT, T.confidence(mode, output).alias("confidence"))


QUERIES["scl18_confidence"] = (_confidence, duck("""SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN 0.95::DOUBLE WHEN role = 'assistant' AND turn % 3 = 1 THEN 0.75::DOUBLE WHEN role = 'assistant' THEN 0.5::DOUBLE
    WHEN turn % 2 = 0 THEN round(least(0.97, least(0.95, 0.60 + (length(text) + 3) / 3000::DOUBLE) + 0.05), 2)::DOUBLE ELSE round(least(0.95, 0.60 + length(text) / 3000::DOUBLE), 2)::DOUBLE END AS confidence FROM chats""", "chats"))
over_chats("scl19_bug_json", "regexp_extract('```json' || chr(10) || 'x [{\"title\":\"' || length(text) || '\"}] y', '(\\[.*\\])', 1) AS found", found=lambda c: T.bug_json(F.concat(F.lit('```json\nx [{"title":"'), F.length(c), F.lit('"}] y'))))


def over_files(name: str, sql: str, **columns):
    def run(spark, d):
        return shape(spark, d, "files").select("page_id", *[f(F.col("path")).alias(k) for k, f in columns.items()])

    QUERIES[name] = (run, duck(f"SELECT page_id, {sql} FROM files", "files"))


_EXT = "lower(regexp_extract(path, '\\.([^.]*)$', 1))"
over_files("scl20_markdown_language", f"CASE WHEN NOT contains(path, '.') THEN 'text' WHEN {_EXT} = 'ts' THEN 'typescript' WHEN {_EXT} = 'py' THEN 'python' WHEN {_EXT} = 'js' THEN 'javascript' ELSE {_EXT} END AS language", language=T.markdown_language)
over_files("scl21_repo_id", "left(sha1(path), 12) AS repo", repo=T.repo_id)
over_files("scl22_short_name", "regexp_extract(path, '([^.]*)$', 1) AS short", short=T.short_name)
over_files("scl24_forward_slashes", "path AS fixed", fixed=lambda c: T.forward_slashes(F.replace(c, F.lit("/"), F.lit("\\"))))
over_files("scl27_short_path", "CASE WHEN len(string_split(path, '/')) > 3 THEN '…/' || string_split(path, '/')[-2] || '/' || string_split(path, '/')[-1] ELSE path END AS short", short=T.short_path)
QUERIES["scl23_line_of_offset"] = (lambda spark, d: shape(spark, d, "documents").select("doc_id", T.line_at(F.col("text"), F.floor(F.length("text") / 2).cast("int")).cast("long").alias("line")), "SELECT doc_id, len(string_split(left(text, length(text) // 2), chr(10))) AS line FROM documents")
QUERIES["scl14_match_symbols"] = (lambda spark, d: C.match_symbols(shape(spark, d, "chats"), shape(spark, d, "methods").select(F.split("name", "_")[0].alias("name")).distinct()), duck("""+n AS (SELECT DISTINCT string_split(name, '_')[1] AS name FROM methods), hit AS (SELECT conv_id, turn, name, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(name) DESC, name) AS k FROM chats JOIN n ON contains(lower(text), lower(name)))
    SELECT conv_id, turn, name, k AS place FROM hit WHERE k <= 5""", "chats", "methods"))
QUERIES["scl15_symbol_list"] = (lambda spark, d: C.symbol_list(shape(spark, d, "methods")), duck("""+r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_start, id) AS k FROM methods)
    SELECT file_path, string_agg(k || ' | ' || CASE WHEN class_name <> '' THEN class_name || '.' ELSE '' END || name || ' | L' || line_start || '-L' || line_end, chr(10) ORDER BY k) AS listing FROM r GROUP BY 1""", "methods"))
over_chats("scl16_picked_numbers", "array_to_string(list_filter([(turn + 1)::INT, (turn * 7)::INT, 3], lambda k: k >= 1 AND k <= 12), ',') AS picked", picked=lambda c: F.array_join(T.picked_numbers(F.concat_ws(", ", (F.col("turn") + 1).cast("string"), (F.col("turn") * 7).cast("string"), F.lit("x3"), F.lit("3")), F.lit(12)), ","))
QUERIES["scl17_symbol_code"] = (lambda spark, d: C.symbol_code(shape(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(2).alias("line_start"), F.lit(4).alias("line_end"), F.col("source").alias("class_name"), F.col("lang").alias("name"))).withColumnRenamed("id", "doc_id"), "SELECT doc_id, '// --- ' || source || '.' || lang || ' (L2-L4) ---' || chr(10) || array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS code FROM documents")
QUERIES["scl25_sparse_arrays"] = (lambda spark, d: shape(spark, d, "chunks").select("id", F.map_from_arrays(F.array(F.lit(1), F.lit(2)), F.array(F.col("line_start"), F.col("line_end"))).alias("m")).select("id", F.array_join(F.map_keys("m"), ",").alias("indices"), F.array_join(F.map_values("m"), ",").alias("vals")), duck("SELECT id, '1,2' AS indices, line_start || ',' || line_end AS vals FROM chunks", "chunks"))
QUERIES["scl26_parse_skip_dirs"] = (lambda spark, d: shape(spark, d, "repos").select("id", F.array_join(T.parse_list(F.concat(F.col("name"), F.lit(" , gen,\n a/b ,,"))), "|").alias("dirs")), duck("SELECT id, name || '|gen|a/b' AS dirs FROM repos", "repos"))
QUERIES["scl28_date_format"] = (lambda spark, d: shape(spark, d, "history").select("id", F.date_format("created_at", "MMM dd, HH:mm").alias("shown")), duck("SELECT id, strftime(created_at, '%b %d, %H:%M') AS shown FROM history", "history"))
QUERIES["scl29_percent"] = (lambda spark, d: shape(spark, d, "orders").select("o_orderkey", T.percent(F.col("o_totalprice") / 1e6).alias("pct")), "SELECT o_orderkey, round(o_totalprice / 1e6 * 100, 0)::INT AS pct FROM orders")
QUERIES["scl30_locale"] = (lambda spark, d: shape(spark, d, "documents").select("doc_id", T.locale(F.when(F.col("lang") == "de", "JA"), F.when(F.col("lang") == "es", "xx"), F.when(F.col("lang") == "fr", "fr, zh-CN;q=0.9").otherwise("en-US")).alias("locale")), "SELECT doc_id, CASE lang WHEN 'de' THEN 'ja' WHEN 'fr' THEN 'zh' ELSE 'en' END AS locale FROM documents")
QUERIES["scl31_messages"] = (lambda spark, d: C.messages(shape(spark, d, "repos").select("id", F.lit("greet.user").alias("key"), F.when(F.col("indexed") == 0, "ja").otherwise("en").alias("locale"), F.col("name").alias("value")), {"en": {"greet.user": "Hello {name}"}, "ja": {}}), duck("SELECT id, 'Hello ' || name AS message FROM repos", "repos"))
QUERIES["scl32_status_key"] = (lambda spark, d: shape(spark, d, "repos").select("id", T.status_key(F.col("indexed")).alias("key")), duck("SELECT id, CASE indexed WHEN 0 THEN 'repo.status.not_indexed' WHEN 1 THEN 'repo.status.running' WHEN 2 THEN 'repo.status.done' ELSE 'repo.status.failed' END AS key FROM repos", "repos"))
QUERIES["scl33_selection"] = (lambda spark, d: shape(spark, d, "documents").select("doc_id", C.selected_code(F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.lit("picked")), F.when(F.col("doc_id") % 3 == 1, F.lit(2)), F.when(F.col("doc_id") % 3 == 1, F.lit(3)), 5).alias("code")), "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'picked' WHEN 1 THEN array_to_string(string_split(text, chr(10))[2:3], chr(10)) ELSE array_to_string(string_split(text, chr(10))[1:5], chr(10)) END AS code FROM documents")
QUERIES["prj2_snippets"] = (lambda spark, d: shape(spark, d, "chunks").select("id", *[F.substring("text", 1, n).alias(f"first_{n}") for n in (200, 2000, 3000)]), duck("SELECT id, left(text, 200) AS first_200, left(text, 2000) AS first_2000, left(text, 3000) AS first_3000 FROM chunks", "chunks"))
QUERIES["prj3_defaults"] = (lambda spark, d: shape(spark, d, "methods").select("id", F.coalesce("chunk_type", F.lit("method")).alias("chunk_type")), duck("SELECT id, coalesce(chunk_type, 'method') AS chunk_type FROM methods", "methods"))
