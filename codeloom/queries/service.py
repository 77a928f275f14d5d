"""Queries of prompts, messages and events (LLM, STR) over conversations and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import parse as PR
from codeloom.plans import chat as C
from codeloom.plans import models as M
from codeloom.queries.shapes import duck, shape
from codeloom.sources.work import work_dir
from codeloom.streaming import events as E
from codeloom.streaming.frames import EVENTS, events_of_chunks

QUERIES: dict = {}

TEMPLATES = {"summary": "Sum up {file_path} L{line_start}-L{line_end} ({language})\n{call_context}\n{code}", "bug": "Find bugs in {file_path}\n{code}"}


def _requests(s, d):
    return shape(s, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "bug").otherwise("other").alias("mode"), F.concat("source", F.lit(".java")).alias("file_path"), F.lit(1).alias("line_start"), F.lit(9).alias("line_end"), F.col("text").alias("code"), F.lit("ctx").alias("call_context"))


QUERIES["llm4_prompts"] = (lambda s, d: C.prompts(_requests(s, d), TEMPLATES), "WITH d AS (SELECT *, string_split(text, chr(10)) AS lines FROM documents), c AS (SELECT *, CASE WHEN length(text) >= 72003 THEN array_to_string(lines[1:len(list_filter(range(1, len(lines) + 1), lambda i: list_sum(list_transform(lines[1:i], lambda l: length(l) + 1)) <= 72000))], chr(10)) || chr(10) || chr(10) || '... [cut]' ELSE text END AS code FROM d) SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'Find bugs in ' || source || '.java' || chr(10) || code ELSE 'Sum up ' || source || '.java L1-L9 (java)' || chr(10) || 'ctx' || chr(10) || code END AS prompt FROM c")


def _messages(s, d):
    turns = shape(s, d, "chats")
    asked = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question")).withColumn("code", F.lit("x = 1"))
    return C.chat_messages(asked, turns, "Code:\n{code}", 700).select("conv_id", F.size("messages").cast("long").alias("n"), F.col("messages")[0]["text"].alias("system"), F.element_at("messages", -1)["text"].alias("question"))


def _resolved(s, d):
    """Questions about one long file, whose symbols are those of the first file; the model picks the first."""
    symbols = shape(s, d, "methods")
    symbols = symbols.join(F.broadcast(symbols.agg(F.min("file_path").alias("file_path"))), "file_path", "left_semi")
    asked = shape(s, d, "chats").where("role = 'user'").select("conv_id", "turn", "text", F.repeat(F.concat("text", F.lit("\n")), 400).alias("code"), F.lit("chat").alias("intent"))
    found = C.smart_resolve(asked, symbols, lambda p: ["1"] * len(p))
    found = found.join(asked.select("conv_id", "turn", F.col("code").alias("whole")), ["conv_id", "turn"])
    return found.select("conv_id", "turn", C.needs_narrowing(F.col("whole"), F.col("intent")).alias("narrowed"), F.array_join("symbols", ",").alias("symbols"), F.md5("code").alias("code_md5"))


QUERIES["llm5_chat_messages"] = (_messages, None)
QUERIES["llm6_plain_chat"] = (lambda s, d: _messages(s, d).select("conv_id", "question"), duck("SELECT conv_id, arg_max(text, turn) AS question FROM chats GROUP BY 1", "chats"))
QUERIES["llm8_code_gating"] = (lambda s, d: shape(s, d, "chats").select("conv_id", "turn", C.injects_code(T.chat_intent(F.col("text")), T.is_code_related(F.col("text"))).alias("inject")), duck("SELECT conv_id, turn, (" + " OR ".join(f"contains(lower(text), '{w.lower()}')" for words in T.CHAT_WORDS.values() for w in words) + ") OR (length(text) >= 5 AND (" + " OR ".join(f"contains(lower(text), '{w.lower()}')" for w in T.CODE_WORDS) + ")) AS inject FROM chats", "chats"))
QUERIES["str1_events"] = (lambda s, d: E.answer_events(shape(s, d, "chats").withColumns({"resolved": F.col("conv_id") % 2 == 0, "card": F.col("conv_id") % 3 == 0, "failed": F.col("turn") % 4 == 2})), duck("""+e AS (SELECT conv_id, turn, unnest(['intent', CASE WHEN conv_id % 2 = 0 THEN 'smart_resolve' END, CASE WHEN conv_id % 3 = 0 THEN 'card' END, CASE WHEN turn % 4 <> 2 THEN 'text' END, CASE WHEN turn % 4 <> 2 THEN 'done' END, CASE WHEN turn % 4 = 2 THEN 'error' END]) AS kind, unnest([0, 1, 2, 3, 4, 5]) AS k FROM chats WHERE role = 'user')
    SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1)::INT AS seq, kind FROM e WHERE kind IS NOT NULL""", "chats"))
QUERIES["llm7_smart_resolve"] = (_resolved, duck("""+q AS (SELECT conv_id, turn, text, repeat(text || chr(10), 400) AS code FROM chats WHERE role = 'user'), y AS (SELECT * FROM methods WHERE file_path = (SELECT min(file_path) FROM methods)),
    m AS (SELECT DISTINCT q.conv_id, q.turn, y.name FROM q JOIN y ON contains(lower(q.text), lower(y.name)) WHERE y.name <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(name) DESC, name) AS k FROM m),
    n AS (SELECT DISTINCT r.conv_id, r.turn, y.id, y.line_start, y.line_end, y.class_name, y.name FROM r JOIN y USING (name) WHERE k <= 5), z AS (SELECT *, row_number() OVER (ORDER BY line_start, id) AS k FROM y), long AS (SELECT * FROM q WHERE length(code) // 3 > 6000),
    p AS (SELECT l.conv_id, l.turn, z.id, z.line_start, z.line_end, z.class_name, z.name FROM long l JOIN z ON z.k = 1 WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.conv_id = l.conv_id AND n.turn = l.turn)),
    f AS (SELECT n.* FROM n JOIN long USING (conv_id, turn) UNION ALL SELECT * FROM p),
    h AS (SELECT q.conv_id, q.turn, q.code, f.id, f.line_start, '// --- ' || class_name || '.' || name || ' (L' || line_start || '-L' || line_end || ') ---' || chr(10) || array_to_string(string_split(q.code, chr(10))[line_start:line_end], chr(10)) AS piece FROM q LEFT JOIN f USING (conv_id, turn)),
    s AS (SELECT conv_id, turn, code, coalesce(string_agg(id, ',' ORDER BY line_start, id), '') AS symbols, string_split(string_agg(piece, chr(10) || chr(10) ORDER BY line_start, id), chr(10)) AS x FROM h GROUP BY ALL),
    t AS (SELECT *, array_to_string(x, chr(10)) AS narrow, len(list_filter(range(1, len(x) + 1), lambda i: list_sum(list_transform(x[1:i], lambda l: length(l) + 1)) <= 36000)) AS kept FROM s)
    SELECT conv_id, turn, length(code) // 3 > 6000 AS narrowed, symbols, md5(CASE WHEN length(code) // 3 <= 6000 THEN code WHEN length(narrow) // 3 <= 12000 THEN narrow ELSE array_to_string(x[1:kept], chr(10)) || chr(10) || chr(10) || '... [代码过长，已截断]' END) AS code_md5 FROM t""", "chats", "methods"))
QUERIES["str2_docs_events"] = (lambda s, d: E.docs_events(shape(s, d, "methods")), duck("""+c AS (SELECT file_path, class_name, row_number() OVER (PARTITION BY file_path ORDER BY min(line_start), class_name) AS k FROM methods GROUP BY 1, 2), n AS (SELECT file_path, max(k) AS n FROM c GROUP BY 1)
    SELECT file_path, 0::BIGINT AS seq, 'header' AS kind, '' AS class_name FROM n UNION ALL SELECT file_path, 2 * k - 1, 'progress', class_name FROM c UNION ALL SELECT file_path, 2 * k, 'text', class_name FROM c UNION ALL SELECT file_path, 2 * n + 1, 'done', '' FROM n""", "methods"))
QUERIES["str3_frames"] = (lambda s, d: E.parse_frames(E.frames(shape(s, d, "events").select("user_id", "event_id", "event_type"))), "SELECT user_id, event_id, event_type FROM events")


def _streamed(s, d):
    """The frames of all users, cut into chunks of 500 characters, as a stream that runs to its end."""
    path = f"{work_dir(s)}/codeloom-tables/stream-{uuid.uuid4().hex}"
    text = E.frames(shape(s, d, "events").select("user_id", "event_id", "event_type"))
    last = F.greatest(F.ceil(F.length("text") / 500) - 1, F.lit(0))
    chunks = text.select(F.col("user_id").alias("connection"), "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seq"))
    chunks.select("connection", "seq", F.substr("text", (F.col("seq") * 500 + 1).cast("int"), F.lit(500)).cast("binary").alias("data")).write.parquet(f"{path}/in")
    source = s.readStream.schema("connection bigint, seq bigint, data binary").parquet(f"{path}/in")
    query = events_of_chunks(source, silence_ms=None).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out")
    query.awaitTermination()
    rows = s.read.schema(f"connection bigint, {EVENTS}").parquet(f"{path}/out")
    return rows.select(F.col("connection").alias("user_id"), F.from_json("payload", "event_id bigint, event_type string").alias("x")).select("user_id", "x.event_id", "x.event_type")


QUERIES["str3_stream_of_chunks"] = (_streamed, QUERIES["str3_frames"][1])
QUERIES["str4_index_progress"] = (lambda s, d: E.progress(shape(s, d, "repos")), duck("SELECT indexed, count(*) AS n, bool_and(indexed >= 2) AS finished FROM repos GROUP BY 1", "repos"))
QUERIES["par1_parse_files"] = (lambda s, d: PR.parse_files(shape(s, d, "pages").select(F.lit("r").alias("repo_id"), F.concat(F.col("page_id").cast("string"), F.lit(".vue")).alias("path"), F.lit("vue").alias("language"), F.col("html").alias("source"))).select("file_path", "pos", "line_start", "line_end", "chunk_type", "is_primary"), None)
QUERIES["par5_has_body"] = (lambda s, d: shape(s, d, "documents").select("doc_id", PR.solid_lines(F.col("text")).alias("n")), "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '' AND trim(l) NOT IN ('{', '}') AND NOT starts_with(trim(l), '*') AND NOT starts_with(trim(l), '//') AND NOT starts_with(trim(l), '/*') AND NOT starts_with(trim(l), '@')))::BIGINT AS n FROM documents")
QUERIES["par9_structured_text"] = (lambda s, d: PR.structured_column(shape(s, d, "methods")), duck("SELECT id, '[FILE] ' || file_path || CASE WHEN class_name <> '' THEN chr(10) || '[CLASS] ' || class_name ELSE '' END || chr(10) || '[METHOD] ' || name || chr(10) || '[SIGNATURE] ' || signature || chr(10) || chr(10) || signature || ' {}' AS text FROM methods", "methods"))
QUERIES["par10_signature"] = (lambda s, d: shape(s, d, "methods").select("id", PR.signature_of(F.concat("signature", F.lit(" { body }"))).alias("signature")), duck("SELECT id, signature FROM methods", "methods"))
QUERIES["par11_annotations"] = (lambda s, d: shape(s, d, "methods").select("id", F.array_join(PR.annotations_of(F.concat_ws("\n", F.lit("@A"), F.concat(F.lit("@"), "class_name", F.lit("(value = 'a, b', n = 1) @Open(x")), F.lit("@A x) @B()"), "signature")), ",").alias("notes")), duck("SELECT id, CASE WHEN class_name <> '' THEN '@A,@' || class_name || '(value = ''a, b'', n = 1),@Open,@B()' ELSE '@A,@Open,@B()' END AS notes FROM methods", "methods"))
QUERIES["par16_distinct_calls"] = (lambda s, d: shape(s, d, "calls").groupBy("caller").agg(F.array_sort(F.collect_list(F.struct("pos", "ref"))).alias("c")).select("caller", F.array_join(F.slice(F.array_distinct(F.transform("c", lambda x: x["ref"])), 1, 8), ",").alias("calls")), duck("SELECT caller, array_to_string(list(ref ORDER BY pos, ref)[1:8], ',') AS calls FROM calls GROUP BY 1", "calls"))
QUERIES["par21_token_count"] = (lambda s, d: shape(s, d, "documents").select("doc_id", PR.token_count(F.col("text")).alias("n")), "SELECT doc_id, len(regexp_extract_all(text, '[\\pL\\pN\\pM_]+|[^\\pL\\pN\\pM_\\s]'))::BIGINT AS n FROM documents")
QUERIES["par22_symbol_ids"] = (lambda s, d: PR.with_ids(shape(s, d, "methods").select("repo_id", "file_path", "is_primary", F.row_number().over(PR.by_file()).alias("pos"), F.col("id").alias("text"))).groupBy("repo_id", "file_path").agg(F.countDistinct("symbol_id").alias("n_symbols"), F.count_if("is_primary").alias("n_primary")), duck("SELECT repo_id, file_path, count_if(is_primary)::BIGINT AS n_symbols, count_if(is_primary)::BIGINT AS n_primary FROM methods GROUP BY 1, 2", "methods"))


def _asked(s, d):
    """Conversations as queries: German and Spanish stand for languages that are expanded."""
    return shape(s, d, "documents").select(F.col("doc_id").alias("query_id"), "text", F.when(F.col("lang") == "en", "en").otherwise("mixed").alias("language"), F.when(F.col("lang") == "fr", "impact").otherwise("call_chain").alias("intent"))


QUERIES["llm1_expansions"] = (lambda s, d: M.expansions(_asked(s, d), lambda p: ["user é login x"] * len(p)), "SELECT doc_id AS query_id, CASE WHEN lang = 'en' THEN '' ELSE 'user login' END AS expansion FROM documents")
QUERIES["llm2_hypotheses"] = (lambda s, d: M.hypotheses(_asked(s, d), lambda p: ["```java\nlogin(user, name)\n```"] * len(p)), "SELECT doc_id AS query_id, CASE WHEN lang = 'fr' THEN 'login(user, name)' ELSE '' END AS code FROM documents")
QUERIES["llm3_picked_symbols"] = (lambda s, d: M.picked_symbols(C.symbol_list(shape(s, d, "methods")).select(F.col("file_path").alias("id"), F.lit("which?").alias("question"), "listing", F.size(F.split("listing", "\n")).alias("n")), lambda p: ["1, 3, 9999"] * len(p)).select("id", F.array_join("picked", ",").alias("picked")), duck("SELECT file_path AS id, CASE WHEN count(*) >= 3 THEN '1,3' ELSE '1' END AS picked FROM methods GROUP BY 1", "methods"))
QUERIES["llm9_legacy_messages"] = (lambda s, d: M.legacy_messages(shape(s, d, "chats"), 3).select("conv_id", "turn"), duck("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM chats) WHERE k <= 3", "chats"))
QUERIES["top10_longest_names"] = (lambda s, d: C.match_symbols(shape(s, d, "chats"), shape(s, d, "benchmark").select(F.substring("text", 1, 4).alias("name"))).groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.max(F.length("name")).cast("long").alias("longest")), duck("""+n AS (SELECT DISTINCT left(text, 4) AS name FROM benchmark), hit AS (SELECT conv_id, turn, name, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(name) DESC, name) AS k FROM chats JOIN n ON contains(lower(text), lower(name)))
    SELECT conv_id, turn, count(*) AS n, max(length(name)) AS longest FROM hit WHERE k <= 5 GROUP BY 1, 2""", "chats"))
