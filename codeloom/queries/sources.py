"""Queries of sources, filters over files, and the service's tables (SRC, FIL, TOP, AGG of files)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.config import Settings
from codeloom.operators import aggregates as A
from codeloom.plans import chat as C
from codeloom.queries.shapes import duck, shape
from codeloom.sources import files as S
from codeloom.sources import tables as T

QUERIES: dict = {}

_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_EXT = f"lower(regexp_extract({_NAME}, '^.+\\.([^.]*)$', 1))"
_LANG = f"CASE {_EXT} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.LANGUAGES.items()) + " END"
_DIRS = "string_split(path, '/')[1:-2]"
_SKIP = f"list_has_any({_DIRS}, [" + ", ".join(f"'{x}'" for x in S.SKIP_DIRS) + "])"
_LIST = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_OK = f"""(lower({_NAME}) NOT IN {_LIST(S.SKIP_FILES)} AND NOT ({' OR '.join(f"lower({_NAME}) LIKE '%{s}'" for s in S.SKIP_SUFFIXES)})
    AND NOT regexp_matches({_NAME}, '{S.VENDOR_VERSION}') AND {_EXT} IN {_LIST(S.INDEXED_EXTENSIONS)} AND ({_EXT} <> 'xml' OR lower({_NAME}) LIKE '%mapper.xml') AND size <= 500000)"""


def _files(name, sql, **columns):
    QUERIES[name] = (lambda spark, d: shape(spark, d, "files").select("page_id", *[f().alias(k) for k, f in columns.items()]), duck(f"SELECT page_id, {sql} FROM files", "files"))


P = lambda: F.col("path")
_files("src5_language", f"{_LANG} AS language", language=lambda: S.language(P()))
_files("src6_skip_dirs", f"{_SKIP} AS skipped", skipped=lambda: S.in_skipped_dir(P()))
_files("src7_custom_dirs", f"(list_contains({_DIRS}, 'en') OR starts_with(path, 'www.example.com/de/')) AS skipped", skipped=lambda: S.in_custom_dir(P(), ["en", "/www.example.com/de/"]))
_files("src8_indexable", f"{_OK} AS indexable", indexable=lambda: S.is_indexable(P(), F.col("size")))
_files("src3_line_count", "len(string_split(source, chr(10))) AS line_count, coalesce(" + _LANG + ", 'plaintext') AS language", line_count=lambda: F.size(F.split("source", "\n")).cast("long"), language=lambda: F.coalesce(S.language(P()), F.lit("plaintext")))
QUERIES["src1_code_files"] = (lambda spark, d: shape(spark, d, "files").where(S.is_indexable(P(), F.col("size")) & ~S.in_skipped_dir(P())).select("page_id", "path", S.language(P()).alias("language")), duck(f"SELECT page_id, path, {_LANG} AS language FROM files WHERE {_OK} AND NOT {_SKIP}", "files"))
QUERIES["src4_encodings"] = (lambda spark, d: T.encodings(shape(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1")).alias("raw"), "text")), None)
QUERIES["src2_file_tree"] = (lambda spark, d: S.tree(shape(spark, d, "files").select("path", "size").groupBy("path").agg(F.max("size").alias("size"))).select("path", "parent_path", "name", "type", F.col("depth").cast("long").alias("depth"), "size", "files"), duck(f"""+f AS (SELECT path, max(size) AS size, string_split(path, '/') AS p FROM files GROUP BY path), ok AS (SELECT * FROM f WHERE len(p) <= 8),
    d AS (SELECT array_to_string(p[1:k], '/') AS path, count(*) AS files FROM (SELECT p, unnest(range(1, len(p))) AS k FROM ok) GROUP BY 1)
    SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent_path, {_NAME} AS name, type, len(string_split(path, '/')) AS depth, size, files FROM (SELECT path, size, 'file' AS type, NULL::BIGINT AS files FROM ok UNION ALL SELECT path, NULL, 'dir', files FROM d)""", "files"))
QUERIES["top11_tree_order"] = (lambda spark, d: T.numbered(S.tree(shape(spark, d, "files").select("path", "size").groupBy("path").agg(F.max("size").alias("size")))).select("path", "place"), duck(f"""+f AS (SELECT DISTINCT path, string_split(path, '/') AS p FROM files), ok AS (SELECT * FROM f WHERE len(p) <= 8),
    n AS (SELECT path, 'file' AS type FROM ok UNION SELECT array_to_string(p[1:k], '/'), 'dir' FROM (SELECT p, unnest(range(1, len(p))) AS k FROM ok))
    SELECT path, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY type = 'file', lower({_NAME}), {_NAME}, type) AS place FROM n""", "files"))
QUERIES["agg3_by_extension"] = (lambda spark, d: A.by_extension(shape(spark, d, "methods"), "file_path"), duck("SELECT coalesce(nullif(lower(regexp_extract(regexp_extract(file_path, '([^/]*)$', 1), '\\.([^.]+)$', 1)), ''), '<noext>') AS ext, count(*) AS n FROM methods GROUP BY 1", "methods"))
QUERIES["agg5_primary_language"] = (lambda spark, d: S.primary_language(shape(spark, d, "files")), duck(f"+c AS (SELECT repo_id, {_LANG} AS language, count(*) AS n FROM files GROUP BY 1, 2 HAVING language IS NOT NULL) SELECT repo_id, arg_min(language, (-n, language)) AS language, max(n) AS n FROM c GROUP BY 1", "files"))
QUERIES["agg6_file_count"] = (lambda spark, d: shape(spark, d, "files").groupBy("repo_id").agg(F.count_if(S.is_indexable(P(), F.col("size")) & ~S.in_skipped_dir(P())).alias("n")), duck(f"SELECT repo_id, count_if({_OK} AND NOT {_SKIP})::BIGINT AS n FROM files GROUP BY 1", "files"))
QUERIES["agg1_by_language"] = (lambda spark, d: A.counts_of(shape(spark, d, "chunks"), "language", ["de", "en", "es", "fr", "ja"]), duck("SELECT language, count(c.id) AS n FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('ja')) v(language) LEFT JOIN chunks c USING (language) GROUP BY 1", "chunks"))
QUERIES["agg2_by_chunk_type"] = (lambda spark, d: A.counts_of(shape(spark, d, "methods"), "chunk_type", ["method", "sql", "block", "class"], "repo_id"), duck("SELECT r.repo_id, v.chunk_type, count(m.id) AS n FROM (SELECT DISTINCT repo_id FROM methods) r CROSS JOIN (VALUES ('method'), ('sql'), ('block'), ('class')) v(chunk_type) LEFT JOIN methods m ON m.repo_id = r.repo_id AND m.chunk_type = v.chunk_type GROUP BY 1, 2", "methods"))
QUERIES["agg4_method_types"] = (lambda spark, d: shape(spark, d, "methods").groupBy(F.coalesce("chunk_type", F.lit("method")).alias("chunk_type")).agg(F.count("*").alias("n")), duck("SELECT coalesce(chunk_type, 'method') AS chunk_type, count(*) AS n FROM methods GROUP BY 1", "methods"))
QUERIES["agg13_repo_rollup"] = (lambda spark, d: A.repo_rollup(shape(spark, d, "methods"), shape(spark, d, "edges"), _keys(spark, d)), duck("""+k AS (SELECT id, name AS key FROM methods WHERE coalesce(chunk_type, 'method') <> 'sql' AND is_primary UNION ALL SELECT id, class_name || '.' || name FROM methods WHERE coalesce(chunk_type, 'method') <> 'sql' AND is_primary AND class_name <> ''),
    a AS (SELECT repo_id, count(*) AS chunk_count, count_if(is_primary)::BIGINT AS symbol_count FROM methods GROUP BY 1), b AS (SELECT repo_id, count(DISTINCT key) AS name_count FROM k JOIN methods USING (id) GROUP BY 1), c AS (SELECT repo_id, count(*) AS edge_count FROM edges JOIN methods ON id = src GROUP BY 1)
    SELECT repo_id, chunk_count, symbol_count, coalesce(name_count, 0) AS name_count, coalesce(edge_count, 0) AS edge_count FROM a LEFT JOIN b USING (repo_id) LEFT JOIN c USING (repo_id)""", "methods", "edges"))


def _keys(spark, d):
    from codeloom.operators.graph import name_map

    return name_map(shape(spark, d, "methods"))


QUERIES["agg15_bug_severity"] = (lambda spark, d: A.severity_counts(shape(spark, d, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("p"), F.col("o_orderstatus").alias("status")).select("status", F.when(F.col("p") <= 2, "high").when(F.col("p") == 3, "medium").otherwise("low").alias("severity")), "status"), "SELECT o_orderstatus AS status, count_if(left(o_orderpriority, 1)::INT <= 2)::BIGINT AS n_high, count_if(left(o_orderpriority, 1) = '3')::BIGINT AS n_medium, count_if(left(o_orderpriority, 1)::INT >= 4)::BIGINT AS n_low FROM orders GROUP BY 1")
QUERIES["fil1_language"] = (lambda spark, d: T.filtered(shape(spark, d, "chunks"), language="fr").select("id", "language"), duck("SELECT id, language FROM chunks WHERE language = 'fr'", "chunks"))
QUERIES["fil2_first_of_symbol"] = (lambda spark, d: T.first_chunks(shape(spark, d, "chunks")), duck("SELECT symbol_id, min(id) AS id FROM chunks WHERE symbol_id <> '' GROUP BY 1", "chunks"))
QUERIES["fil3_by_symbol"] = (lambda spark, d: T.filtered(shape(spark, d, "methods"), name="small_ring").orderBy("id").limit(20).select("id", "name"), duck("SELECT id, name FROM methods WHERE name = 'small_ring' ORDER BY id LIMIT 20", "methods"))
QUERIES["fil4_by_ids"] = (lambda spark, d: T.by_ids(shape(spark, d, "methods"), shape(spark, d, "targets").select(F.col("target").alias("id"))).select("id", "name"), duck("SELECT id, name FROM methods WHERE id IN (SELECT target FROM targets)", "methods", "targets"))
QUERIES["fil5_node_ids"] = (lambda spark, d: T.by_ids(shape(spark, d, "ranks"), shape(spark, d, "chunks").select("id")).select("id", "pagerank"), duck("SELECT id, pagerank FROM ranks WHERE id IN (SELECT id FROM chunks)", "ranks", "chunks"))
QUERIES["fil6_lines_containing"] = (lambda spark, d: shape(spark, d, "methods").where((F.col("line_start") <= 205) & (F.col("line_end") >= 205) & F.col("name").isNotNull()).select("id", "file_path"), duck("SELECT id, file_path FROM methods WHERE line_start <= 205 AND line_end >= 205", "methods"))
QUERIES["fil7_file_symbols"] = (lambda spark, d: T.filtered(shape(spark, d, "methods"), file_path="src/small/Brand4.java").orderBy("line_start", "id").select("id", "line_start"), duck("SELECT id, line_start FROM methods WHERE file_path = 'src/small/Brand4.java'", "methods"))
QUERIES["fil8_class_lookup"] = (lambda spark, d: T.classes_of(shape(spark, d, "methods"), "a\\Brand4.java").select("id", "class_name"), duck("SELECT id, class_name FROM methods WHERE file_path = 'a/Brand4.java' OR file_path LIKE '%/Brand4.java'", "methods"))
QUERIES["fil9_java_files"] = (lambda spark, d: shape(spark, d, "methods").where(F.col("file_path").endswith(".java")).select("id"), duck("SELECT id FROM methods WHERE file_path LIKE '%.java'", "methods"))
QUERIES["fil11_existence"] = (lambda spark, d: shape(spark, d, "repos").select("id", (F.col("indexed") == 2).alias("ready")), duck("SELECT id, indexed = 2 AS ready FROM repos", "repos"))
QUERIES["fil13_history_without"] = (lambda spark, d: T.without(shape(spark, d, "history"), "id", [3, 5]).select("id"), duck("SELECT id FROM history WHERE id NOT IN (3, 5)", "history"))
QUERIES["fil13_chat_roles"] = (lambda spark, d: shape(spark, d, "chats").where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role"), duck("SELECT conv_id, turn, role FROM chats WHERE role IN ('user', 'assistant')", "chats"))
QUERIES["prj1_repo_rows"] = (lambda spark, d: T.repo_response(shape(spark, d, "repos")), duck("SELECT id, name, CASE WHEN skip_dirs IS NULL THEN '' ELSE 'gen,a/b' END AS dirs, indexed, indexed = 2 AS is_ready FROM repos", "repos"))
QUERIES["prj4_node_type"] = (lambda spark, d: T.node_types(shape(spark, d, "methods")), duck("SELECT id, CASE WHEN chunk_type = 'sql' THEN 'sql' ELSE 'method' END AS node_type FROM methods", "methods"))
QUERIES["top1_repos"] = (lambda spark, d: shape(spark, d, "repos").orderBy(F.desc("weight"), "id").limit(20).select("id", "weight"), duck("SELECT id, weight FROM repos ORDER BY weight DESC, id LIMIT 20", "repos"))
QUERIES["top2_history"] = (lambda spark, d: T.latest(shape(spark, d, "history"), 50, "repo_id").select("repo_id", "id", "place"), duck("SELECT repo_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY id DESC) AS place FROM history) WHERE place <= 50", "history"))
QUERIES["top3_logs"] = (lambda spark, d: T.latest(shape(spark, d, "history"), 50).select("id"), duck("SELECT id FROM history ORDER BY id DESC LIMIT 50", "history"))
QUERIES["src10_cascade_delete"] = (lambda spark, d: T.cascade(shape(spark, d, "methods"), "repo_id", shape(spark, d, "repos").where("indexed = 3").select(F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("repo_id")).where("repo_id = 'r1'")).select("id", "repo_id"), duck("SELECT id, repo_id FROM methods WHERE repo_id <> 'r1'", "methods"))
QUERIES["src11_upsert_symbols"] = (lambda spark, d: T.upsert(shape(spark, d, "methods").select("id", "name"), shape(spark, d, "targets").select(F.col("target").alias("id"), F.lit("new").alias("name")), "id"), duck("SELECT m.id, CASE WHEN t.target IS NULL THEN m.name ELSE 'new' END AS name FROM methods m LEFT JOIN targets t ON t.target = m.id", "methods", "targets"))
QUERIES["src12_node_upserts"] = (lambda spark, d: T.distinct_nodes(shape(spark, d, "classes").select("name", "file_path"), "name"), duck("SELECT name, min(file_path) AS file_path FROM classes GROUP BY 1", "classes"))
QUERIES["src17_collection_info"] = (lambda spark, d: T.collection_info(shape(spark, d, "embeddings").withColumnRenamed("embedding", "vector"), "label"), "SELECT label, count(*) AS points, max(len(embedding)) AS dim FROM embeddings GROUP BY 1")
QUERIES["src19_register_repos"] = (lambda spark, d: T.register(shape(spark, d, "repos").groupBy("root_path").agg(F.min_by("name", "id").alias("name"), F.min_by("indexed", "id").alias("indexed")), shape(spark, d, "region").select(F.concat(F.lit("src/"), F.lower("r_name")).alias("root_path"), F.lit("new").alias("name")).union(shape(spark, d, "repos").select("root_path", F.lit("renamed").alias("name")).distinct())), duck("""+o AS (SELECT root_path, arg_min(indexed, id) AS indexed FROM repos GROUP BY 1), n AS (SELECT 'src/' || lower(r_name) AS root_path, 'new' AS name FROM region UNION ALL SELECT DISTINCT root_path, 'renamed' FROM repos)
    SELECT root_path, n.name, coalesce(o.indexed, 0)::INT AS indexed FROM n FULL JOIN o USING (root_path)""", "repos"))
QUERIES["src20_delete_repo"] = (lambda spark, d: T.without(shape(spark, d, "repos"), "id", [1, 2, 3]).select("id"), duck("SELECT id FROM repos WHERE id NOT IN (1, 2, 3)", "repos"))
QUERIES["src21_reindex_cleanup"] = (lambda spark, d: T.replaced(shape(spark, d, "methods").select("repo_id", "id"), shape(spark, d, "targets").select(F.lit("r1").alias("repo_id"), F.concat(F.lit("n"), "target").alias("id")), "repo_id"), duck("SELECT repo_id, id FROM methods WHERE repo_id <> 'r1' UNION ALL SELECT 'r1', 'n' || target FROM targets", "methods", "targets"))
QUERIES["src22_log_append"] = (lambda spark, d: T.appended(shape(spark, d, "history").select("id", "query"), shape(spark, d, "region").select(F.col("r_name").alias("query"))), duck("SELECT id, query FROM history UNION ALL SELECT (SELECT max(id) FROM history) + row_number() OVER (ORDER BY r_name), r_name FROM region", "history"))
QUERIES["src27_repo_list"] = (lambda spark, d: shape(spark, d, "repos").select("id", "name", "root_path", "indexed"), duck("SELECT id, name, root_path, indexed FROM repos", "repos"))
QUERIES["src24_markdown_names"] = (lambda spark, d: shape(spark, d, "files").select("page_id", T.markdown_name(F.col("path")).alias("name")), duck(f"SELECT page_id, regexp_replace({_NAME}, '\\.[^.]+$', '') || '.md' AS name FROM files", "files"))
QUERIES["llm7_needs_narrowing"] = (lambda spark, d: shape(spark, d, "documents").select("doc_id", C.needs_narrowing(F.col("text"), F.when(F.col("lang") == "de", "impact").otherwise("chat")).alias("narrow")), "SELECT doc_id, length(text) // 3 > 6000 AND lang <> 'de' AS narrow FROM documents")
QUERIES["src9_allowed_roots"] = (lambda spark, d: shape(spark, d, "repos").select("id", T.in_roots(F.col("root_path"), ["src/building", "src/mach"]).alias("allowed")), duck("SELECT id, root_path = 'src/building' AS allowed FROM repos", "repos"))
QUERIES["src26_absolute_paths"] = (lambda spark, d: shape(spark, d, "repos").select("id", T.is_absolute(F.concat(F.when(F.col("indexed") == 0, "/").otherwise(""), "root_path")).alias("absolute")), duck("SELECT id, indexed = 0 AS absolute FROM repos", "repos"))
QUERIES["src14_query_runner"] = (lambda spark, d: T.run_query(spark, "SELECT repo_id, count(*) AS n FROM {m} GROUP BY repo_id", m=shape(spark, d, "methods")), duck("SELECT repo_id, count(*) AS n FROM methods GROUP BY repo_id", "methods"))
QUERIES["src13_node_writes"] = (lambda spark, d: T.stored(shape(spark, d, "methods").select("id", "name", "repo_id"), "methods", "repo_id").select("id", "name", "repo_id"), duck("SELECT id, name, repo_id FROM methods", "methods"))
QUERIES["src15_collection"] = (lambda spark, d: T.stored(shape(spark, d, "embeddings"), "points", "label").groupBy("label").agg(F.count("*").alias("n")), "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
QUERIES["src16_vector_writes"] = (lambda spark, d: T.stored(shape(spark, d, "embeddings"), "points", "label").select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total")), "SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
QUERIES["src23_history_append"] = (lambda spark, d: T.appended(shape(spark, d, "history").select("id", "query"), shape(spark, d, "nation").select(F.col("n_name").alias("query"))).groupBy("query").agg(F.count("*").alias("n"), F.max("id").alias("last")), duck("SELECT query, count(*) AS n, max(id) AS last FROM (SELECT id, query FROM history UNION ALL SELECT (SELECT max(id) FROM history) + row_number() OVER (ORDER BY n_name), n_name FROM nation) GROUP BY 1", "history"))
QUERIES["src25_settings"] = (lambda spark, d: spark.createDataFrame([(s.dimensions, s.top_k, s.impact_depth) for s in [Settings()]], "dimensions int, top_k int, impact_depth int"), "SELECT 64::INT AS dimensions, 10::INT AS top_k, 3::INT AS impact_depth")
