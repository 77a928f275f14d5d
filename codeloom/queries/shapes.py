"""The driver's tables in the shape of the library's entities, as SQL that Spark and DuckDB both read.

A part is a method, its brand a class; a line item is a call from its part to another; pages, documents and events are
files, chunks and rankings; conversations are chats. Every shape has all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

SHAPES = {
    "methods": """
        SELECT CAST(p_partkey AS STRING) AS id, 'r' || CAST(p_partkey % 3 AS STRING) AS repo_id,
               replace(p_name, ' ', '_') || CASE WHEN p_size <= 10 THEN '' ELSE '_' || CAST(p_partkey AS STRING) END AS name,
               CASE WHEN p_size = 50 THEN '' ELSE replace(p_brand, '#', '') END AS class_name,
               'src/' || lower(p_type) || '/' || replace(p_brand, '#', '') || CASE p_size % 3 WHEN 0 THEN '.java' WHEN 1 THEN '.ts' ELSE '' END AS file_path,
               CASE p_size % 5 WHEN 0 THEN 'sql' WHEN 1 THEN 'block' WHEN 2 THEN CAST(NULL AS STRING) ELSE 'method' END AS chunk_type,
               'void ' || replace(p_name, ' ', '_') || '()' AS signature,
               CAST(p_size * 10 + 1 AS INT) AS line_start, CAST(p_size * 10 + 1 + p_partkey % 40 AS INT) AS line_end, p_size % 7 <> 0 AS is_primary
        FROM {part}""",
    "classes": """
        SELECT DISTINCT replace(p_brand, '#', '') || ':' || p_type AS id, replace(p_brand, '#', '') AS name, lower(p_type) AS file_path FROM {part}""",
    "calls": """
        SELECT CAST(l.l_partkey AS STRING) AS caller,
               CASE l.l_linenumber % 3 WHEN 0 THEN m.name WHEN 1 THEN m.class_name || '.' || m.name ELSE 'v.' || m.name END AS ref,
               CAST(min(l.l_linenumber) AS INT) AS pos
        FROM {lineitem} l JOIN {methods} m ON m.id = CAST((l.l_partkey * 31 + l.l_suppkey * 7 + l.l_linenumber) % (SELECT count(*) FROM {part}) AS STRING)
        GROUP BY 1, 2""",
    "edges": """
        SELECT CAST(l_partkey AS STRING) AS src, CAST((l_partkey * 31 + l_suppkey * 7 + l_linenumber) % (SELECT count(*) FROM {part}) AS STRING) AS dst,
               'CALLS' AS edge_type, min(l_discount) * 10 AS confidence, CAST(count(*) AS BIGINT) AS call_count
        FROM {lineitem} GROUP BY 1, 2""",
    "links": """
        SELECT DISTINCT a.id AS src, b.id AS dst, 'IMPLEMENTS' AS edge_type, CAST(1.0 AS DOUBLE) AS confidence, CAST(1 AS BIGINT) AS call_count
        FROM {methods} a JOIN {methods} b ON a.class_name = b.class_name AND a.name = b.name
        WHERE coalesce(a.chunk_type, 'method') = 'method' AND a.file_path LIKE '%.java' AND b.chunk_type = 'sql'""",
    "all_edges": """
        SELECT src, dst, edge_type, confidence, call_count FROM {edges} UNION ALL SELECT src, dst, edge_type, confidence, call_count FROM {links}""",
    "targets": "SELECT CAST(n_nationkey AS STRING) AS target FROM {nation}",
    "ranks": """
        SELECT CAST(p_partkey AS STRING) AS id, CAST(p_retailprice AS DOUBLE) / 1000.0 AS pagerank FROM {part}""",
    "chats": "SELECT conv_id, turn, role, text FROM {conversations}",
    "chunks": """
        SELECT CAST(doc_id AS STRING) AS id, text, lang AS language, source AS file_path, CAST(doc_id % 97 AS INT) AS line_start,
               CAST(doc_id % 97 + n_chars % 30 AS INT) AS line_end, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 's' || CAST(doc_id % 400 AS STRING) END AS symbol_id
        FROM {documents}""",
    "ranked": """
        SELECT CAST(user_id % 20 AS STRING) AS query_id, CASE event_type WHEN 'click' THEN 'dense' WHEN 'view' THEN 'sparse' ELSE 'hyde' END AS channel,
               CAST(event_id % 500 AS STRING) AS id, max(value) AS score
        FROM {events} GROUP BY 1, 2, 3""",
    "history": """
        SELECT event_id AS id, 'r' || CAST(user_id % 5 AS STRING) AS repo_id, event_type AS query, CAST(value AS DOUBLE) AS top_score, ts AS created_at FROM {events}""",
    "repos": """
        SELECT c_custkey AS id, c_name AS name, 'src/' || lower(c_mktsegment) AS root_path, CAST(c_nationkey % 4 AS INT) AS indexed, c_acctbal AS weight,
               CASE WHEN c_nationkey % 2 = 0 THEN '["gen","a/b"]' ELSE CAST(NULL AS STRING) END AS skip_dirs FROM {customer}""",
    "files": """
        SELECT 'r' || CAST(page_id % 5 AS STRING) AS repo_id, page_id,
               replace(replace(split_part(url, '://', 2), '?', '/'), '#', '/') ||
               CASE page_id % 9 WHEN 0 THEN '.java' WHEN 1 THEN '.TS' WHEN 2 THEN 'UserMapper.xml' WHEN 3 THEN '/node_modules/x.js' WHEN 4 THEN '.min.js'
                                WHEN 5 THEN '/jquery-3.6.0.js' WHEN 6 THEN '/pom.xml' WHEN 7 THEN '.md' ELSE '/_x.js' END AS path,
               CAST(length(html) * 40 AS BIGINT) AS size, html AS source
        FROM {pages}""",
}


def _needs(name: str) -> list[str]:
    return [x for x in [*SHAPES, *TABLES] if "{" + x + "}" in SHAPES[name]]


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Methods that a shape joins are not broadcast: by the size of their file Spark would send a million rows through the driver.
    return spark.sql(SHAPES[name], **{x: shape(spark, sf_dir, x).hint("merge") if x == "methods" else shape(spark, sf_dir, x) for x in _needs(name)})


def duck(sql: str, *names: str) -> str:
    """sql with the shapes that it names as common table expressions."""
    done: list[str] = []

    def add(name: str) -> None:
        for x in _needs(name):
            if x in SHAPES:
                add(x)
        if name not in done:
            done.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({SHAPES[n].format(**{x: x for x in [*SHAPES, *TABLES]})})" for n in done]
    recursive = sql.lstrip().startswith("RECURSIVE ")
    sql = sql.lstrip().removeprefix("RECURSIVE ")
    joined = ", ".join(parts)
    return f"WITH {'RECURSIVE ' * recursive}{joined}{', ' if sql.startswith('+') else ' '}{sql.removeprefix('+')}"
