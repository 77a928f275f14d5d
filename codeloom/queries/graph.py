"""Call-graph queries (JOIN, AGG, RET of the graph)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import aggregates as A
from codeloom.operators import graph as G
from codeloom.queries.shapes import duck, shape

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


_RESOLVED = """
    keys AS (SELECT id, name AS key FROM methods WHERE coalesce(chunk_type, 'method') <> 'sql' AND is_primary
             UNION ALL SELECT id, class_name || '.' || name FROM methods WHERE coalesce(chunk_type, 'method') <> 'sql' AND is_primary AND class_name <> ''),
    exact AS (SELECT c.caller, c.ref, c.pos, k.id AS callee FROM calls c JOIN keys k ON k.key = c.ref WHERE k.id <> c.caller),
    bare AS (SELECT c.*, regexp_replace(c.ref, '^.*\\.', '') AS last_name FROM calls c WHERE c.ref LIKE '%.%' AND c.ref NOT IN (SELECT key FROM keys)),
    single AS (SELECT b.caller, b.ref, b.pos, k.id AS callee FROM bare b JOIN (SELECT key, min(id) AS id FROM keys GROUP BY key HAVING count(*) = 1) k ON k.key = b.last_name WHERE k.id <> b.caller),
    resolved AS (SELECT *, CASE WHEN ref LIKE '%.%' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END / count(*) OVER (PARTITION BY caller, ref, pos) AS confidence FROM (SELECT * FROM exact UNION ALL SELECT * FROM single))"""


@query("join1_belongs_to", duck("SELECT DISTINCT m.id AS src, c.id AS dst, 'BELONGS_TO' AS edge_type FROM methods m JOIN classes c ON m.class_name = c.name WHERE m.class_name <> ''", "methods", "classes"))
def join1(spark, d):
    return G.belongs_to(shape(spark, d, "methods"), shape(spark, d, "classes"))


@query("join2_implements", duck("SELECT src, dst, edge_type FROM links", "links"))
def join2(spark, d):
    return G.implements(shape(spark, d, "methods"))


@query("join3_call_resolution", duck(f"+{_RESOLVED} SELECT caller, ref, pos, callee, round(confidence, 9) AS confidence FROM resolved", "methods", "calls"))
def join3(spark, d):
    return G.resolve_calls(shape(spark, d, "calls"), shape(spark, d, "methods"), digits=9)


@query("join4_name_map", duck("SELECT name AS key, id FROM methods WHERE coalesce(chunk_type, 'method') <> 'sql' AND is_primary UNION ALL SELECT class_name || '.' || name, id FROM methods WHERE coalesce(chunk_type, 'method') <> 'sql' AND is_primary AND class_name <> ''", "methods"))
def join4(spark, d):
    return G.name_map(shape(spark, d, "methods")).select("key", "id")


@query("agg7_call_edges", duck(f"+{_RESOLVED} SELECT caller AS src, callee AS dst, count(*) AS call_count, round(arg_min(confidence, (pos, ref)), 9) AS confidence, 'CALLS' AS edge_type FROM resolved GROUP BY 1, 2", "methods", "calls"))
def agg7(spark, d):
    return G.resolved_edges(shape(spark, d, "calls"), shape(spark, d, "methods"), digits=9)


@query("join5_existing_edges", duck("SELECT e.src, e.dst, e.call_count FROM edges e WHERE e.src IN (SELECT id FROM methods WHERE is_primary) AND e.dst IN (SELECT id FROM methods WHERE is_primary)", "methods", "edges"))
def join5(spark, d):
    return G.existing_edges(shape(spark, d, "edges"), shape(spark, d, "methods").where("is_primary")).select("src", "dst", "call_count")


@query("agg8_edge_count", duck("SELECT repo_id, count(*) AS n_edges FROM edges JOIN methods m ON m.id = edges.src GROUP BY 1", "methods", "edges"))
def agg8(spark, d):
    return A.edge_count(shape(spark, d, "methods"), shape(spark, d, "edges"))


@query("agg9_in_degree", duck("SELECT m.id, count(e.src) AS in_degree FROM methods m LEFT JOIN edges e ON e.dst = m.id GROUP BY 1", "methods", "edges"))
def agg9(spark, d):
    return G.in_degree(shape(spark, d, "methods"), shape(spark, d, "edges"))


@query("agg16_pagerank", duck("""RECURSIVE + w AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM edges),
    pr(k, id, rank) AS (SELECT 0, id, 0.15::DOUBLE FROM methods UNION ALL
        SELECT p.k + 1, p.id, 0.15 + 0.85 * coalesce(g.given, 0) FROM pr p LEFT JOIN (SELECT w.dst, sum(q.rank * w.share) AS given FROM pr q JOIN w ON w.src = q.id GROUP BY 1) g ON g.dst = p.id WHERE p.k < 20)
    SELECT id, round(rank, 6) AS pagerank FROM pr WHERE k = 20""".replace("RECURSIVE + w", "RECURSIVE +w"), "methods", "edges"))
def agg16(spark, d):
    ranks = G.pagerank(shape(spark, d, "methods"), shape(spark, d, "edges"))
    return ranks.select("id", F.round("pagerank", 6).alias("pagerank"))


_REACH = """RECURSIVE +starts AS (SELECT target AS start, target AS node FROM targets UNION SELECT target, dst FROM targets JOIN links ON src = target UNION SELECT target, src FROM targets JOIN links ON dst = target),
    r(start, node, hop) AS (SELECT start, node, 0 FROM starts UNION SELECT r.start, e.src, r.hop + 1 FROM r JOIN edges e ON e.dst = r.node WHERE r.hop < 3),
    best AS (SELECT start, node, min(hop) AS hop FROM r WHERE hop > 0 AND node <> start GROUP BY 1, 2)"""


@query("join11_reachability", duck(f"{_REACH} SELECT start AS target, node AS id, hop FROM best", "targets", "links", "edges"))
def join11(spark, d):
    targets, every = shape(spark, d, "targets"), shape(spark, d, "all_edges")
    starts = G.with_peers(targets.select(F.col("target").alias("start"), F.col("target").alias("node")), every)
    return G.reach(starts, every, 3).where("node <> start").select(F.col("start").alias("target"), F.col("node").alias("id"), "hop")


_IMPACT = f"""{_REACH}, deg AS (SELECT dst, count(*) AS n FROM edges GROUP BY 1), rows_ AS (
    SELECT b.start AS target, m.id, m.name, m.class_name, m.file_path, CASE WHEN m.chunk_type = 'sql' THEN 'sql' ELSE 'method' END AS node_type, k.pagerank,
           coalesce(deg.n, 0) AS in_degree, b.hop AS depth, row_number() OVER (PARTITION BY b.start ORDER BY b.hop, k.pagerank DESC, m.id) AS place
    FROM best b JOIN methods m ON m.id = b.node JOIN ranks k ON k.id = m.id LEFT JOIN deg ON deg.dst = m.id)"""


def _impact(spark, d):
    return G.impact(shape(spark, d, "targets"), shape(spark, d, "methods"), shape(spark, d, "all_edges"), shape(spark, d, "ranks"))


@query("ret15_impact", duck(f"{_IMPACT} SELECT * FROM rows_ WHERE place <= 100", "targets", "methods", "ranks", "links", "edges"))
def ret15(spark, d):
    return _impact(spark, d)


@query("join12_induced_edges", duck(f"{_IMPACT}, chosen AS (SELECT target AS grp, id FROM rows_ WHERE place <= 100 UNION ALL SELECT target, target FROM targets) SELECT DISTINCT a.grp AS target, e.src, e.dst, e.edge_type FROM all_edges e JOIN chosen a ON a.id = e.src JOIN chosen b ON b.id = e.dst AND a.grp = b.grp", "targets", "methods", "ranks", "all_edges"))
def join12(spark, d):
    nodes = _impact(spark, d).select(F.col("target").alias("group"), "id").union(shape(spark, d, "targets").select("target", "target"))
    return G.induced(nodes, shape(spark, d, "all_edges")).select(F.col("group").alias("target"), "src", "dst", "edge_type")


@query("agg14_impact_groups", duck(f"{_IMPACT} SELECT target, depth, count(*) AS n, array_to_string(list(id ORDER BY place) FILTER (WHERE k <= 6), ',') AS shown FROM (SELECT *, row_number() OVER (PARTITION BY target, depth ORDER BY place) AS k FROM rows_ WHERE place <= 100) GROUP BY 1, 2", "targets", "methods", "ranks", "links", "edges"))
def agg14(spark, d):
    return A.impact_groups(_impact(spark, d))


@query("join16_neighbourhood", duck("""RECURSIVE +b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r(start, node, hop) AS (SELECT target, target, 0 FROM targets UNION SELECT r.start, b.dst, r.hop + 1 FROM r JOIN b ON b.src = r.node WHERE r.hop < 1)
    SELECT start, node, min(hop) AS hop FROM r GROUP BY 1, 2""", "targets", "edges"))
def join16(spark, d):
    return G.neighbourhood(shape(spark, d, "targets").select(F.col("target").alias("start")), shape(spark, d, "edges"), 1)


QUERIES["fil14_highlight"] = (lambda spark, d: G.neighbourhood(shape(spark, d, "targets").select(F.col("target").alias("start")), shape(spark, d, "edges"), 1).select("start", "node"), duck("SELECT DISTINCT start, node FROM (SELECT target AS start, target AS node FROM targets UNION SELECT target, dst FROM targets JOIN edges ON src = target UNION SELECT target, src FROM targets JOIN edges ON dst = target)", "targets", "edges"))


@query("join17_class_graph", duck("SELECT a.class_name AS from_class, b.class_name AS to_class, count(*) AS n_edges, sum(call_count)::BIGINT AS n_calls FROM edges JOIN methods a ON a.id = src JOIN methods b ON b.id = dst WHERE a.class_name <> '' AND b.class_name <> '' AND a.class_name <> b.class_name GROUP BY 1, 2", "methods", "edges"))
def join17(spark, d):
    return G.class_graph(shape(spark, d, "methods"), shape(spark, d, "edges"))


# Recursive SQL that lists every path of up to 6 calls takes too long; a chain of calls is its test.
@query("join18_call_paths", None)
def join18(spark, d):
    pairs = shape(spark, d, "targets").select(F.col("target").alias("from_id"), (F.col("target").cast("int") + 100).cast("string").alias("to_id"))
    return G.call_paths(pairs, shape(spark, d, "edges")).select("from_id", "to_id", F.array_join("path", ">").alias("path"), F.col("path_length").cast("long").alias("path_length"), "found")


_SIDES = """
    up AS (SELECT e.dst AS id, list(DISTINCT m.name || ':' || m.class_name || ':' || m.file_path || ':' || m.signature) AS l FROM edges e JOIN methods m ON m.id = e.src GROUP BY 1),
    down AS (SELECT e.src AS id, list(DISTINCT m.name || ':' || m.class_name || ':' || m.file_path || ':' || m.signature) AS l FROM edges e JOIN methods m ON m.id = e.dst GROUP BY 1)"""


def _names(c):
    return F.transform(c, lambda x: F.concat(x["name"], F.lit(":"), x["class_name"], F.lit(":"), x["file_path"], F.lit(":"), x["signature"]))


@query("join8_call_chain", duck(f"+{_SIDES} SELECT m.id, array_to_string(list_sort(coalesce(up.l, [])), ',') AS callers, array_to_string(list_sort(coalesce(down.l, [])), ',') AS callees FROM methods m LEFT JOIN up ON up.id = m.id LEFT JOIN down ON down.id = m.id", "methods", "edges"))
def join8(spark, d):
    rows = G.call_chain(shape(spark, d, "methods"), shape(spark, d, "edges"))
    return rows.select("id", F.array_join(F.array_sort(_names("callers")), ",").alias("callers"), F.array_join(F.array_sort(_names("callees")), ",").alias("callees"))


@query("join10_call_context", duck("""+ lab AS (SELECT id, {'name': name, 'class_name': class_name, 'file_path': file_path, 'signature': signature} AS o FROM methods),
    up AS (SELECT e.dst AS id, list_sort(list(DISTINCT l.o)) AS l FROM edges e JOIN lab l ON l.id = e.src GROUP BY 1), down AS (SELECT e.src AS id, list_sort(list(DISTINCT l.o)) AS l FROM edges e JOIN lab l ON l.id = e.dst GROUP BY 1)
    SELECT m.id, array_to_string(list_transform(coalesce(up.l, [])[1:3], lambda x: x.name), ',') AS callers, array_to_string(list_transform(coalesce(down.l, [])[1:5], lambda x: x.name), ',') AS callees FROM methods m LEFT JOIN up ON up.id = m.id LEFT JOIN down ON down.id = m.id""", "methods", "edges"))
def join10(spark, d):
    rows = G.call_context(shape(spark, d, "methods"), shape(spark, d, "edges"))
    return rows.select("id", F.array_join(F.transform("callers", lambda x: x["name"]), ",").alias("callers"), F.array_join(F.transform("callees", lambda x: x["name"]), ",").alias("callees"))


@query("ret18_layers", duck("""RECURSIVE +dn(start, node, hop) AS (SELECT target, target, 0 FROM targets UNION SELECT dn.start, e.dst, dn.hop + 1 FROM dn JOIN edges e ON e.src = dn.node WHERE dn.hop < 5),
    upw(start, node, hop) AS (SELECT target, target, 0 FROM targets UNION SELECT upw.start, e.src, upw.hop + 1 FROM upw JOIN edges e ON e.dst = upw.node WHERE upw.hop < 5),
    a AS (SELECT start, node, min(hop) AS hop FROM dn WHERE hop > 0 GROUP BY 1, 2), b AS (SELECT start, node, min(hop) AS hop FROM upw WHERE hop > 0 GROUP BY 1, 2)
    SELECT t.target AS centre, m.id AS node, CASE WHEN t.target = m.id THEN 0 ELSE coalesce(a.hop, -b.hop, 0) END AS layer FROM targets t CROSS JOIN methods m LEFT JOIN a ON a.start = t.target AND a.node = m.id LEFT JOIN b ON b.start = t.target AND b.node = m.id""", "targets", "methods", "edges"))
def ret18(spark, d):
    return G.layers(shape(spark, d, "methods"), shape(spark, d, "edges"), shape(spark, d, "targets").select(F.col("target").alias("centre")))


@query("join9_symbol_at_line", duck("SELECT q.file_path, q.line, arg_min(m.id, (m.line_end - m.line_start, m.id)) AS id FROM (SELECT DISTINCT file_path, line_start + 3 AS line FROM methods) q JOIN methods m ON m.file_path = q.file_path AND m.line_start <= q.line AND m.line_end >= q.line GROUP BY 1, 2", "methods"))
def join9(spark, d):
    m = shape(spark, d, "methods")
    return A.symbols_at(m, m.select(F.concat(F.lit(""), F.replace("file_path", F.lit("/"), F.lit("\\"))).alias("file_path"), (F.col("line_start") + 3).alias("line")).distinct())


@query("agg11_distinct_callers", duck("SELECT e.dst AS id, count(DISTINCT m.name) AS n_names, count(DISTINCT m.class_name) AS n_classes FROM edges e JOIN methods m ON m.id = e.src GROUP BY 1", "methods", "edges"))
def agg11(spark, d):
    rows = G.call_chain(shape(spark, d, "methods"), shape(spark, d, "edges")).where(F.size("callers") > 0)
    n = lambda f: F.size(F.array_distinct(F.transform("callers", lambda x: x[f]))).cast("long")
    return rows.select("id", n("name").alias("n_names"), n("class_name").alias("n_classes"))


@query("ret20_node_looks", duck("SELECT m.id, CASE WHEN chunk_type = 'sql' THEN 'sql' WHEN lower(m.class_name || ' ' || file_path) LIKE '%brand1%' THEN 'service' ELSE 'plain' END AS kind, round(10 + least(0.6 * coalesce(n, 0), 6), 6)::DOUBLE AS radius FROM methods m LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY 1) g ON g.dst = m.id", "methods", "edges"))
def ret20(spark, d):
    return A.node_looks(shape(spark, d, "methods"), shape(spark, d, "edges"), {"service": ["brand1"]})


for _name, _run, _sql in (
    ("agg10_min_hop", lambda s, d: join11(s, d).groupBy("target").agg(F.min("hop").alias("nearest"), F.count("*").alias("n")), duck(f"{_REACH} SELECT start AS target, min(hop) AS nearest, count(*) AS n FROM best GROUP BY 1", "targets", "links", "edges")),
    ("agg17_class_centroid", lambda s, d: A.centroids(shape(s, d, "methods"), "class_name", "line_start", "line_end"), duck("SELECT class_name, round(avg(line_start), 6) AS x, round(avg(line_end), 6) AS y, count(*) AS n FROM methods GROUP BY 1", "methods")),
    ("agg18_bounding_box", lambda s, d: A.bounding_box(shape(s, d, "methods"), "repo_id", "line_start", "line_end"), duck("SELECT repo_id, min(line_start) AS min_x, max(line_start) AS max_x, min(line_end) AS min_y, max(line_end) AS max_y FROM methods GROUP BY 1", "methods")),
):
    QUERIES[_name] = (_run, _sql)

QUERIES["top7_impact_order"] = (lambda s, d: _impact(s, d).where("place <= 10").select("target", "place", "id"), duck(f"{_IMPACT} SELECT target, place, id FROM rows_ WHERE place <= 10", "targets", "methods", "ranks", "links", "edges"))
QUERIES["fil12_named_callers"] = (lambda s, d: G.call_context(shape(s, d, "methods").withColumn("name", F.when(F.col("line_start") < 100, "").otherwise(F.col("name"))), shape(s, d, "edges")).select("id", F.size("callers").cast("long").alias("n")), duck("""+lab AS (SELECT id, {'name': CASE WHEN line_start < 100 THEN '' ELSE name END, 'class_name': class_name, 'file_path': file_path, 'signature': signature} AS o FROM methods),
    up AS (SELECT e.dst AS id, list_sort(list(DISTINCT l.o))[1:3] AS l FROM edges e JOIN lab l ON l.id = e.src GROUP BY 1) SELECT m.id, coalesce(len(list_filter(up.l, lambda x: x.name <> '')), 0)::BIGINT AS n FROM methods m LEFT JOIN up ON up.id = m.id""", "methods", "edges"))
