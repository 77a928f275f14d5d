"""Retrieval queries (RET, JOIN-6, 7, 13, 14, TOP) over documents, embeddings, events and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import retrieval as R
from codeloom.operators.inverted import InvertedIndex
from codeloom.plans import models as M
from codeloom.plans import search as P
from codeloom.queries.shapes import duck, shape
from codeloom.sources.tables import Collection
from codeloom.sources.work import checkpointed, spread, work_dir

QUERIES: dict = {}


def points(spark, d):
    return shape(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "label")


def asked_ids(spark, d):
    """Every vector whose id is divisible by 50 is a query."""
    return shape(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("id"))


def asked(spark, d):
    return points(spark, d).join(asked_ids(spark, d), "id", "left_semi").select(F.col("id").alias("query_id"), "vector")


def _collection(spark, d) -> Collection:
    """All vectors but those whose id ends in 7, indexed; then those, and a turned copy of each whose id ends in 3; then the removal of those that end in 9."""
    c = Collection(spark, f"{work_dir(spark)}/codeloom-tables/collection-{uuid.uuid4().hex}")
    rows = points(spark, d)
    end = F.substring("id", -1, 1)
    c.create(len(rows.first().vector))
    c.write(rows.where(end != "7"), "label")
    c.build_index()
    c.write(rows.where(end.isin("3", "7")).withColumn("vector", F.when(end == "3", F.reverse("vector")).otherwise(F.col("vector"))), "label")
    c.delete(rows.where(end == "9"))
    return c


QUERIES["src15_indexed_search"] = (lambda s, d: _collection(s, d).search(asked(s, d), 10).select("query_id", "id", "score", F.col("place").cast("long").alias("place")), None)
QUERIES["src16_upserted_vectors"] = (
    lambda s, d: _collection(s, d).points("id string, vector array<float>, label int").select("id", "label", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first")),
    "SELECT vec_id::VARCHAR AS id, label, round((CASE WHEN vec_id % 10 = 3 THEN embedding[-1] ELSE embedding[1] END)::DOUBLE, 6) AS first FROM embeddings WHERE vec_id % 10 <> 9",
)

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_KNN = f"SELECT a.vec_id::VARCHAR AS query_id, b.vec_id::VARCHAR AS id, round({_COS}, {{}}) AS score FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 50 = 0"

QUERIES["ret1_dense_search"] = (lambda s, d: R.dense_search(asked(s, d), points(s, d), 10).select("query_id", "id", "score", F.col("place").cast("long").alias("place")), f"WITH k AS ({_KNN.format(4)}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM k) SELECT query_id, id, score, place FROM r WHERE place <= 10")
QUERIES["join13_dense_pairs"] = (lambda s, d: R.dense_search(asked(s, d), points(s, d), R.fetch_k(10)).groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min("score").alias("last")), f"WITH k AS ({_KNN.format(4)}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM k) SELECT query_id, count(*) AS n, max(score) AS best, min(score) AS last FROM r WHERE place <= 100 GROUP BY 1")
QUERIES["ret14_similar_code"] = (lambda s, d: R.similar_code(points(s, d), 5, asked_ids(s, d)).select("query_id", "id", "score"), f"WITH k AS ({_KNN.format(3)}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM k WHERE id <> query_id) SELECT query_id, id, score FROM r WHERE place <= 5")
QUERIES["fil10_self_excluded"] = (lambda s, d: R.similar_code(points(s, d), 20, asked_ids(s, d)).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("id") == F.col("query_id")).alias("own")), "SELECT vec_id::VARCHAR AS query_id, 20::BIGINT AS n, 0::BIGINT AS own FROM embeddings WHERE vec_id % 50 = 0")
QUERIES["top8_similar_capped"] = (lambda s, d: R.similar_code(points(s, d), 50, asked_ids(s, d)).groupBy("query_id").agg(F.count("*").alias("n")), "SELECT vec_id::VARCHAR AS query_id, 20::BIGINT AS n FROM embeddings WHERE vec_id % 50 = 0")


def _sparse(s, d):
    """Word counts of documents and of first turns, words as tokens."""
    weights = lambda c: F.map_from_entries(F.transform(F.array_distinct(T.bm25_tokens(c)), lambda t: F.struct(t, F.length(t).cast("double"))))
    docs = spread(shape(s, d, "chunks").select("id", "text")).select("id", weights(F.col("text")).alias("weights"))
    queries = shape(s, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), weights(F.col("text")).alias("weights"))
    return queries, docs


_TOK = """list_filter(list_distinct(list_concat(list_transform(regexp_extract_all({0}, '[a-zA-Z_][a-zA-Z0-9_]+'), lambda t: lower(t)), list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+'), lambda t: length(t) >= 2), lambda t: lower(t)))), lambda t: NOT list_contains(['file','class','method','signature','annotations','calls','comment'], t))"""
_POST = f"p AS (SELECT doc_id::VARCHAR AS id, unnest({_TOK.format('text')}) AS token FROM documents), q AS (SELECT item_id::VARCHAR AS query_id, unnest({_TOK.format('text')}) AS token FROM benchmark)"
QUERIES["ret2_sparse_search"] = (lambda s, d: R.sparse_search(*_sparse(s, d), 10).select("query_id", "id", "score"), f"WITH {_POST}, s AS (SELECT query_id, id, round(sum(length(token) * length(token))::DOUBLE, 4) AS score FROM q JOIN p USING (token) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s) SELECT query_id, id, score FROM r WHERE k <= 10")


def _indexed(s, d):
    queries, docs = _sparse(s, d)
    return InvertedIndex.build(docs, f"{work_dir(s)}/codeloom-tables/inverted-{uuid.uuid4().hex}").search(queries, 10)


QUERIES["ret2_indexed_search"] = (lambda s, d: _indexed(s, d).select("query_id", "id", "score"), QUERIES["ret2_sparse_search"][1])
QUERIES["join14_shared_tokens"] = (lambda s, d: R.shared_tokens(*_sparse(s, d)), f"WITH {_POST} SELECT query_id, count(DISTINCT id) AS n_docs, count(*) AS n_pairs FROM q JOIN p USING (token) GROUP BY 1")


def _bm25(s, d):
    queries = shape(s, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    return R.bm25(queries, shape(s, d, "chunks").select("id", "text"), 10).select("query_id", "id", "score")


QUERIES["ret16_bm25"] = (_bm25, f"""WITH {_POST}, n AS (SELECT id, count(*) AS n_tokens FROM p GROUP BY 1), t AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n_docs, (SELECT count(*) FROM p)::DOUBLE / (SELECT count(*) FROM documents) AS average),
    i AS (SELECT token, ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM p, t GROUP BY token, n_docs), w AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i) ELSE raw END AS idf FROM i),
    s AS (SELECT query_id, id, sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * n_tokens / average))) AS raw FROM q JOIN p USING (token) JOIN w USING (token) JOIN n USING (id), t GROUP BY 1, 2),
    r AS (SELECT query_id, id, round(raw / max(raw) OVER (PARTITION BY query_id), 4) AS score, raw FROM s), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM r WHERE raw > 0)
    SELECT query_id, id, score FROM z WHERE k <= 10""")
QUERIES["src18_postings"] = (lambda s, d: R.postings(shape(s, d, "chunks").select("id", "text")).groupBy("token").agg(F.count("*").alias("df"), F.max("n_tokens").cast("long").alias("longest")), f"WITH {_POST}, n AS (SELECT id, count(*) AS n_tokens FROM p GROUP BY 1) SELECT token, count(*) AS df, max(n_tokens) AS longest FROM p JOIN n USING (id) GROUP BY 1")
_RRF = "pl AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, id) AS place FROM ranked), f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + place)), 6) AS score FROM pl GROUP BY 1, 2)"
QUERIES["ret4_rrf"] = (lambda s, d: R.rrf(shape(s, d, "ranked")), duck(f"+{_RRF} SELECT query_id, id, score FROM f", "ranked"))


def _benchmark(s, d):
    return P.intents(shape(s, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text"))


def _hypotheses(s, d):
    """A text for each query, all taken as semantic; the stand-in for a model gives back the prompt."""
    return M.hypotheses(_benchmark(s, d).withColumn("intent", F.lit("semantic")), lambda p: list(p))


QUERIES["ret3_hypothetical_channel"] = (lambda s, d: P.by_generated_text(_hypotheses(s, d).select("query_id", F.col("code").alias("text")), P.index_of(shape(s, d, "chunks")), R.fetch_k(10)).select("query_id", "id", "score"), None)
QUERIES["top4_top_k"] = (lambda s, d: R.top(R.rrf(shape(s, d, "ranked")), 10).select("query_id", "id", "score", F.col("place").cast("long").alias("place")), duck(f"+{_RRF} SELECT query_id, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM f) WHERE place <= 10", "ranked"))
QUERIES["top9_rerank_pool"] = (lambda s, d: R.top(R.rrf(shape(s, d, "ranked")), R.RERANK_POOL).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("last")), duck(f"+{_RRF} SELECT query_id, count(*) AS n, min(score) AS last FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM f) WHERE place <= 50 GROUP BY 1", "ranked"))


def _channel(s, d, name):
    return shape(s, d, "ranked").where(F.col("channel") == name).select("id", F.concat("channel", F.lit(":"), "query_id").alias("payload")).groupBy("id").agg(F.min("payload").alias("payload"))


QUERIES["join7_payloads"] = (lambda s, d: R.merge_payloads(*[_channel(s, d, c) for c in ("dense", "sparse", "hyde")]), duck("+x AS (SELECT id, channel, min(channel || ':' || query_id) AS payload FROM ranked GROUP BY 1, 2) SELECT coalesce(a.id, b.id, c.id) AS id, coalesce(a.payload, b.payload, c.payload) AS payload FROM (SELECT * FROM x WHERE channel = 'dense') a FULL JOIN (SELECT * FROM x WHERE channel = 'sparse') b ON a.id = b.id FULL JOIN (SELECT * FROM x WHERE channel = 'hyde') c ON c.id = coalesce(a.id, b.id)", "ranked"))


def _candidates(s, d):
    return R.rrf(shape(s, d, "ranked")).select("query_id", "id", F.col("score").alias("rrf"), F.col("id").alias("symbol_id"))


def _nodes(s, d, ids=None):
    """Methods with their scores; of ids (id), if given, alone: semi-joins go below what makes the edges."""
    from codeloom.operators.graph import in_degree

    m, edges = shape(s, d, "methods"), shape(s, d, "edges")
    if ids is not None:
        m, edges = m.join(ids, "id", "left_semi"), edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return m.select("id", "name", "class_name", "signature").join(shape(s, d, "ranks"), "id").join(in_degree(m, edges), "id")


def _intents(s, d):
    words = F.element_at(F.array(*[F.lit(w) for w in ("small ring", "red_widget", "widget", "blueBolt bolt", "nothing")]), F.pmod(F.col("query_id").cast("int"), F.lit(5)) + 1)
    return shape(s, d, "ranked").select("query_id").distinct().select("query_id", T.identifiers(words).alias("idents"), T.expanded_tokens(words).alias("tokens"))


_INTENT = "it AS (SELECT query_id, CASE query_id::INT % 5 WHEN 0 THEN ['small', 'ring'] WHEN 1 THEN ['red_widget'] WHEN 2 THEN ['widget'] WHEN 3 THEN ['blueBolt', 'bolt'] ELSE ['nothing'] END AS idents, CASE query_id::INT % 5 WHEN 0 THEN ['small', 'ring'] WHEN 1 THEN ['red', 'widget'] WHEN 2 THEN ['widget'] WHEN 3 THEN ['blue', 'bolt', 'bolt'] ELSE ['nothing'] END AS tokens FROM (SELECT DISTINCT query_id FROM ranked))"
_HIT = "CASE WHEN len(list_filter(idents, lambda i: lower(i) = lower(name))) > 0 THEN 1.0::DOUBLE WHEN len(list_filter(idents, lambda i: contains(lower(name), lower(i)) OR contains(lower(i), lower(name)))) > 0 THEN 0.7::DOUBLE WHEN len(list_filter(tokens, lambda t: contains(lower(name), t))) > 0 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END"
_GRAPH = f"{_RRF}, {_INTENT}, deg AS (SELECT m.id, count(e.src) AS n FROM methods m LEFT JOIN edges e ON e.dst = m.id GROUP BY 1), g AS (SELECT f.query_id, f.id, m.name, m.class_name, m.signature, f.score AS rrf, round(0.35 * ln(1 + pagerank) / max(ln(1 + pagerank)) OVER (PARTITION BY f.query_id) + 0.25 * least(deg.n / 10.0::DOUBLE, 1.0) + 0.40 * {_HIT}, 4) AS graph_score FROM f JOIN methods m ON m.id = f.id JOIN ranks rk ON rk.id = f.id JOIN deg ON deg.id = f.id JOIN it ON it.query_id = f.query_id)"
_GNAMES = ("ranked", "methods", "ranks", "edges")
QUERIES["ret5_graph_score"] = (lambda s, d: R.graph_scores(_candidates(s, d), _nodes(s, d), _intents(s, d)), duck(f"+{_GRAPH} SELECT f.query_id, f.id, coalesce(g.graph_score, 0)::DOUBLE AS graph_score FROM f LEFT JOIN g USING (query_id, id)", *_GNAMES))
QUERIES["join6_graph_join"] = (lambda s, d: R.graph_scores(_candidates(s, d), _nodes(s, d), _intents(s, d)).groupBy("query_id").agg(F.count_if(F.col("graph_score") == 0).alias("without"), F.count("*").alias("n")), duck(f"+{_GRAPH} SELECT query_id, count_if(coalesce(g.graph_score, 0) = 0)::BIGINT AS without, count(*) AS n FROM f LEFT JOIN g USING (query_id, id) GROUP BY 1", *_GNAMES))
QUERIES["ret6_symbol_hit"] = (lambda s, d: _candidates(s, d).join(_nodes(s, d), "id").join(_intents(s, d), "query_id").select("query_id", "id", R.symbol_hit(F.col("name"), F.col("idents"), F.col("tokens")).alias("hit")), duck(f"+{_RRF}, {_INTENT} SELECT f.query_id, f.id, {_HIT} AS hit FROM f JOIN methods m ON m.id = f.id JOIN it USING (query_id)", "ranked", "methods"))


def _scored(s, d, rerank=False):
    rows = _candidates(s, d).join(_nodes(s, d), "id").join(_intents(s, d), "query_id").join(R.graph_scores(_candidates(s, d), _nodes(s, d), _intents(s, d)), ["query_id", "id"])
    own = F.when((F.pmod(F.col("query_id").cast("int"), F.lit(2)) == 0) & F.lit(rerank), F.length("name") / 100.0)
    return rows.withColumns({"symbol_score": R.symbol_score(F.col("name"), F.col("class_name"), F.col("idents")), "struct_score": R.struct_score(F.col("signature"), F.col("tokens")), "rerank": own})


_SYM = "CASE WHEN len(list_filter(idents, lambda i: lower(i) IN (lower(name), lower(class_name)))) > 0 THEN 1.0::DOUBLE WHEN name <> '' AND len(list_filter(idents, lambda i: contains(lower(name), lower(i)) OR contains(lower(i), lower(name)))) > 0 THEN 0.7::DOUBLE WHEN class_name <> '' AND len(list_filter(idents, lambda i: contains(lower(class_name), lower(i)) OR contains(lower(i), lower(class_name)))) > 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END"
_STRUCT = "least(len(list_filter(tokens, lambda t: contains(lower(signature), lower(t))))::DOUBLE / len(tokens), 1.0)"
_ALL = f"{_GRAPH}, sc AS (SELECT g.*, {_SYM} AS symbol_score, {_STRUCT} AS struct_score FROM g JOIN it USING (query_id))"
QUERIES["ret9_symbol_score"] = (lambda s, d: _scored(s, d).select("query_id", "id", "symbol_score"), duck(f"+{_ALL} SELECT query_id, id, symbol_score FROM sc", *_GNAMES))
QUERIES["ret10_struct_score"] = (lambda s, d: _scored(s, d).select("query_id", "id", F.round("struct_score", 6).alias("struct_score")), duck(f"+{_ALL} SELECT query_id, id, round(struct_score, 6) AS struct_score FROM sc", *_GNAMES))
_FINAL = "fin AS (SELECT *, round(0.55 * rrf / max(rrf) OVER (PARTITION BY query_id) + 0.20 * graph_score + 0.20 * symbol_score + 0.05 * struct_score, 4) AS score FROM sc)"
QUERIES["ret8_final_score"] = (lambda s, d: R.final_scores(_scored(s, d)).select("query_id", "id", "score"), duck(f"+{_ALL}, {_FINAL} SELECT query_id, id, score FROM fin", *_GNAMES))
QUERIES["ret8_reranked_score"] = (lambda s, d: R.final_scores(_scored(s, d, True)).select("query_id", "id", "score"), duck(f"+{_ALL} SELECT query_id, id, round(CASE WHEN query_id::INT % 2 = 0 THEN 0.60 * length(name) / 100.0::DOUBLE + 0.20 * rrf / max(rrf) OVER (PARTITION BY query_id) + 0.10 * graph_score + 0.08 * symbol_score + 0.02 * struct_score ELSE 0.55 * rrf / max(rrf) OVER (PARTITION BY query_id) + 0.20 * graph_score + 0.20 * symbol_score + 0.05 * struct_score END, 4) AS score FROM sc", *_GNAMES))
QUERIES["agg12_normalised"] = (lambda s, d: P.normalised(R.rrf(shape(s, d, "ranked"))), duck(f"+{_RRF} SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM f", "ranked"))
QUERIES["ret7_reranked"] = (lambda s, d: R.scored_by_model(shape(s, d, "chunks").select("id", R.rerank_text(F.col("file_path"), F.lit(""), F.col("language"), F.col("text")).alias("doc")).where("doc is not null"), "doc", lambda docs: [len(x) % 64 / 8 - 4 for x in docs]).select("id", F.round("rerank", 6).alias("rerank")), duck("SELECT id, round(1 / (1 + exp(4 - length(file_path || ' / ' || language || chr(10) || left(text, 2000)) % 64 / 8::DOUBLE)), 6) AS rerank FROM chunks WHERE text <> ''", "chunks"))
QUERIES["ret7_rerank_text"] = (lambda s, d: shape(s, d, "chunks").select("id", F.sha1(R.rerank_text(F.col("file_path"), F.lit(""), F.col("language"), F.col("text"))).alias("doc")), duck("SELECT id, CASE WHEN text <> '' THEN sha1(file_path || ' / ' || language || chr(10) || left(text, 2000)) END AS doc FROM chunks", "chunks"))


def _ranked_chunks(s, d):
    return shape(s, d, "chunks").withColumns({"query_id": F.col("language"), "score": F.round(F.length("text") / 1e6, 6)}).select("query_id", "id", "score", "symbol_id", "file_path", "line_start", "line_end")


_FIRST = "rc AS (SELECT *, language AS query_id, round(length(text) / 1e6::DOUBLE, 6) AS score FROM chunks), f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, CASE WHEN symbol_id <> '' THEN 's' || symbol_id ELSE 'c' || id END ORDER BY score DESC, id) AS k FROM rc) WHERE k = 1)"
QUERIES["top5_first_of_symbol"] = (lambda s, d: R.first_of_symbol(_ranked_chunks(s, d)).select("query_id", "id"), duck(f"+{_FIRST} SELECT query_id, id FROM f1", "chunks"))
QUERIES["top6_drop_overlaps"] = (lambda s, d: R.drop_overlaps(_ranked_chunks(s, d)).select("query_id", "id"), None)
QUERIES["join15_overlapping_pairs"] = (lambda s, d: P.overlapping_pairs(_ranked_chunks(s, d)), duck("SELECT a.language AS query_id, count(*) AS n FROM chunks a JOIN chunks b ON a.language = b.language AND a.file_path = b.file_path AND a.id < b.id AND a.line_start <= b.line_end AND b.line_start <= a.line_end AND (least(a.line_end, b.line_end) - greatest(a.line_start, b.line_start) + 1)::DOUBLE / greatest(least(a.line_end - a.line_start + 1, b.line_end - b.line_start + 1), 1) > 0.4 GROUP BY 1", "chunks"))
QUERIES["ret11_deduplicate"] = (lambda s, d: R.deduplicate(_ranked_chunks(s, d)).select("query_id", "id", "score"), None)
QUERIES["ret12_results"] = (lambda s, d: P.results(R.top(_scored(s, d).withColumn("score", F.col("rrf")), 10).withColumn("code", F.col("signature")), shape(s, d, "methods"), shape(s, d, "edges")).select("query_id", "id", "place", "snippet", "n_callers", "n_callees", *[F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["id"], x["name"])), ",").alias(c) for c in ("callers", "callees")]), duck(f"+{_ALL}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS place FROM sc) WHERE place <= 10), e AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'CALLS'), u AS (SELECT e.dst AS id, count(*) AS n, string_agg(m.id || ':' || m.name, ',' ORDER BY m.id) AS names FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM e) e JOIN methods m ON m.id = e.src WHERE k <= 50 GROUP BY 1), un AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY 1), w AS (SELECT e.src AS id, string_agg(m.id || ':' || m.name, ',' ORDER BY m.id) AS names FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM e) e JOIN methods m ON m.id = e.dst WHERE k <= 50 GROUP BY 1), wn AS (SELECT src AS id, count(*) AS n FROM e GROUP BY 1) SELECT t.query_id, t.id, t.place, left(t.signature, 3000) AS snippet, coalesce(un.n, 0) AS n_callers, coalesce(wn.n, 0) AS n_callees, coalesce(u.names, '') AS callers, coalesce(w.names, '') AS callees FROM t LEFT JOIN u USING (id) LEFT JOIN un USING (id) LEFT JOIN w USING (id) LEFT JOIN wn USING (id)", *_GNAMES))
QUERIES["ret13_search"] = (lambda s, d: P.search(_benchmark(s, d), checkpointed(P.index_of(shape(s, d, "chunks")), "index"), lambda ids: _nodes(s, d, ids), 10, hypotheses=_hypotheses(s, d)).select("query_id", "id", "score"), None)
QUERIES["ret17_context_block"] = (lambda s, d: P.context_blocks(shape(s, d, "chunks").select(F.col("language").alias("query_id"), "id", (F.length("text") / 1e6).alias("score"), "file_path", "line_start", "line_end", "text"), 5, 700), duck("""+r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY length(text) DESC, id) AS k FROM chunks) SELECT language AS query_id, string_agg('### ' || file_path || ':' || line_start || '-' || line_end || chr(10) || left(text, 2100), chr(10) || chr(10) ORDER BY k) AS block FROM r WHERE k <= 5 GROUP BY 1""", "chunks"))
QUERIES["ret19_embedding"] = (lambda s, d: shape(s, d, "chunks").select("id", R.hashed_embedding(F.col("text"), 8).alias("v")).select("id", F.size("v").cast("long").alias("dim")), duck("SELECT id, 8::BIGINT AS dim FROM chunks", "chunks"))
