"""The search plan: intents, channels, fusion, scores, de-duplication and results, for a batch of queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import retrieval as R
from codeloom.operators.graph import CALLS
from codeloom.sources.work import checkpointed, spread


def intents(queries: DataFrame) -> DataFrame:
    """query_id, text and what the text tells: language, identifiers, tokens, intent."""
    text = F.col("text")
    return queries.select("query_id", "text", T.query_language(text).alias("language"), T.identifiers(text).alias("idents"), T.expanded_tokens(text).alias("tokens"), T.search_intent(text).alias("intent"))


def index_of(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """Chunks with their default dense vector and sparse weights. Texts are cut once for both."""
    cut = spread(chunks).withColumn("tokens", R.bm25_tokens(F.coalesce("text", F.lit(""))))
    return cut.withColumns({"vector": R.hashed_tokens(F.col("tokens"), dim), "weights": F.map_from_entries(F.transform("tokens", lambda t: F.struct(t, F.lit(1.0))))}).drop("tokens")


def by_generated_text(texts: DataFrame, index: DataFrame, k: int, cut: bool = True) -> DataFrame:
    """RET-3: dense search by the text (query_id, text) that a model wrote for a query; blank texts find nothing."""
    return R.dense_search(index_of(texts.where(F.trim("text") != "")), index, k, cut=cut)


def search(queries: DataFrame, index: DataFrame, nodes: DataFrame | Callable[[DataFrame], DataFrame] | None, top_k: int = 10, model=None, hypotheses: DataFrame | None = None, expansions: DataFrame | None = None) -> DataFrame:
    """RET-13: the top_k chunks of each query of intents() over index_of() a repository; nodes (id, name, pagerank, in_degree), or a function that gives those of some ids (id), bring graph scores, model a reranker, hypotheses (query_id, code) and expansions (query_id, expansion) a further ranked list each."""
    k = R.fetch_k(top_k)
    asked = index_of(queries)
    dense = R.dense_search(asked, index, k, cut=False).withColumn("channel", F.lit("dense"))
    sparse = R.sparse_search(asked, index, k, cut=False).withColumn("channel", F.lit("sparse"))
    found = dense.unionByName(sparse)
    for channel, texts, column in (("hyde", hypotheses, "code"), ("expanded", expansions, "expansion")):
        if texts is not None:
            found = found.unionByName(by_generated_text(texts.select("query_id", F.col(column).alias("text")), index, k, cut=False).withColumn("channel", F.lit(channel)))
    best = R.top(found, k, "query_id", "channel")
    fused = R.rrf(best.select("query_id", "channel", "id", "score")).withColumnRenamed("score", "rrf")
    # Fused rows are few and read several times: they are written, so that the channels are searched once.
    fused = checkpointed(fused, "fused")
    payload = index.drop("vector", "weights").withColumns({c: F.lit("") for c in ("symbol", "class_name", "symbol_id") if c not in index.columns})
    rows = fused.join(payload, "id").join(queries.select("query_id", "idents", "tokens", F.col("text").alias("asked")), "query_id")
    if callable(nodes):
        nodes = nodes(checkpointed(fused.select("id").distinct().join(payload.select("id", "symbol_id"), "id").select(F.col("symbol_id").alias("id")).distinct(), "symbols"))
    if nodes is not None:
        rows = rows.join(R.graph_scores(rows.select("query_id", "id", "symbol_id"), nodes, queries), ["query_id", "id"])
    else:
        rows = rows.withColumn("graph_score", F.lit(0.0))
    rows = rows.withColumns({"symbol_score": R.symbol_score(F.col("symbol"), F.col("class_name"), F.col("idents")), "struct_score": R.struct_score(F.col("text"), F.col("tokens"))})
    if model is not None:
        pool = R.top(rows.select("query_id", "id", "asked", F.col("rrf").alias("score"), R.rerank_text(F.col("file_path"), F.col("class_name"), F.col("symbol"), F.col("text")).alias("doc")), R.RERANK_POOL).where("doc is not null")
        rows = rows.join(R.scored_by_model(pool.select("query_id", "id", "doc"), "doc", model).drop("doc"), ["query_id", "id"], "left")
    else:
        rows = rows.withColumn("rerank", F.lit(None).cast("double"))
    scored = R.final_scores(rows).select("query_id", "id", "score", "symbol_id", "file_path", "line_start", "line_end")
    return R.top(R.deduplicate(scored), top_k)


def results(ranked: DataFrame, methods: DataFrame, edges: DataFrame, key: str = "id", most: int = 50) -> DataFrame:
    """RET-12: ranked rows with a snippet of their code and their callers and callees, one call away, as sorted arrays of id and name.

    The arrays of a row hold the first most by id; n_callers and n_callees count all. key is the column that names the method.
    """
    calls = edges.where(F.col("edge_type") == CALLS).select("src", "dst").distinct()
    asked = ranked.where(F.col(key).isNotNull()).select(F.col(key).alias("of")).distinct()
    names = methods.select(F.col("id").alias("other"), F.col("name").alias("other_name"))

    def beside(at: str, other: str, n: str, listed: str) -> DataFrame:
        pairs = calls.join(asked, calls[at] == asked["of"]).select("of", F.col(other).alias("other")).join(names, "other", "left")
        placed = pairs.withColumn("k", F.row_number().over(Window.partitionBy("of").orderBy("other")))
        return placed.groupBy("of").agg(F.count("*").alias(n), F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct(F.col("other").alias("id"), F.col("other_name").alias("name"))))).alias(listed))

    rows = ranked.join(beside("dst", "src", "n_callers", "callers").withColumnRenamed("of", key), key, "left").join(beside("src", "dst", "n_callees", "callees").withColumnRenamed("of", key), key, "left")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<struct<id:string,name:string>>")
    own = [c for c in ranked.columns if c not in ("code", "place")]
    return rows.select(*own, F.col("place").cast("long").alias("place"), F.substring("code", 1, 3000).alias("snippet"), *[F.coalesce(c, zero).alias(c) for c in ("n_callers", "n_callees")], *[F.coalesce(c, none).alias(c) for c in ("callers", "callees")])


def context_blocks(ranked: DataFrame, most: int = 5, tokens: int = 700) -> DataFrame:
    """RET-17: the best snippets of each query, cut to a token budget, as one text."""
    best = R.top(ranked, most)
    piece = F.concat(F.format_string("### %s:%d-%d\n", "file_path", "line_start", "line_end"), F.substring(F.col("text"), 1, tokens * 3))
    rows = best.select("query_id", F.struct("place", piece.alias("piece")).alias("x"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["piece"]), "\n\n").alias("block"))


def normalised(ranked: DataFrame) -> DataFrame:
    """AGG-12: scores relative to the query's best."""
    return ranked.select("query_id", "id", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 6).alias("score"))


def overlapping_pairs(ranked: DataFrame) -> DataFrame:
    """JOIN-15 as a join: pairs of a query's rows in one file that share more than 40 % of the shorter's lines; they meet by bins of lines."""
    size = 32
    bins = ranked.withColumn("bin", F.explode(F.sequence(F.floor(F.col("line_start") / size), F.floor(F.col("line_end") / size))))
    a = bins.select("query_id", "file_path", "bin", F.col("id").alias("a"), F.col("line_start").alias("a1"), F.col("line_end").alias("a2"))
    b = bins.select("query_id", "file_path", "bin", F.col("id").alias("b"), F.col("line_start").alias("b1"), F.col("line_end").alias("b2"))
    common = F.least("a2", "b2") - F.greatest("a1", "b1") + 1
    shorter = F.greatest(F.least(F.col("a2") - F.col("a1") + 1, F.col("b2") - F.col("b1") + 1), F.lit(1))
    first_bin = F.col("bin") == F.floor(F.greatest("a1", "b1") / size)  # each pair once, in the bin where they begin to overlap
    return a.join(b, ["query_id", "file_path", "bin"]).where((F.col("a") < F.col("b")) & (common > 0) & (common / shorter > R.OVERLAP) & first_bin).groupBy("query_id").agg(F.count("*").alias("n"))
