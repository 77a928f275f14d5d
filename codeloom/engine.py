"""The service as one object: repositories are registered, indexed, searched and walked; every table is Parquet under one folder.

Tables that belong to a repository are partitioned by repo_id and replaced a partition at a time, so that indexing a
repository again, or deleting it, touches nothing of the others.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.config import Settings
from codeloom.functions import text as T
from codeloom.operators import aggregates as A
from codeloom.operators import graph as G
from codeloom.operators import parse as P
from codeloom.operators import retrieval as R
from codeloom.plans import chat as C
from codeloom.plans import models as M
from codeloom.plans import search as S
from codeloom.sources import files, tables
from codeloom.sources.work import checkpointed

PENDING, RUNNING, DONE, FAILED = range(4)
REPOS = "id string, name string, root_path string, indexed int, skip_dirs string, file_count bigint, chunk_count bigint, symbol_count bigint, edge_count bigint, updated_at timestamp"
LOGS = "id bigint, repo_id string, level string, message string, created_at timestamp"
HISTORY = "id bigint, repo_id string, query string, intent string, result_count int, top_score double, latency_ms bigint, created_at timestamp"
PARTED = {
    "chunks": f"file_path string, language string, pos int, {P.SCHEMA}, chunk_id string, symbol_id string, vector array<double>, weights map<string,double>, repo_id string",
    "methods": "id string, name string, class_name string, file_path string, signature string, line_start int, line_end int, chunk_id string, chunk_type string, is_primary boolean, pagerank double, repo_id string",
    "classes": "id string, name string, file_path string, repo_id string",
    "edges": "src string, dst string, edge_type string, confidence double, call_count bigint, repo_id string",
}


class Engine:
    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings or Settings.from_env()

    # --- tables ---------------------------------------------------------------------------------------

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, name: str, repo_id: str | None = None) -> DataFrame:
        schema = {"repos": REPOS, "logs": LOGS, "history": HISTORY, **PARTED}[name]
        path = f"{self._path(name)}/v{self._version()}" if name == "repos" else self._path(name)
        fs, p = self._fs(path)
        df = self.spark.read.schema(schema).parquet(path) if fs.exists(p) else self.spark.createDataFrame([], schema)
        df = df.select(*[c.split(" ")[0] for c in schema.split(", ")]) if name in ("logs", "history") else df
        return df.where(F.col("repo_id") == repo_id) if repo_id is not None else df

    def _replace(self, name: str, repo_id: str, rows: DataFrame) -> None:
        """The rows of one repository, in place of those it had: Spark swaps the partition when all rows are written."""
        ready = checkpointed(rows, name)
        if not ready.limit(1).count():
            return self._drop(name, repo_id)
        ready.withColumn("repo_id", F.lit(repo_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(self._path(name))

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _drop(self, name: str, repo_id: str) -> None:
        fs, p = self._fs(f"{self._path(name)}/repo_id={repo_id}")
        fs.delete(p, True)

    def _version(self) -> int:
        """The newest whole version of the table of repositories; 0 if there is none."""
        fs, p = self._fs(self._path("repos"))
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        whole = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(self._fs(f"{self._path('repos')}/{n}/_SUCCESS")[1])]
        return max(whole, default=0)

    def _update_repos(self, change: Callable[[dict[str, dict]], dict[str, dict]], tries: int = 3) -> None:
        """SRC-22: the table of repositories (a few rows) as change makes it of the rows by id.

        Each state is a version in a folder of its own, and the last whole one counts, so that a writer that dies changes
        nothing. Of two writers one finds its version taken, waits, and makes its change of what the other wrote.
        """
        for attempt in range(tries):
            at = self._version()
            rows = change({r.id: r.asDict() for r in self.table("repos").collect()})
            try:
                data = self.spark.createDataFrame([tuple(r.get(c.split(" ")[0]) for c in REPOS.split(", ")) for r in rows.values()], REPOS)
                data.coalesce(1).write.mode("errorifexists").parquet(f"{self._path('repos')}/v{at + 1}")
            except AnalysisException:
                if attempt + 1 == tries:
                    raise
                time.sleep(0.2 * 2**attempt)
                continue
            fs, old = self._fs(f"{self._path('repos')}/v{at - 1}")  # the version before may still be read
            if at > 1:
                fs.delete(old, True)
            return

    def _append(self, name: str, values: dict, tries: int = 10) -> None:
        """SRC-22, SRC-23: a row with the next id. A row is a folder named by its id, so that ids follow from a listing and a second writer of one id must take the next."""
        schema = {"logs": LOGS, "history": HISTORY}[name]
        row = self.spark.createDataFrame([tuple(values.get(c.split(" ")[0]) for c in schema.split(", ")[1:])], schema.split(", ", 1)[1]).withColumn("created_at", F.current_timestamp())
        fs, p = self._fs(self._path(name))
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        following = max([int(n[3:]) for n in names if n.startswith("id=")], default=0) + 1
        for n in range(following, following + tries):
            try:
                return row.coalesce(1).write.mode("errorifexists").parquet(f"{self._path(name)}/id={n}")
            except AnalysisException:
                if n + 1 == following + tries:
                    raise

    # --- repositories ---------------------------------------------------------------------------------

    def register_repo(self, root_path: str, name: str | None = None, skip_dirs: list[str] | None = None) -> str:
        """SRC-19, SRC-26, SRC-9: registers a directory, or renames it if known; its state stays. Returns its id."""
        root = files.checked_root(root_path)
        if not files.is_allowed(root, self.settings.allowed_roots):
            raise PermissionError("the path is in no allowed root")
        repo_id = self.spark.createDataFrame([(root,)], "p string").select(T.repo_id(F.col("p"))).first()[0]
        new = {"id": repo_id, "root_path": root, "indexed": PENDING, "file_count": 0, "chunk_count": 0, "symbol_count": 0, "edge_count": 0}

        def change(rows: dict) -> dict:
            old = rows.get(repo_id, new)
            dirs = json.dumps(skip_dirs) if skip_dirs is not None else old.get("skip_dirs")
            return rows | {repo_id: old | {"name": name or root.rsplit("/", 1)[-1], "skip_dirs": dirs, "updated_at": datetime.now()}}

        self._update_repos(change)
        return repo_id

    def list_repos(self) -> DataFrame:
        """SRC-27, TOP-1"""
        return self.table("repos").orderBy(F.desc_nulls_last("updated_at"), "id")

    def get_repo(self, repo_id: str) -> dict:
        row = self.table("repos").where(F.col("id") == repo_id).first()
        if row is None:
            raise KeyError(repo_id)
        return row.asDict()

    def _set(self, repo_id: str, **values) -> None:
        self._update_repos(lambda rows: {i: r | (values | {"updated_at": datetime.now()} if i == repo_id else {}) for i, r in rows.items()})

    def delete_repo(self, repo_id: str) -> None:
        """SRC-20: refused while indexing runs. Nothing knows the repository once its row is gone; then its tables go, which a second call finishes."""
        if self.get_repo(repo_id)["indexed"] == RUNNING:
            raise RuntimeError("indexing is running")
        self._update_repos(lambda rows: {i: r for i, r in rows.items() if i != repo_id})
        for name in PARTED:
            self._drop(name, repo_id)

    def file_tree(self, repo_id: str) -> DataFrame:
        return files.in_tree_order(files.tree(files.list_files(self.spark, self.get_repo(repo_id)["root_path"], self._skip(repo_id))))

    def read_file(self, repo_id: str, path: str) -> dict:
        return files.read_one(self.get_repo(repo_id)["root_path"], path)

    def _skip(self, repo_id: str) -> list[str]:
        return json.loads(self.get_repo(repo_id)["skip_dirs"] or "[]")

    # --- index ----------------------------------------------------------------------------------------

    def index_repo(self, repo_id: str) -> dict:
        """Scan, parse, resolve calls, link, rank, embed; each table is written before the next step reads it."""
        repo = self.get_repo(repo_id)
        if repo["indexed"] == RUNNING:
            raise RuntimeError("indexing is running")
        self._set(repo_id, indexed=RUNNING)
        try:
            found = files.scan(self.spark, repo["root_path"], self._skip(repo_id)).withColumn("repo_id", F.lit(repo_id))
            chunks = S.index_of(P.parse_files(found), self.settings.dimensions)
            self._replace("chunks", repo_id, chunks)
            chunks = self.table("chunks", repo_id)
            symbols = P.symbols(chunks)
            calls = symbols.where("chunk_type <> 'sql'").select(F.col("id").alias("caller"), F.posexplode("calls").alias("pos", "ref"))
            edges = G.call_edges(G.resolve_calls(calls, symbols)).select("src", "dst", "edge_type", "confidence", "call_count")
            class_id = F.substring(F.sha1(F.concat_ws("|", "repo_id", "file_path", "class_name")), 1, 16)
            classes = symbols.where("class_name <> ''").select(class_id.alias("id"), F.col("class_name").alias("name"), "file_path").distinct()
            self._replace("classes", repo_id, classes)
            plain = [F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("call_count")]
            linked = G.implements(symbols).select("src", "dst", "edge_type", *plain).unionByName(G.belongs_to(symbols, self.table("classes", repo_id)).select("src", "dst", "edge_type", *plain))
            self._replace("edges", repo_id, edges.unionByName(linked))
            edges = self.table("edges", repo_id)
            ranks = G.pagerank(symbols, edges)
            self._replace("methods", repo_id, symbols.join(ranks, "id").drop("repo_id", "calls"))
            methods = self.table("methods", repo_id)
            counts = {"chunk_count": chunks.count(), "symbol_count": methods.count(), "edge_count": edges.where(F.col("edge_type") == G.CALLS).count(), "file_count": chunks.select("file_path").distinct().count()}
        except Exception as e:
            self._set(repo_id, indexed=FAILED)
            self._append("logs", {"repo_id": repo_id, "level": "ERROR", "message": str(e)[:500]})
            raise
        self._set(repo_id, indexed=DONE, **counts)
        self._append("logs", {"repo_id": repo_id, "level": "INFO", "message": json.dumps(counts)})
        return counts

    def progress(self, repo_id: str, every: float = 2.0, most: int = 10_000) -> Iterator[int]:
        """STR-4: the state each time it is looked at, every so many seconds, until indexing has ended."""
        for _ in range(most):
            state = self.get_repo(repo_id)["indexed"]
            yield state
            if state >= DONE:
                return
            time.sleep(every)

    def status(self, repo_id: str) -> tuple[int, str]:
        state = self.get_repo(repo_id)["indexed"]
        return state, T.STATUS_KEYS[state]

    def stats(self, repo_id: str) -> dict[str, DataFrame]:
        """AGG-1..4"""
        chunks, methods = self.table("chunks", repo_id), self.table("methods", repo_id)
        return {
            "language": A.counts_of(chunks, "language", ["java", "javascript", "typescript", "xml", "vue"]),
            "chunk_type": A.counts_of(chunks, "chunk_type", ["method", "sql", "block", "class"]),
            "extension": A.by_extension(methods, "file_path"),
            "method_type": methods.groupBy(F.coalesce("chunk_type", F.lit("method")).alias("chunk_type")).agg(F.count("*").alias("n")),
        }

    def logs(self, repo_id: str) -> DataFrame:
        return tables.latest(self.table("logs", repo_id), self.settings.log_limit)

    def symbol_at(self, repo_id: str, file_path: str, line: int) -> DataFrame:
        """JOIN-9"""
        methods = self.table("methods", repo_id)
        at = A.symbols_at(methods, self.spark.createDataFrame([(file_path, line)], "file_path string, line int"))
        return methods.join(at.select("id"), "id", "left_semi")

    # --- queries --------------------------------------------------------------------------------------

    def search(self, repo_id: str, query: str, top_k: int | None = None, language: str | None = None, model: Callable | None = None, text_model: Callable | None = None) -> DataFrame:
        """RET-13 for one query, with RET-12's nested results, with an entry in the history; refused before the repository is indexed."""
        if self.get_repo(repo_id)["indexed"] != DONE:
            raise RuntimeError("the repository is not indexed")
        began = time.time()
        chunks = tables.filtered(self.table("chunks", repo_id).withColumnRenamed("chunk_id", "id"), language=language)
        methods = self.table("methods", repo_id)
        edges = self.table("edges", repo_id)
        nodes = methods.select("id", "name", "pagerank").join(G.in_degree(methods, edges), "id")
        asked = S.intents(self.spark.createDataFrame([("q", query)], "query_id string, text string"))
        # What a text model writes is a further ranked list each: keywords for queries that are not English, code for those about meaning.
        written = {} if text_model is None else {"expansions": checkpointed(M.expansions(asked, text_model), "expansions"), "hypotheses": checkpointed(M.hypotheses(asked, text_model), "hypotheses")}
        found = S.search(asked, chunks, nodes, top_k or self.settings.top_k, model, **written)
        # The best top_k rows, as the caller gets them: with their code, and the names of their callers and callees.
        full = S.results(found.join(chunks.select("id", "symbol", "class_name", "signature", F.col("raw_code").alias("code")), "id"), methods, edges, key="symbol_id")
        result = checkpointed(full, "results").orderBy("place")
        rows = result.collect()
        intent = asked.first().intent
        self._append("history", {"repo_id": repo_id, "query": query, "intent": intent, "result_count": len(rows), "top_score": rows[0].score if rows else None, "latency_ms": int((time.time() - began) * 1000)})
        return result

    def history(self, repo_id: str, limit: int | None = None) -> DataFrame:
        return tables.latest(self.table("history", repo_id), min(limit or self.settings.history_limit, 200))

    def delete_history(self, repo_id: str, ids: list[int]) -> None:
        for r in self.table("history", repo_id).where(F.col("id").isin(ids)).select("id").collect():
            fs, p = self._fs(f"{self._path('history')}/id={r.id}")
            fs.delete(p, True)

    def impact(self, repo_id: str, symbol_id: str, depth: int | None = None) -> DataFrame:
        methods = self.table("methods", repo_id)
        targets = self.spark.createDataFrame([(symbol_id,)], "target string")
        return G.impact(targets, methods.drop("pagerank"), self.table("edges", repo_id), methods.select("id", "pagerank"), depth or self.settings.impact_depth)

    def call_context(self, repo_id: str, symbol_id: str) -> DataFrame:
        return G.call_context(self.table("methods", repo_id), self.table("edges", repo_id)).where(F.col("id") == symbol_id)

    def method_graph(self, repo_id: str, symbol_id: str, depth: int = 2) -> DataFrame:
        return G.neighbourhood(self.spark.createDataFrame([(symbol_id,)], "start string"), self.table("edges", repo_id), depth)

    def class_graph(self, repo_id: str) -> DataFrame:
        return G.class_graph(self.table("methods", repo_id), self.table("edges", repo_id))

    def call_path(self, repo_id: str, from_id: str, to_id: str) -> DataFrame:
        return G.call_paths(self.spark.createDataFrame([(from_id, to_id)], "from_id string, to_id string"), self.table("edges", repo_id))

    def similar_code(self, repo_id: str, symbol_id: str, k: int = 5) -> DataFrame:
        """RET-14: by the symbol's primary chunk."""
        points = self.table("chunks", repo_id).where("is_primary").select(F.col("symbol_id").alias("id"), "vector")
        return R.similar_code(points, k, self.spark.createDataFrame([(symbol_id,)], "id string"))

    # --- analysis -------------------------------------------------------------------------------------

    def analyze(self, repo_id: str, mode: str, code: str, model: Callable, file_path: str = "", line_start: int = 1, line_end: int = 1, question: str = "", history: list[dict] | None = None, templates: dict[str, str] | None = None) -> list[dict]:
        """STR-1, LLM-4..8: the events of one analysis, in order: intent, smart_resolve, card, text, done; error in place of text and done if the model fails.

        mode is one of MODES. A question (mode custom) is answered from history, the code (narrowed to the symbols that it is
        about, if it is long) and the best search results as context; of the other modes the template makes the prompt.
        """
        self.get_repo(repo_id)
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if not code.strip():
            raise ValueError("there is no code")
        if mode == "custom" and not question.strip():
            raise ValueError("a question is needed")
        asked = question or mode
        first = self.spark.createDataFrame([(asked,)], "t string").select(T.chat_intent(F.col("t")).alias("intent"), T.is_code_related(F.col("t")).alias("related")).first()
        events, used = [{"kind": "intent", "intent": first.intent}], code
        if mode == "custom":
            symbols = self.table("methods", repo_id).where(F.col("file_path") == file_path).select("id", "name", "class_name", "file_path", "line_start", "line_end")
            found = C.smart_resolve(self.spark.createDataFrame([(1, 1, question, code, first.intent)], "conv_id bigint, turn bigint, text string, code string, intent string"), symbols, model).first()
            if found.symbols:
                events.append({"kind": "smart_resolve", "symbols": list(found.symbols)})
            used = found.code
            if first.intent in ("impact", "similar"):
                at = self.symbol_at(repo_id, file_path, line_start).select("id", "name").first()
                if at:
                    rows = (self.impact(repo_id, at.id) if first.intent == "impact" else self.similar_code(repo_id, at.id)).collect()
                    events.append({"kind": "card", "card": first.intent, "symbol": at.name, "items": [r.asDict() for r in rows]})
            context = ""
            if self.get_repo(repo_id)["indexed"] == DONE:
                near = self.search(repo_id, question, 5).withColumn("text", F.col("snippet")).drop("place")
                block = S.context_blocks(near).first()
                context = block.block if block else ""
            injected = used if first.intent != "chat" or first.related else ""
            room = (5000, 6000) if context else (8000, 8000)
            turns = self.spark.createDataFrame([(1, i, m["role"], m["text"]) for i, m in enumerate(history or [])], "conv_id bigint, turn bigint, role string, text string")
            request = self.spark.createDataFrame([(1, question, injected)], "conv_id bigint, question string, code string")
            parts = C.chat_messages(request, turns, f"{{code}}\n\n{context}".strip(), room[1], room[0]).first().messages
            prompt = "\n\n".join(f"{m.role}: {m.text}" for m in parts)
        else:
            context = self.spark.createDataFrame([(1, mode, file_path, line_start, line_end, code, "")], "id int, mode string, file_path string, line_start int, line_end int, code string, call_context string")
            prompt = C.prompts(context, templates or C.TEMPLATES).first().prompt
        return events + _answered(model, prompt)

    def file_docs(self, repo_id: str, file_path: str, model: Callable) -> list[dict]:
        """STR-2, SRC-24: the events of a file's documents: header, a progress and a text event for each class, done; error if the model fails."""
        from codeloom.streaming import events as E

        source = self.read_file(repo_id, file_path)["content"].split("\n")
        methods = self.table("methods", repo_id).where(F.col("file_path") == file_path)
        lines = {r.class_name: (r.a, r.b) for r in methods.groupBy("class_name").agg(F.min("line_start").alias("a"), F.max("line_end").alias("b")).collect()}
        out = []
        for e in E.docs_events(methods).orderBy("seq").collect():
            event = {"kind": e.kind, "class_name": e.class_name, "file_path": file_path}
            if e.kind == "text":
                a, b = lines[e.class_name]
                answer = _answered(model, "\n".join([f"Documents for {e.class_name or file_path}:", *source[a - 1 : b]]))
                if answer[-1]["kind"] == "error":
                    return [*out, answer[-1]]
                event["text"] = answer[0]["text"]
            out.append(event)
        return out


MODES = ("summary", "bug", "deps", "custom", "docs")


def _answered(model: Callable, prompt: str) -> list[dict]:
    try:
        return [{"kind": "text", "text": model([prompt])[0]}, {"kind": "done"}]
    except Exception as e:
        return [{"kind": "error", "message": str(e)[:500]}]
