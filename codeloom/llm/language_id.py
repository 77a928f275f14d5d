"""Language identification by words first and character n-grams for words unseen in training.

A word of the training sample scores by its log frequency in each language. An unseen word backs off to its character
n-grams (with word boundaries), the longest first: those of the first length of which any is known score it by their mean.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import ChunkCache, bound_batches, slices, worker_state

#: The model is fitted on the labelled documents of each language that are lowest by a hash, about so many a language. Of these it
#: keeps every word and n-gram.
SAMPLE_DOCS = 1500
LONGEST = 5
ALPHA = 0.1
#: Words that count as independent evidence: longer texts' log likelihoods are scaled down to so many.
EVIDENCE = 20

_words = regex.compile(r"\p{L}+").findall


def words(text: str) -> list[str]:
    return _words(text.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


@dataclass
class Model:
    """tables[0]: words, tables[n]: n-grams; of each its number and the log frequencies of that number by language. langs is sorted."""

    langs: list[str]
    tables: list[tuple[dict[str, int], np.ndarray]]

    def word_scores(self, word: str) -> np.ndarray | None:
        """One log frequency for each language; None if not even a character is known."""
        known, scores = self.tables[0]
        at = known.get(word)
        if at is not None:
            return scores[at]
        for n in range(LONGEST, 0, -1):
            known, scores = self.tables[n]
            hits = [known[g] for g in grams(word, n) if g in known]
            if hits:
                return scores[hits].mean(axis=0)
        return None

    def predictor(self):
        """texts -> (language or und, score) with a cache of words' scores, each packed with a 1 for a word that counts."""
        width = len(self.langs) + 1
        nothing = np.zeros(width, np.float32).tobytes()
        one = np.ones(1, np.float32)

        def fill(new: list[str]) -> list[bytes]:
            found = map(self.word_scores, new)
            return [nothing if s is None else np.concatenate((s, one)).astype(np.float32).tobytes() for s in found]

        cache = ChunkCache(fill, entries=100_000)

        def predict(texts: list[str]) -> list[tuple[str, float]]:
            docs = [words(t) for t in texts]
            out = []
            for d, packed in zip(docs, cache.values(docs) if self.langs else docs, strict=True):
                if not d or not self.langs:
                    out.append(("und", 0.0))
                    continue
                total = np.frombuffer(b"".join(packed), np.float32).reshape(-1, width).sum(axis=0, dtype=np.float64)
                scores, n = total[:-1], total[-1]
                z = (scores - scores.max()) * min(1.0, EVIDENCE / max(n, 1.0))
                p = np.exp(z)
                best = int(np.argmax(scores))
                out.append((self.langs[best], float(p[best] / p.sum())))
            return out

        return predict


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from rows with text and language whose id is not null and not held out.

    The sample is bounded by sample_docs a language (chosen by a hash, about so many); counts are made by the executors, and
    the driver receives the words and n-grams of this sample, each once for a language.
    """
    bound_batches(df.sparkSession)
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = named.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], [({}, np.zeros((0, 0), np.float32)) for _ in range(LONGEST + 1)])
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample_docs / totals[k]))])
    sample = rows.where(place < share[F.col("lang")]).select("lang", "text")

    def run(batches):
        counts: dict[tuple[str, int], Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.setdefault((lang, 0), Counter()).update(words(text))
        for lang in {k for k, _ in counts}:
            for w, m in counts[lang, 0].items():
                for n in range(1, LONGEST + 1):
                    c = counts.setdefault((lang, n), Counter())
                    for g in grams(w, n):
                        c[g] += m
        for (lang, n), c in counts.items():
            k = len(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([n] * k, pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "n", "gram", "m"])

    counted = sample.mapInArrow(run, "lang string, n int, gram string, m bigint").groupBy("lang", "n", "gram").agg(F.sum("m").alias("m"))
    found: list[dict[str, dict[str, int]]] = [{} for _ in range(LONGEST + 1)]
    for r in counted.orderBy("n", "gram", "lang").toLocalIterator():
        found[r.n].setdefault(r.gram, {})[r.lang] = r.m
    tables = []
    for grams_of in found:
        sums = np.array([sum(m.get(k, 0) for m in grams_of.values()) for k in langs], float)
        base = np.log(sums + ALPHA * max(1, len(grams_of)))
        scores = np.array([[m.get(k, 0) for k in langs] for m in grams_of.values()], float).reshape(-1, len(langs))
        tables.append(({g: i for i, g in enumerate(grams_of)}, (np.log(scores + ALPHA) - base).astype(np.float32)))
    return Model(langs, tables)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Language and score, under the two names, of every whole text, one row for each input row, repeated rows included.

    A null text, and one without letters (Unicode category L), is `und` with score 0; so is every text under a model without
    languages. Of equal scores the first language by name wins. With keep_columns all columns of df come back beside the
    two, whose names must then be new to it; else id_col alone. An empty table gives an empty table. No shuffle; the model,
    which is bounded by its sample, is broadcast.
    """
    if keep_columns and {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column of its own named {names[0]} or {names[1]}")
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    base = df if keep_columns else df.select(F.col(id_col), F.col(text_col).alias("__text"))
    text_at = base.columns.index(text_col) if keep_columns else 1
    keep = [i for i in range(len(base.columns)) if keep_columns or i != 1]
    schema = base.select([base.columns[i] for i in keep]).schema.add(names[0], "string").add(names[1], "double")
    key = ("language_id", uuid.uuid4().hex)  # each model has a state of its own

    def run(batches):
        of = worker_state(key, lambda: shared.value.predictor())
        for b in batches:
            for start, part in slices(b.column(text_at).to_pylist()):
                found = of(part)
                columns = [b.column(i).slice(start, len(part)) for i in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=schema.names)

    return base.mapInArrow(run, schema)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on the rows not held out and predicts every row: id_col, held_out, lang_pred, score."""
    out = predict(df, fit(df, id_col, text_col, lang_col), id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
