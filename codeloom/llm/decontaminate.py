"""Benchmark decontamination: a prefix-filtered join of item windows with document words, exact by verification.

A window is matched only whole, so of its words, ordered by rarity (their count in all documents), the first is prefix
enough: the rarest. Windows are rows by their prefix word; so are the places of documents that hold such a word, each with the
words around it. The two are joined on the word. A pair stays if the window's start and end, which the word's offset gives,
lie within the document (positional and length bounds), and if the words there are those of the window.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import bound_batches, discard, materialize, slices, worker_state

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_words = re.compile(WORD).findall
WINDOW = 10
#: Up to so many words are broadcast, to leave out others before the join; beyond, the join alone does it.
SET_WORDS = 500_000
#: Documents with findings go by broadcast up to so many, by a shuffle beyond.
BROADCAST_ROWS = 200_000


def words(text: str | None) -> list[str]:
    """Words of a text: A-Z lower-cased, then runs of digits, a-z and everything beyond ASCII."""
    if not text:
        return []
    return _words(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))  # bytes.lower() is A-Z only


def windows(items: list[str], size: int) -> list[tuple[str, ...]]:
    """Runs of size words, or all words where they are fewer."""
    return [tuple(items[i : i + size]) for i in range(max(1, len(items) - size + 1))] if items else []


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as spans that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _windows(items: DataFrame, size: int) -> DataFrame:
    """window (its words, apart by a space), words, and items (ids, sorted) of every different window of items (item, text)."""

    def run(batches):
        worker_state(("decontaminate",))
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = list(dict.fromkeys(windows(words(text), size)))
                yield pa.RecordBatch.from_arrays([pa.array([" ".join(w) for w in found], pa.string()), pa.array(found, pa.list_(pa.string())), pa.array([item] * len(found), pa.string())], names=["window", "words", "item"])

    cut = items.mapInArrow(run, "window string, words array<string>, item string")
    return cut.groupBy("window").agg(F.first("words").alias("words"), F.array_sort(F.collect_set("item")).alias("items"))


def _only(words: DataFrame, most: int):
    """A broadcast set of words (word), or of None if they are more than most."""
    few = words.limit(most + 1).count() <= most
    return words.sparkSession.sparkContext.broadcast({r.word for r in words.collect()} if few else None)


def _counts(docs: DataFrame, vocabulary: DataFrame, most: int) -> DataFrame:
    """word and n, how often it occurs in all documents, of the words of the vocabulary."""
    only = _only(vocabulary, most)

    def run(batches):
        worker_state(("decontaminate",))
        total: Counter = Counter()
        for b in batches:
            for _, part in slices(b.column(0).to_pylist()):
                for t in part:
                    total.update(words(t) if only.value is None else filter(only.value.__contains__, words(t)))
            if len(total) > SET_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
                total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts if only.value is not None else counts.join(vocabulary, "word", "left_semi")


def _places(docs: DataFrame, prefixes: DataFrame, window: int, most: int) -> DataFrame:
    """docs (row, id, text, kept columns) as row, id, n_words, places of prefix words and the kept columns.

    A place: word, at (its number in the document), lead (words before it in around), around (it and up to window - 1 words on either side).
    """
    only = _only(prefixes, most)
    kept = docs.columns[3:]
    kind = docs.schema["id"].dataType.simpleString()
    place = "struct<word: string, at: bigint, lead: int, around: string>"
    schema = f"row bigint, id {kind}, n_words bigint, places array<{place}>" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        worker_state(("decontaminate",))
        for b in batches:
            for start, part in slices(b.column(2).to_pylist()):
                n, ends, found = [], [0], []
                for t in part:
                    tokens = words(t)
                    n.append(len(tokens))
                    if only.value is None or not only.value.isdisjoint(tokens):
                        found += [(w, i, min(i, window - 1), " ".join(tokens[max(0, i - window + 1) : i + window])) for i, w in enumerate(tokens) if only.value is None or w in only.value]
                    ends.append(len(found))
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [[]] * 4, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)]
                places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["word", "at", "lead", "around"]))
                own = [b.column(i).slice(start, len(part)) for i in range(b.num_columns)]
                yield pa.RecordBatch.from_arrays([*own[:2], pa.array(n, pa.int64()), places, *own[3:]], names=["row", "id", "n_words", "places", *kept])

    return docs.mapInArrow(run, schema)


def _merged_rows(batches: Iterator[pa.RecordBatch]):
    """row, spans, items with the spans merged."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        spans = [[{"start": x, "end": y} for x, y in merged([(s["start"], s["end"]) for s in row])] for row in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind), b.column(2)], names=["row", "spans", "items"])


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", set_words: int = SET_WORDS, keep_text: bool = False) -> DataFrame:
    """Finds every occurrence of every item window in every document.

    Returns id, n_words, spans (array of word ranges [start, end), apart and in order), items (ids as strings, sorted) and,
    with keep_text, text: one row for each document, repeated rows included. Null or wordless texts have no words and no
    hits; null or wordless items have no windows; null item ids are left out; an empty table of items leaves all documents
    clean. Other columns are not read, so their names cannot clash.

    Texts are read twice (to count the items' words, and to find prefix words) and not shuffled. What is shuffled grows with
    the windows and with the places of their prefix words. Nothing of the items is collected but up to set_words words.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    items = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = materialize(_windows(items, window), "windows")
    counts = materialize(_counts(texts, known.select(F.explode("words").alias("word")).distinct(), set_words), "counts")
    # A window with a word that no document has occurs nowhere.
    ranked = known.select("window", F.posexplode("words").alias("offset", "word")).join(counts, "word", "left")
    best = ranked.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "word", "offset")).alias("best")).where("best.n > 0")
    index = materialize(known.join(best, "window").select("best.word", "best.offset", F.size("words").alias("length"), "window", "items"), "index")
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "id", "text", *([F.col("text").alias("whole")] * keep_text))
    base = materialize(_places(numbered, index.select("word").distinct(), window, set_words), "places")  # row numbers are written, so they stay
    places = base.select("row", "n_words", F.explode("places").alias("p")).select("row", "n_words", "p.*")
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    there = F.array_join(F.slice(F.split("around", " "), F.col("lead") - F.col("offset") + 1, F.col("length")), " ")
    pairs = places.join(index, "word").where(inside).where(there == F.col("window")).select("row", F.struct(start.cast("long").alias("start"), (start + F.col("length")).cast("long").alias("end")).alias("span"), "items")
    found = pairs.groupBy("row").agg(F.collect_set("span").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    found = materialize(found.mapInArrow(_merged_rows, "row bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>"), "found")
    discard(known, counts, index)
    out = base.drop("places").join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, "row", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
    return out.select("id", "n_words", empty("spans"), empty("items"), *([F.col("whole").alias("text")] * keep_text))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", **options) -> DataFrame:
    """id_col, n_words, n_hit (words inside any occurrence), n_items, items_sha256 (of the sorted ids, comma-joined), contaminated; see find_windows()."""
    found = find_windows(docs, items, window, id_col, **options)
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    out = found.select(F.col("id").alias(id_col), "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
