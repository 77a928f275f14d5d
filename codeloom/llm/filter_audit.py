"""How five document filters act together, in every order, by aggregation over the lattice of their subsets.

A node of the lattice is the set of filters applied so far, an edge the filter that comes next: 80 edges for five filters.
What happens on an edge does not depend on the order in which the set was applied. So documents are counted by what they
fail, the counts contribute to the edges, and each of the 120 orders is a path of five edges.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import materialize

FILTERS = "ABCDE"
#: The last filter looks at other documents, the others at the text alone.
COPIES = 1 << FILTERS.index("E")

MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


#: ASCII white space, which ends words.
SPACES = " \t\n\x0b\x0c\r"


def with_text_failures(rows: DataFrame) -> DataFrame:
    """rows with fails in place of text, which is never null: the filters of A to D that it fails, as bits from the lowest.

    A: under 100 words; B: less than 80 % of its words distinct; C: over 10 % of its characters are A-Z; D: it holds one of
    # $ % & * |. Words are maximal runs of other characters than the six ASCII white spaces.
    """
    others = [c for c in rows.columns if c != "text"]
    cut = rows.select("*", F.btrim("text", F.lit(SPACES)).alias("trimmed")).select("*", F.split("trimmed", "[\\x20\\x09-\\x0D]+").alias("words"))
    counted = cut.select(*rows.columns, F.when(F.col("trimmed") == "", 0).otherwise(F.size("words")).cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))
    n_words, n_distinct = F.col("n_words"), F.col("n_distinct")
    capitals = F.regexp_count("text", F.lit("[A-Z]")).cast("long")
    marked = reduce(Column.__or__, [F.col("text").contains(c) for c in "#$%&*|"])
    fails = [n_words < 100, 100 * n_distinct < 80 * n_words, 100 * capitals > 10 * F.length("text").cast("long"), marked]
    return counted.select(*others, reduce(Column.bitwiseOR, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)]).alias("fails"))


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, fails (bits of FILTERS), good, toxic and n: how many documents are alike in these.

    A document fails E if a smaller id has its text, wherever that is in the table. Texts are told by their SHA-256. The
    smallest id of a text is found by an aggregation that combines before it shuffles, and the documents that hold it by a
    join on text and id; copies are all the rest. So no copy of a text, however many there are, is grouped or joined by its
    text alone. Rows without an id have no label and no smaller id, and stand aside of every join.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    rows = with_text_failures(rows.select("*", F.unhex(F.sha2("text", 256)).alias("digest")))
    rows = materialize(rows.groupBy("id", "part", "digest", "fails").agg(F.count("*").alias("n")), "audited")
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.lit(0).alias("copy"))
    marks = labels.select(F.col("doc_id").alias("id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    marks = marks.where("id is not null").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    known = rows.where("id is not null").join(marks, "id", "left").join(first, ["id", "digest"], "left")
    no = F.lit(False)
    known = known.select("part", F.col("fails").bitwiseOR(F.coalesce("copy", F.lit(COPIES))).alias("fails"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "n")
    nameless = rows.where("id is null").select("part", "fails", no.alias("good"), no.alias("toxic"), "n")
    return known.unionByName(nameless).groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def edges(alike: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, applied (bits), filter (bit) and the MEASURES of every edge of the lattice, zeros included; alike as failures() gives it."""
    bits = [1 << i for i in range(len(filters))]
    all_edges = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(b).alias("filter")) for s in range(1 << len(filters)) for b in bits if not s & b])
    rows = alike.select("*", F.explode(all_edges).alias("edge")).select("*", "edge.applied", "edge.filter")
    gone = F.col("fails").bitwiseAND(F.col("applied")) != 0
    hit = F.col("fails").bitwiseAND(F.col("filter")) != 0
    cases = [~gone & ~hit, ~gone & hit, gone & hit, F.col("fails") == F.col("filter"), ~gone & hit & F.col("good"), ~gone & hit & F.col("toxic")]
    return rows.groupBy("part", "applied", "filter").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(m) for m, c in zip(MEASURES, cases, strict=True)])


def paths(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """filter_order, step, applied and filter: each order of the filters as a path through the lattice. Five filters have 600 such steps."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    rows = [("".join(order), k + 1, sum(bit[f] for f in order[:k]), bit[order[k]]) for order in permutations(filters) for k in range(len(order))]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter int")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step, with the MEASURES of that step and the filter's shapley sum.

    part is the value of part_col as a string, null as an empty one. A null text counts as empty. A repeated row counts
    each time; rows of one id and text are no copies of each other; an id with several labels is good or toxic if one of
    them says so. Other columns are not read, so their names cannot clash; an empty table gives no rows. The shuffles carry
    an id, a digest and a few flags a document, texts never; the table of steps is as large as the orders are many.
    """
    lattice = edges(failures(docs, labels, id_col, text_col, part_col))
    steps = paths(docs.sparkSession)
    along = lattice.join(F.broadcast(steps), ["applied", "filter"])
    total = lattice.join(F.broadcast(steps.groupBy("applied", "filter").agg(F.count("*").alias("orders"))), ["applied", "filter"])
    total = total.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return along.join(total, ["part", "filter"]).select("part", "filter_order", "step", *MEASURES, "shapley")
