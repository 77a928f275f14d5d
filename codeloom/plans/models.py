"""Text models behind one interface: list of prompts -> list of answers. Without a model, or where it fails, answers are empty."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from codeloom.functions.text import clean_expansion, clean_hypothesis, needs_expansion, picked_numbers

Model = Callable[[list[str]], list[str]]


def no_model(prompts: list[str]) -> list[str]:
    return [""] * len(prompts)


#: Characters of the prompts that go to a model together.
PROMPT_CHARS = 8_000_000


def answered(rows: DataFrame, prompt_col: str, model: Model = no_model, end: str = "") -> DataFrame:
    """rows with answer; prompts that are null get none. What all prompts end with (end) is sent to a worker once, and put there.

    A model is called with prompts of PROMPT_CHARS characters together, or a single longer one, within an Arrow batch.
    """
    shared = rows.sparkSession.sparkContext.broadcast(end)

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            answers = pd.Series([""] * len(b), index=b.index, dtype=object)
            asked = b.loc[b[prompt_col].notna(), prompt_col]
            group = ((asked.str.len() + len(shared.value)).cumsum() // PROMPT_CHARS).astype("int64")
            for _, some in asked.groupby(group):
                with contextlib.suppress(Exception):  # a model that is down costs its answers, not the search
                    answers[some.index] = model([x + shared.value for x in some])
            yield b.assign(answer=answers)

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("answer", StringType())]))


def expansions(queries: DataFrame, model: Model = no_model) -> DataFrame:
    """LLM-1: query_id and English keywords of the queries (query_id, text, language) that are not English."""
    prompt = F.when(needs_expansion(F.col("language")), F.concat(F.lit("English keywords for a code search, nothing else: "), "text"))
    return answered(queries.select("query_id", prompt.alias("prompt")), "prompt", model).select("query_id", clean_expansion(F.col("answer")).alias("expansion"))


def hypotheses(queries: DataFrame, model: Model = no_model) -> DataFrame:
    """LLM-2, RET-3: query_id and the code that queries (query_id, text, intent) about meaning or impact might find; empty if under ten characters."""
    prompt = F.when(F.col("intent").isin("semantic", "impact"), F.concat(F.lit("A short code snippet, and nothing else, that would answer: "), "text"))
    return answered(queries.select("query_id", prompt.alias("prompt")), "prompt", model).select("query_id", clean_hypothesis(F.col("answer")).alias("code"))


def picked_symbols(rows: DataFrame, model: Model = no_model, listing: str | None = None) -> DataFrame:
    """LLM-3: id and the numbers that the model picks from a numbered list of symbols (id, question, listing, n).

    A listing that all questions have in common (id, question) is not written into each row.
    """
    head = F.concat(F.lit("Numbers, separated by commas, of the symbols that this is about: "), "question", F.lit("\n"))
    if listing is None:
        found = answered(rows.select("id", "n", F.concat(head, "listing").alias("prompt")), "prompt", model)
    else:
        found = answered(rows.select("id", F.lit(len(listing.split("\n"))).alias("n"), head.alias("prompt")), "prompt", model, listing)
    return found.select("id", picked_numbers(F.col("answer"), F.col("n")).alias("picked"))


def legacy_messages(turns: DataFrame, most: int = 20) -> DataFrame:
    """LLM-9: the last turns of each conversation, whatever their length."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")
