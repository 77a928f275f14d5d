"""Documents from raw texts to token ids: five stages, each by one operator of codeloom.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.byte_bpe import encode_decode
from codeloom.llm.common import materialize
from codeloom.llm.decontaminate import contamination
from codeloom.llm.language_id import fit, predict
from codeloom.llm.minhash_dedup import one_of_each, without_ids
from codeloom.llm.suffix_dedup import SHORT, remove_repeats

#: A document stays if its best language is at least this likely.
LEAST_SCORE = 0.3
#: Strings of so many bytes that repeat are removed: about 35 words, so that passages of over 50 words that repeat are caught.
REPEAT_BYTES = SHORT


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; texts that are null, without letters or like no language go."""
    lang, score = free_names(docs, "lang_pred", "score")
    found = predict(docs, fit(docs), keep_columns=True, names=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of REPEAT_BYTES that repeat; a document of which nothing is left goes."""
    (before,) = free_names(docs, "before")
    rest = remove_repeats(docs.withColumn(before, F.length("text")), keep_columns=True, length=REPEAT_BYTES)
    rest = rest.where(F.col("text").isNull() | (F.col("text") != "") | (F.col(before) == 0)).select(docs.columns)
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return rest


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """names, made new to docs by underscores."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        out.append(n)
    return out


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Rows go by their texts, so that repeated and missing ids do no harm."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    (key,) = free_names(docs, "text_key")
    keyed = docs.withColumn(key, F.md5("text"))
    return without_ids(keyed, contamination(keyed, items, id_col=key).where("contaminated").select(key), key).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digest of the bytes that they decode to."""
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("language_id", languages),
    ("minhash_dedup", near_duplicates),
    ("suffix_dedup", repeats),
    ("decontamination", benchmark),
    ("byte_bpe", token_ids),
]

#: SQL cannot express these stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
