"""Token-id files: each document is one zstandard frame, compressed with a dictionary that all of them share.

A set of files is a folder with two Parquet tables, so that Spark's writers commit it on any store and lost tasks leave
nothing behind. `dictionary` has one row: sha256, content, id width in bytes. `blocks` has a row for some hundred
documents, in ascending id order within a shard, shards in ascending order: shard, number in the shard, first token
in the shard, lowest and highest id, document ids, token counts, frame offsets (the index for reading one document) and
the frames' bytes.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import ChunkCache, bound_batches, chunks, slices, words, worker_state

#: The sample that the dictionary is trained on: about so many documents, the lowest by a hash; of longer ones a piece of so many characters, at a place by a hash.
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 8192
DICTIONARY_BYTES, LEVEL = 64 * 1024, 1
#: A block ends with the document that brings it to so many bytes of ids.
BLOCK_BYTES = 1 << 20


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        special = [(i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark_id, self.mark = (special[0][0], special[0][1].content) if special else (None, None)
        self.cache = ChunkCache(self.encode_chunks, entries=1_000_000)
        cutter = self.tokenizer.pre_tokenizer
        self.cut = words if cutter and [t for t, _ in cutter.pre_tokenize_str(" a \n\tb ")] == ["a", "b"] else chunks

    def encode_chunks(self, new: list[str]) -> list[bytes]:
        """Ids of each chunk, packed. Many chunks go to the library as one text, apart by a special token, at which it cuts texts first."""
        apart = [c for c in new if self.mark is None or self.mark in c]
        joined = sorted(set(new).difference(apart))
        found = {c: array(self.code, e.ids).tobytes() for c, e in zip(apart, self.tokenizer.encode_batch_fast(apart, add_special_tokens=False), strict=True)}
        for i in range(0, len(joined), 10_000):
            runs = [joined[k : k + 50] for k in range(i, min(i + 10_000, len(joined)), 50)]
            for run, e in zip(runs, self.tokenizer.encode_batch_fast([self.mark.join(r) for r in runs], add_special_tokens=False), strict=True):
                ids = array(self.code, e.ids)
                raw, at = ids.tobytes(), 0
                ends = (np.flatnonzero(np.frombuffer(raw, f"<u{self.width}") == self.mark_id) * self.width).tolist()
                for c, end in zip(run, [*ends, len(raw)], strict=True):
                    found[c] = raw[at:end]
                    at = end + self.width
        return [found[c] for c in new]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian, of self.width bytes each."""
        return [b"".join(d) for d in self.cache.values([self.cut(t) for t in texts])]


def encoder(path: str) -> Encoder:
    """The one of this worker process."""
    return worker_state(("token_files", path), lambda: Encoder(path))


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; of samples too few or too alike to train on, their last bytes serve as it."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def write_token_files(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends end_id, and writes the files under path in ascending order of id_col.

    Rows of one id follow one another in the order of their texts; null ids come first; a null text counts as empty; an
    empty table gives files without blocks. Other columns are not read. The ids' range partitioning is the one shuffle, of
    ids and texts; a task holds one block and one Arrow batch.
    """
    spark = df.sparkSession
    bound_batches(spark)
    data = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    width = Encoder(tokenizer_path).width
    plain = end_id.to_bytes(width, "little")
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rest = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0))
    piece = F.col("text").substr(F.pmod(F.xxhash64("text", "id"), rest + 1).cast("int") + 1, F.lit(SAMPLE_CHARS))
    rows = data.where(place < SAMPLE_DOCS / max(1, df.count())).select("id", piece.alias("text")).collect()
    samples = [ids + plain for ids in encoder(tokenizer_path).encode([r.text for r in sorted(rows, key=lambda r: (r.id is not None, r.id, r.text))])]
    content = train_dictionary(samples)
    digest = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(digest, bytearray(content), width)], "sha256 string, content binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(content)
    id_kind = data.schema["id"].dataType.simpleString()

    def run(batches):
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None)
        enc, shard = encoder(tokenizer_path), TaskContext.get().partitionId()
        number = first = raw = 0
        ids, counts, offsets, body = [], [], [0], bytearray()

        def block():
            given = [i for i in ids if i is not None]
            data = [[shard], [number], [first], [min(given, default=None)], [max(given, default=None)], [pa.array(ids)], [counts], [offsets], [bytes(body)]]
            return pa.RecordBatch.from_arrays([pa.array([x], type=t) if not isinstance(x, pa.Array) else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(t.value_type)) for (x,), t in zip(data, types, strict=True)], names=names)

        for b in batches:
            kind = b.schema.field(0).type
            types = [pa.int32(), pa.int64(), pa.int64(), kind, kind, pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["shard", "number", "first", "low", "high", "ids", "counts", "offsets", "body"]
            at, keys = 0, b.column(0).to_pylist()
            for _, part in slices(b.column(1).to_pylist()):
                for tokens in enc.encode(part):
                    tokens += plain
                    ids.append(keys[at])
                    at += 1
                    counts.append(len(tokens) // width)
                    body += compressor.compress(tokens)
                    offsets.append(len(body))
                    raw += len(tokens)
                    if raw >= BLOCK_BYTES:
                        yield block()
                        number, first = number + 1, first + sum(counts)
                        raw, ids, counts, offsets, body = 0, [], [], [0], bytearray()
        if ids:
            yield block()

    schema = f"shard int, number bigint, first bigint, low {id_kind}, high {id_kind}, ids array<{id_kind}>, counts array<bigint>, offsets array<bigint>, body binary"
    data.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/blocks")


def read_dictionary(spark: SparkSession, path: str) -> tuple[bytes, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    content = bytes(row.content)
    if hashlib.sha256(content).hexdigest() != row.sha256:
        raise ValueError("the dictionary does not have the digest kept beside it")
    return content, row.width


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """Documents of a set of files: id_col, start (tokens of all documents before it) and of outputs n_tokens, ids, ids_crc32.

    Shard totals (a row for each writing task) give the shards' starts; everything else is one pass over the blocks.
    """
    content, width = read_dictionary(spark, path)
    shared = spark.sparkContext.broadcast(content)
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    # The count of tasks that wrote is what bounds these totals.
    totals = blocks.select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()
    starts, at = [], 0
    for r in totals:
        starts.append((r.shard, at))
        at += r.n
    kinds = {"n_tokens": ("bigint", pa.int64()), "ids": ("array<bigint>", pa.list_(pa.int64())), "ids_crc32": ("bigint", pa.int64())}

    def run(batches):
        import zstandard

        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None)
        make = {"n_tokens": len, "ids": lambda x: x.astype(np.int64), "ids_crc32": lambda x: zlib.crc32(x.astype("<u4").tobytes())}
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r] for n in ("shard", "first", "ids", "counts", "offsets", "body")}
                body, offsets = row["body"].as_buffer(), row["offsets"].values.to_numpy()
                counts = row["counts"].values.to_numpy()
                begin = row["first"].as_py() + np.cumsum(counts) - counts
                docs = [np.frombuffer(opener.decompress(body[int(i) : int(j)]), f"<u{width}") for i, j in zip(offsets, offsets[1:], strict=False)]
                if [len(d) for d in docs] != counts.tolist():
                    raise ValueError("a frame does not hold as many ids as its index says")
                columns = [pa.array([row["shard"].as_py()] * len(docs), pa.int32()), row["ids"].values, pa.array(begin, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([make[n](d) for d in docs], kinds[n][1]) for n in outputs)], names=["shard", "id", "begin", *outputs])

    schema = ", ".join([f"shard int, id {id_type}, begin bigint", *(f"{n} {kinds[n][0]}" for n in outputs)])
    docs = blocks.select("shard", "first", "ids", "counts", "offsets", "body").mapInArrow(run, schema)
    shards = spark.createDataFrame(starts, "shard int, shard_start bigint")
    return docs.join(shards, "shard").select(F.col("id").alias(id_col), (F.col("begin") + F.col("shard_start")).alias("start"), *outputs)


def read_documents(spark: SparkSession, path: str, wanted: list, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_tokens and ids of the documents whose ids are wanted, by the index: blocks by their lowest and highest id, then frames by their offsets.

    Only the frames of these documents leave Spark's reader and are decompressed. An id that several rows had comes back for
    each of them, an unknown one not at all.
    """
    content, width = read_dictionary(spark, path)
    shared = spark.sparkContext.broadcast(content)
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    if not wanted:
        return spark.createDataFrame([], f"{id_col} {id_type}, n_tokens bigint, ids array<bigint>")
    here = (F.col("low") <= max(wanted)) & (F.col("high") >= min(wanted))
    one = blocks.where(here).select("counts", "offsets", "body", F.posexplode("ids").alias("i", "id")).where(F.col("id").isin(wanted))
    begin, end = F.col("offsets")[F.col("i")], F.col("offsets")[F.col("i") + 1]
    frames = one.select("id", F.col("counts")[F.col("i")].alias("n"), F.substring("body", begin.cast("int") + 1, (end - begin).cast("int")).alias("frame"))

    def run(batches):
        import zstandard

        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None)
        for b in batches:
            found = [np.frombuffer(opener.decompress(x), f"<u{width}").astype(np.int64) for x in b.column(2).to_pylist()]
            if [len(x) for x in found] != b.column(1).to_pylist():
                raise ValueError("a frame does not hold as many ids as its index says")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], names=["id", "n", "ids"])

    out = frames.mapInArrow(run, f"id {id_type}, n bigint, ids array<bigint>")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), "ids")
