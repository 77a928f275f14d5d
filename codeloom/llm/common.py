"""What the operators of this subpackage share: working folders, chunked text encoding, packing."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Entries of one generation of a worker's cache of encoded chunks; it holds two.
CACHE_ENTRIES = 800_000
#: Characters handled together inside one Arrow batch; bounds a worker's memory whatever the batch holds.
SLICE_CHARS = 2_000_000
#: Rows of an Arrow batch and of a Parquet reader's batch.
BATCH_ROWS = 500

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir. Where that is unset, a folder of our own, which only a local master can share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        top = _own_dirs.setdefault(key, tempfile.mkdtemp(prefix="codeloom-"))
    return top.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Rows that pass between Parquet, Spark and Python together: at most BATCH_ROWS for the rest of the session, since texts are long.

    A text of a few kilobytes makes 10,000 rows, Spark's own number, some 50 MB in each of several buffers of each task.
    """
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/codeloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing that is still to run reads it."""
    for df in frames:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# --- text in chunks ---------------------------------------------------------------------------------

_CHUNKS = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: White space (by any engine's tables) other than the four characters at which _CHUNKS cuts.
_ODD_SPACE = re.compile("[^\\S \n\t\r]|[\u180e\u200b]")
_ODD_ASCII = "\x0b\x0c\x1c\x1d\x1e\x1f"


def chunks(text: str) -> list[str]:
    """Cuts text before white space that follows a non-space: byte-level BPE pre-tokens never cross such a place, so that
    encoding chunks one by one gives what the whole gives. A text with other kinds of white space is one chunk."""
    if any(c in text for c in _ODD_ASCII) if text.isascii() else _ODD_SPACE.search(text):
        return [text]
    return _CHUNKS.findall(text)


_ANY_ODD_SPACE = re.compile(f"[^\\S \n\t\r]|[\u180e\u200b{_ODD_ASCII}]")


def words(text: str) -> list[str]:
    """chunks() without their white space, for tokenizers that drop it."""
    return [text] if _ANY_ODD_SPACE.search(text) else text.split()


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(start, texts) runs of about SLICE_CHARS characters; nulls become empty texts."""
    start, size, run = 0, 0, []
    for i, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= SLICE_CHARS:
            yield start, run
            start, size, run = i + 1, 0, []
    if run:
        yield start, run


class ChunkCache:
    """Chunk -> encoded value, filled by fill(list of new chunks). What was used lately stays: a full generation makes way for a new one, which takes over what it meets again."""

    def __init__(self, fill: Callable[[list[str]], Iterable], entries: int = CACHE_ENTRIES, longest: int = 256):
        self.fill, self.entries, self.longest, self.known, self.old = fill, entries, longest, {}, {}

    def values(self, docs: list[list[str]]) -> list[Iterator]:
        """The values of the chunks of each of docs."""
        if len(self.known) > self.entries:
            self.old, self.known = self.known, {}
        known = self.known
        new = set().union(*docs).difference(known)
        if new and self.old:
            again = {c: self.old[c] for c in new if c in self.old}
            known.update(again)
            new.difference_update(again)
        if new:
            chunks = list(new)
            found = dict(zip(chunks, self.fill(chunks), strict=True))
            if max(map(len, chunks)) > self.longest:  # long chunks are not kept beyond this call
                known.update((c, x) for c, x in found.items() if len(c) <= self.longest)
                known = known | found
            else:
                known.update(found)
        return [map(known.__getitem__, d) for d in docs]


# --- what worker processes keep ---------------------------------------------------------------------

_held: tuple[Any, Any] = (None, None)


def worker_state(key: tuple, make: Callable[[], Any] = lambda: None) -> Any:
    """What this process keeps for key (an operator and its parameters) from task to task, made on first use.

    Worker processes outlive tasks and stages. A process keeps the state of one operator, the last that asked: a model and
    its caches end when another operator begins, and their memory goes back to the machine.
    """
    global _held
    if _held[0] != key:
        _held = (None, None)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
        _held = (key, make())
    return _held[1]
