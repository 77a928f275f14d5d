"""WARC archives without repeated payloads.

Headers (digest, length, id, url; never payloads) are shuffled by digest to find, of equal payloads, the one that stays a
response; the others become revisits of it. Every record is written with fresh headers, as a gzip member of its own, so
that readers can begin at any record. Archives are written by Spark's text writer, so they are committed on any store; what
it writes after a record is an empty gzip member, which is nothing to a reader of archives, and by which Spark splits an archive
of any size among tasks.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import bound_batches, worker_state

#: Payloads of fewer bytes are never revisits.
MIN_BYTES = 1000
#: Payloads of more copies than this are broadcast, and so are at most a million of them, whatever the number of pages.
HOT_COPIES, HOT_PAYLOADS = 10_000, 1_000_000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"
#: Bytes gathered before they go to the writer.
TOGETHER = 4 << 20


def member(data: bytes, level: int = 6) -> bytes:
    """data as one gzip member without a date, in which EMPTY does not occur."""
    for n in [level, *range(10)]:
        pack = zlib.compressobj(n, zlib.DEFLATED, 31)
        out = pack.compress(data) + pack.flush()
        if not data or EMPTY not in out:
            return out
    raise ValueError("a record that no level keeps apart")


EMPTY = member(b"")


def resolve_revisits(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """id, url, payload, payload_bytes, payload_digest (hex SHA-1), refers_to and refers_to_url of every row.

    Of the rows whose payloads are equal and have min_bytes at least, the one with the largest id is referred to by the
    others; refers_to is null for it and for all rows that are alone or smaller. Equal payloads are those of equal digest
    and length. Rows that share the largest id all keep refers_to null (refers_to_url is the largest of their urls); a row
    without id never becomes the referred one.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    pages = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.encode("payload", "UTF-8"))})
    keys = ["payload_digest", "payload_bytes"]
    shared = pages.where(F.col("payload_bytes") >= min_bytes).groupBy(*keys).agg(F.max(F.struct("id", "url")).alias("last"), F.count("*").alias("n")).where("n > 1 and last.id is not null")
    shared = shared.select(*keys, F.col("last.id").alias("original"), F.col("last.url").alias("original_url"), "n")
    # A payload of very many copies would bring them into one task of a join by digest: these go by broadcast, and their copies are dealt by id.
    least = max(HOT_COPIES, -(-df.count() // HOT_PAYLOADS))
    hot = shared.where(F.col("n") > least).select(*keys, F.struct("original", "original_url").alias("hot"))
    dealt = pages.join(F.broadcast(hot), keys, "left").withColumn("salt", F.when(F.col("hot").isNotNull(), F.xxhash64("id", "url")).otherwise(F.lit(0)))
    rest = shared.where(F.col("n") <= least).select(*keys, F.lit(0).cast("long").alias("salt"), F.struct("original", "original_url").alias("rest"))
    of = F.coalesce("hot", "rest")
    found = dealt.join(rest, [*keys, "salt"], "left").withColumn("of", F.when(~F.col("id").eqNullSafe(of["original"]), of))
    return found.select("id", "url", "payload", *keys, F.col("of.original").alias("refers_to"), F.col("of.original_url").alias("refers_to_url"))


def _uri(url: Column) -> Column:
    return F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20")


def record(date: str) -> Column:
    """The text of one WARC record of this date from a row of resolve_revisits()."""
    revisit = F.col("refers_to").isNotNull()
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    or_none = lambda x: F.coalesce(x, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{PAGE}"), name, F.lit(">"))),
        or_none(line("WARC-Target-URI", _uri(F.col("url")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", F.concat(F.lit(f"<{PAGE}"), F.col("refers_to").cast("string"), F.lit(">"))),
                or_none(line("WARC-Refers-To-Target-URI", _uri(F.col("refers_to_url")))),
                line("WARC-Refers-To-Date", F.lit(date)),
            ),
        ).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit(END),
    )


def write_archives(df: DataFrame, path: str, date: str | None = None, **columns) -> None:
    """Writes a WARC record for every row of df into archives under path, a gzip member each; columns as in resolve_revisits().

    All records bear the date (as 2000-01-01T00:00:00Z; by default the time of this call). A null payload counts as empty
    and is a response; a null URL leaves the target URI out; an empty table gives archives without records; other columns
    are not read. Payloads are shuffled once at most, to the tasks that write them.
    """
    bound_batches(df.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        worker_state(("warc",))
        for b in batches:
            out, size = [], 0
            for text in b.column(0).cast(pa.binary()):
                out.append(member(text.as_py()))
                size += len(out[-1])
                if size >= TOGETHER:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    rows = resolve_revisits(df, **columns).select(record(date).alias("text")).mapInArrow(run, "record binary")
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not the beginning of a WARC record: {first[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("an archive ends inside a record")
        yield headers, block


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row for each record under path: page, target_uri, record_type, payload_bytes, payload_digest, refers_to, refers_to_uri, date and, if asked for, payload.

    Length and digest of a response are those of the payload as read, and must agree with its headers; those of a revisit
    are its headers'. page and refers_to are strings (null: none). Archives are those of write_archives(), of any size.
    """
    bound_batches(spark)
    names = ["page", "target_uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "refers_to_uri", "date", *(["payload"] if payloads else [])]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), *([pa.binary()] if payloads else [])]

    def name_of(uri: str | None) -> str | None:
        return (uri.strip("<>").removeprefix(PAGE) or None) if uri else None

    def row(content: bytes) -> tuple:
        found = list(parse(io.BytesIO(zlib.decompress(content, 31))))
        if len(found) != 1:
            raise ValueError("a gzip member does not hold one record")
        headers, block = found[0]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        if headers["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"the payload of {headers['warc-record-id']} differs from its headers")
        return (name_of(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], size, digest, name_of(headers.get("warc-refers-to")), headers.get("warc-refers-to-target-uri"), headers["warc-date"], payload)[: len(names)]

    def run(batches):
        worker_state(("warc",))
        for b in batches:
            found = [row(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * len(names), types, strict=True)], names=names)

    schema = "page string, target_uri string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, refers_to_uri string, date string" + ", payload binary" * payloads
    lines = spark.read.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return lines.select(F.col("value").cast("binary").alias("content")).mapInArrow(run, schema)
