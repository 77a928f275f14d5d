"""Fill-in-the-middle examples, cut by DuckDB inside Spark's Arrow batches.

Each batch is registered as a table of an in-process DuckDB, whose SQL cuts the texts into units, draws two places and a
form from a digest of the document's id, and puts the parts together. No row is handled by Python; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import bound_batches

#: Bytes of text that DuckDB gets at once. A list entry takes 16 bytes and a unit one byte at least, so that a slice of this size takes some 100 MB at most.
SLICE_BYTES = 2 << 20

#: What marks the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")

_SQL = """
WITH cut AS (
    SELECT id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, sha256($seed || ':' || id_text) AS hex
    FROM (SELECT id, coalesce(CAST(id AS VARCHAR), '') AS id_text, coalesce(text, '') AS text FROM batch)),
drawn AS (
    SELECT id, text, units, len(units) AS n,
           CAST('0x' || hex[1:8] AS UBIGINT) % (len(units) + 1) AS one, CAST('0x' || hex[9:16] AS UBIGINT) % (len(units) + 1) AS two,
           CASE WHEN len(units) = 0 OR contains(text, $p) OR contains(text, $s) OR contains(text, $m)
                  OR CAST('0x' || hex[17:24] AS UBIGINT) % 100 >= $changed THEN 'plain'
                WHEN CAST('0x' || hex[25:32] AS UBIGINT) % 100 < $spm THEN 'spm' ELSE 'psm' END AS form
    FROM cut),
parts AS (
    SELECT id, text, n, form,
           array_to_string(list_slice(units, 1, CAST(least(one, two) AS BIGINT)), '') AS prefix,
           array_to_string(list_slice(units, CAST(least(one, two) AS BIGINT) + 1, CAST(greatest(one, two) AS BIGINT)), '') AS middle,
           array_to_string(list_slice(units, CAST(greatest(one, two) AS BIGINT) + 1, n), '') AS suffix
    FROM drawn)
SELECT id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       CASE form WHEN 'psm' THEN $p || prefix || $s || suffix || $m || middle
                 WHEN 'spm' THEN $s || suffix || $p || prefix || $m || middle ELSE text END AS output
FROM parts
"""


def byte_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about SLICE_BYTES in column, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def fill_in_middle(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    changed_percent: int = 90,
    spm_percent: int = 20,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """id_col, n (units of the text), form (plain, psm, spm), prefix_chars, middle_chars and output, the text to train on.

    Units are runs of A-Z and a-z and every other code point by itself. The digest of seed, a colon and the decimal id
    draws two places among the units and the form. A text that is empty or holds a mark stays plain, with null counts. A
    null text counts as empty, a null id as an empty string; equal ids draw alike; repeated rows stay repeated; an empty
    table gives an empty table. Other columns are not read, so their names cannot clash. Memory is bounded by SLICE_BYTES or
    the longest text, of which DuckDB holds some 20 bytes a unit. No mark may be part of another or overlap one, for
    restored() must find them.
    """
    for a in marks:
        for b in marks:
            if not a or (a is not b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError("marks must not be empty, hold or overlap one another")
    bound_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    values = {"seed": str(seed), "p": marks[0], "s": marks[1], "m": marks[2], "changed": changed_percent, "spm": spm_percent}

    def run(batches):
        import duckdb

        with duckdb.connect(config={"threads": 1}) as con:
            for b in batches:
                counts = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                schema = pa.schema(list(zip(["id", "n", "form", "prefix_chars", "middle_chars", "output"], [b.schema.field(0).type, *counts], strict=True)))
                for part in byte_slices(b, 1):
                    con.register("batch", pa.Table.from_batches([part]))
                    found = con.sql(_SQL, params=values).to_arrow_table()
                    con.unregister("batch")
                    yield from found.cast(schema).to_batches()

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = out.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that output was made of. Its parts hold no mark and marks do not overlap, so each stands in output once."""
    p, s, m = marks
    head, middle = F.split_part(output, F.lit(m), F.lit(1)), F.split_part(output, F.lit(m), F.lit(2))

    def sides(first: str, second: str) -> tuple[Column, Column]:
        rest = F.substr(head, F.lit(len(first) + 1))
        return F.split_part(rest, F.lit(second), F.lit(1)), F.split_part(rest, F.lit(second), F.lit(2))

    prefix, suffix = sides(p, s)
    suffix_first, prefix_last = sides(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_last, middle, suffix_first)).otherwise(output)
