"""What the service streams, as rows: events of an answer, of generated documents, frames, and the progress of indexing.

Batch and streaming DataFrames share these functions where they only select; windowed counts are an extension for streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def answer_events(turns: DataFrame) -> DataFrame:
    """STR-1: the events of each user turn, in order: intent; smart_resolve and card, where the turn has such rows; text and done, or error where the model failed.

    turns: conv_id, turn, role and, if known, resolved, card and failed (boolean).
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in turns.columns else F.lit(False)
    kinds = [(F.lit(True), "intent"), (flag("resolved"), "smart_resolve"), (flag("card"), "card"), (~flag("failed"), "text"), (~flag("failed"), "done"), (flag("failed"), "error")]
    listed = F.filter(F.array(*[F.when(when, F.lit(kind)) for when, kind in kinds]), lambda k: k.isNotNull())
    return turns.where("role = 'user'").select("conv_id", "turn", F.posexplode(listed).alias("seq", "kind"))


def docs_events(methods: DataFrame) -> DataFrame:
    """STR-2: header, then progress and text of each class of a file, then done; a class's place is that of its first line."""
    classes = methods.groupBy("file_path", "class_name").agg(F.min("line_start").alias("first"))
    order = Window.partitionBy("file_path").orderBy("first", "class_name")
    placed = classes.withColumn("k", F.row_number().over(order).cast("long"))
    event = lambda seq, kind: F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"))
    inner = placed.select("file_path", "class_name", F.explode(F.array(event(2 * F.col("k") - 1, "progress"), event(2 * F.col("k"), "text"))).alias("e"))
    outer = placed.groupBy("file_path").agg(F.max("k").alias("n")).select("file_path", F.lit("").alias("class_name"), F.explode(F.array(event(F.lit(0), "header"), event(2 * F.col("n") + 1, "done"))).alias("e"))
    return inner.unionByName(outer).select("file_path", "e.seq", "e.kind", "class_name")


def frames(events: DataFrame) -> DataFrame:
    """Server-sent event text of each user's events (user_id, event_id, event_type), in the order of their ids."""
    data = F.concat(F.lit("data: "), F.to_json(F.struct("event_id", "event_type")), F.lit("\n\n"))
    return events.groupBy("user_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("event_id", data.alias("data")))), lambda x: x["data"])).alias("text"))


def parse_frames(text: DataFrame) -> DataFrame:
    """STR-3: the JSON of each whole frame (user_id, text); what follows the last blank line is incomplete and left out."""
    parts = F.split("text", "\n\n")
    whole = F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.startswith("data:"))
    rows = text.select("user_id", F.explode(whole).alias("frame"))
    return rows.select("user_id", F.from_json(F.trim(F.substring("frame", 6, 1 << 30)), "event_id bigint, event_type string").alias("x")).select("user_id", "x.event_id", "x.event_type")


def progress(repos: DataFrame) -> DataFrame:
    """STR-4: repositories by state, and whether that state is an end."""
    return repos.groupBy("indexed").agg(F.count("*").alias("n")).withColumn("finished", F.col("indexed") >= 2)


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Extension: events by type and window, for batches and for streams, whose late rows a watermark bounds."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
