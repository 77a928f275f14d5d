"""Tables that an operator writes and reads again, so that lineage stays short and lost executors cost nothing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a folder of our own, which only a local master can share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (top or _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="codeloom-work-"))).rstrip("/")


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    path = f"{work_dir(df.sparkSession)}/codeloom-work/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what checkpointed() wrote, once nothing that is still to run reads it."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over all cores, for rows that cost much to compute. How many pieces df has says nothing of it: a file with one group of rows, as some writers make of a million rows, is read by one task, and its other pieces are empty."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))
