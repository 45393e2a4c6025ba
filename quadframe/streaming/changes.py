"""Change events as a stream: running compaction, and batches merged into a stored log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.timeline import compact, latest


def current(events: DataFrame) -> DataFrame:
    """Last operation per quad of a streaming (or static) frame; write it in update or complete mode.

    The state is one row for each quad ever seen. It is never freed, as an event may be late by any time; for
    long streams, log_sink() with compactions bounds it."""
    return latest(events, ["s", "p", "o", "g"])


def log_sink(path: str):
    """For foreachBatch: appends each batch once to a change log under path, by batch number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select("s", "p", "o", "g", "ts", "op").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_log(spark, path: str) -> DataFrame:
    return compact(spark.read.parquet(path).select("s", "p", "o", "g", F.col("ts").cast("long").alias("ts"), "op"))
