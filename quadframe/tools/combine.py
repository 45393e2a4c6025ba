"""Sums of equal rows ahead of a shuffle, and how many partitions a shuffle gets, so that a task's memory stays small."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..ship import ship

#: Rows added up at once by a worker.
HELD = 1 << 17
#: A partition per so many bytes, by Spark's estimate of (packed) tables. With more than 200 partitions
#: tasks would hold what they write (spark.shuffle.sort.bypassMergeThreshold).
SHARE, MOST = 1 << 20, 200


def shares(df: DataFrame) -> int:
    """Partitions to deal df to; adaptive execution leaves a number that is given as it is."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    unknown = size >= 1 << 50
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if unknown else int(min(MOST, 1 + size // SHARE))


def pre_summed(df: DataFrame, schema: str, tables: Callable[[pa.Table], list[pa.Table]] | None = None) -> DataFrame:
    """Rows of df, or of the tables made of them, added up where all but schema's last column is equal: not whole
    sums, but a hot key's rows are few afterwards. A worker holds HELD rows, where Spark's partial sums hold a task's keys."""
    ship(df.sparkSession)
    *keys, n = names = [x.split()[0] for x in schema.split(", ")]

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        for t in tables(whole) if tables else [whole]:
            done = t.group_by(keys, use_threads=False).aggregate([(n, "sum")])
            yield from done.select([*keys, f"{n}_sum"]).rename_columns(names).to_batches(max_chunksize=1 << 14)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= HELD:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return df.mapInArrow(run, schema)
