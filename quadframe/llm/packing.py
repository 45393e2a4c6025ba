"""Sum-of-squares packing of tokenised documents into fixed-length training sequences.

Only the histogram of piece lengths (at most `capacity` numbers) reaches the driver. There the pieces of each
length are placed in at most GROUPS equal groups (piece by piece where there are no more), in random order.
Of all open gaps and a new sequence, a group takes the one after which the sum over gaps of (open sequences
with that gap) squared grows least per piece; what does not fit there is placed on. So the plan has at most
GROUPS * `capacity` groups for any input, and where the pieces lie in it is a few numbers for each. Its
slots are dealt out to pieces by their rank among pieces of equal length, which every task knows from counts
per task and length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Groups in which the pieces of one length are placed; more give fewer sequences and a longer plan.
GROUPS = 32


def pieces(docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the encoded documents; `task` and `nth` number the pieces of one length within a task."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, task = tokens.encoder(vocabulary), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            at = 0
            for ids, ends in encoder.encode(b.column(1), end_id):
                begin = np.concatenate([[0], ends[:-1]])
                n_pieces = -(-(ends - begin) // capacity)
                owner = np.repeat(np.arange(len(ends)), n_pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(capacity, (ends - begin)[owner] - start)
                low = begin[owner] + start
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * i : 4 * (i + n)]) for i, n in zip(low.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                first = np.flatnonzero(np.diff(length[order], prepend=-1))
                nth = np.empty(len(order), np.int64)
                nth[order] = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
                nth += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                doc = b.column(0).slice(at, len(ends)).take(pa.array(owner))
                at += len(ends)
                yield pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(np.full(len(owner), task, np.int32)), pa.array(nth)], schema=schema)

    common.ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(common.lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, seed: int = 1) -> np.ndarray:
    """Slots as rows (length, base, copies, offset): `copies` pieces of that length lie at `offset` in
    sequences base .. base + copies - 1. Every piece has one slot; no sequence holds over `capacity`."""
    h = np.zeros(capacity + 1, np.int64)
    for n, count in histogram.items():
        h[n] = count
    slots = [(capacity, 0, int(h[capacity]), 0)] if h[capacity] else []
    base, h[capacity] = int(h[capacity]), 0
    parts = np.minimum(h, groups)
    length = np.repeat(np.arange(capacity + 1), parts)
    nth = np.arange(len(length)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = (nth + 1) * h[length] // parts[length] - nth * h[length] // parts[length]
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # runs (base, copies) of open sequences by what is free
    open_now = np.zeros(capacity + 1, np.int64)
    order = np.random.default_rng(seed).permutation(len(length))
    for n, rest in zip(length[order].tolist(), size[order].tolist()):
        while rest:
            there = np.minimum(open_now[n:], rest)  # as many as each gap takes; entry i leaves a gap of i
            growth = 2.0 * (open_now[: capacity + 1 - n] - open_now[n:] + there)
            growth[0] = there[0] - 2.0 * open_now[n]
            growth[there == 0] = np.inf
            growth[capacity - n] = 2.0 * open_now[capacity - n] + rest
            left = int(growth.argmin())
            gap = left + n
            took = []
            if gap == capacity:
                took.append((base, rest))
                base, placed = base + rest, rest
            else:
                placed = want = int(there[left])
                while want:
                    at, copies = gaps[gap].pop()
                    if copies > want:
                        gaps[gap].append((at, copies - want))
                    took.append((at + max(0, copies - want), min(copies, want)))
                    want -= took[-1][1]
                open_now[gap] -= placed
            slots += [(n, at, copies, capacity - gap) for at, copies in took]
            if left:
                gaps[left] += took
                open_now[left] += placed
            rest -= placed
    return np.array(slots, np.int64).reshape(-1, 4)


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", groups: int = GROUPS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; repeated rows are packed each; a null doc_id is kept as
    null; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    own = common.stage(pieces(docs, vocabulary or tokens.public_path(VOCABULARY), end_id, capacity, id_col, text_col), "pieces")
    per_task = common.stage(own.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    slots = plan(dict(map(tuple, per_task.groupBy("length").agg(F.sum("n")).collect())), capacity, groups)
    slots = slots[np.argsort(slots[:, 0], kind="stable")]
    cumulative = np.cumsum(slots[:, 2]) - slots[:, 2]
    first = np.searchsorted(slots[:, 0], slots[:, 0])
    within = cumulative - cumulative[first] if len(slots) else cumulative
    table = spark.sparkContext.broadcast((slots, within, (slots[:, 0] << 44) + within))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = own.join(per_task.select("length", "task", before.alias("before")), ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((n, pa.int64()) for n in (*names[2:], "sequence_id", "offset"))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, within, keys = table.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(slots[at, 1] + rank - within[at]), pa.array(slots[at, 3])], schema=schema)

    return ranked.select(*names, "rank").mapInArrow(common.lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
