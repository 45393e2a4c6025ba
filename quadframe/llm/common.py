"""Shared plumbing: shipped code, staged tables, hot-key detection and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import staging
from ..ship import ship
from ..staging import shared_dir, unstage

__all__ = ["batch", "bloom", "byte_list", "components", "hot_keys", "in_bloom", "lean", "new_path", "plain_names", "popcount", "shared_dir", "ship", "spanning_links", "stage", "unstage", "unused"]

#: Stands in for a null id inside an operator: sorts before every real id.
NULL_ID = -(1 << 63)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts lineage and survives lost executors."""
    return staging.stage(df, f"llm-{name}")


def hot_keys(df: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, chunks) of the keys with more than `limit` rows: into how many chunks of at most that many to
    split each. Counts are summed where the rows lie, and nothing reaches the driver."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    return counts.select(key, F.ceil(F.col("n") / limit).cast("int").alias("chunks"))


def plain_names(df: DataFrame) -> DataFrame:
    """df with its columns called by number, as mapInArrow() cannot take a name with a dot."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df has not."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


#: Of mallopt(): larger blocks get memory of their own, which goes back when they are freed.
_M_MMAP_THRESHOLD, _OWN = -3, 4 << 20


def _release() -> None:
    """Give freed memory back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(_M_MMAP_THRESHOLD, _OWN)
        libc.malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow(), before and after which its worker gives back what is free: workers serve many
    tasks, and what one stage freed would else lie beside the next one's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release()
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def byte_list(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: pairs of longs (self pairs and nulls are ignored). Returns (node, root), root being the
    smallest node reachable; nodes without an edge are absent. Each round is staged, so lineage stays
    short and a lost executor costs one round. A hot hub is split by the aggregation's map side.
    """
    spark = edges.sparkSession
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = stage(e, "edges")
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour points at the smallest neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter("u != v").distinct(), "star")
        # small star: every smaller neighbour, and the node itself, point at the smallest neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        after = stage(small, "star")
        mark = tuple(after.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
        unstage(large, e)
        e = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    return out


_SEGMENT = 20


def bloom(hashes: DataFrame, n: int, most_bits: int) -> tuple[int, np.ndarray]:
    """(bits, bitmap) of a Bloom filter of the n longs in column h, with two bits each and most_bits at
    most; it is built in segments on the cluster."""
    bits = min(most_bits, max(1 << _SEGMENT, 1 << (12 * n).bit_length()))
    places = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(bits - 1), F.shiftright("h", 29).bitwiseAND(bits - 1))).alias("bit"))
    schema = pa.schema([("segment", pa.int64()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            bit = b.column(0).to_numpy()
            segment = bit >> _SEGMENT
            for s in np.unique(segment).tolist():
                own.setdefault(s, np.zeros(1 << _SEGMENT, bool))[bit[segment == s] & ((1 << _SEGMENT) - 1)] = True
        if own:
            yield batch({"segment": list(own), "bits": [np.packbits(v, bitorder="little").tobytes() for v in own.values()]}, schema)

    filled = np.zeros(bits // 8, np.uint8)
    for s, packed in places.repartition(F.shiftright("bit", _SEGMENT)).mapInArrow(run, "segment long, bits binary").collect():
        filled[s << (_SEGMENT - 3) : (s + 1) << (_SEGMENT - 3)] = np.frombuffer(packed, np.uint8)
    return bits, filled


def in_bloom(h: np.ndarray, bits: int, filled: np.ndarray) -> np.ndarray:
    bit = np.stack([h & np.uint64(bits - 1), (h >> np.uint64(29)) & np.uint64(bits - 1)]).astype(np.int64)
    return ((filled[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).all(0)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def spanning_links(close, n: int) -> list[tuple[int, int]]:
    """A forest of links among n items that connects all that are linked: close(i, others) -> mask."""
    rest, out = np.arange(n), []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            hit = close(i, rest)
            if hit.any():
                found = rest[hit]
                out += [(i, int(j)) for j in found]
                front += found.tolist()
                rest = rest[~hit]
    return out
