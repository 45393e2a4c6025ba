"""Near-duplicate vectors by an inverted multi-index.

Each half of the unit vectors has a codebook of k centroids, fitted on a bounded sample (SAMPLE vectors);
pairs of centroids form a grid of k * k cells, and every vector lies in the cell of its nearest centroids.
A vector looks for links in the cells nearest to it, in the order of the multi-sequence traversal, as many
as it takes to find RECALL of made-up pairs whose cosine lies evenly between the threshold and 1; real
near-duplicates are closer than that, and a pair counts if either side finds it. Candidates are verified
in double precision. Each length has an index of its own; lengths with few vectors are compared in full.
Equal vectors collapse first. Crowded cells are split in chunks on both sides, and
links leave a task as counts and as a spanning forest, never as all pairs of a crowd.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.9
SAMPLE = 20_000
RECALL = 0.99
CELL = 512
CHUNK = 2048
MAX_CENTROIDS = 1024
#: Distinct vectors up to which a length, the most frequent excepted, is compared in full.
SMALL = 2048


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec): the components as bytes, null unless all are finite and one is not zero."""
    is_float = "float" in df.select(vector_col).dtypes[0][1]
    kind = "<f4" if is_float else "<f8"
    schema = pa.schema([("id", pa.int64()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1):
                x = v.values.to_numpy(zero_copy_only=False) if v.is_valid and v.values.null_count == 0 else np.empty(0)
                out.append((x + 0).astype(kind).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)  # -0 is 0
            yield common.batch({"id": b.column(0), "vec": out}, schema)

    common.ship(df.sparkSession)
    cast = F.col(vector_col).cast("array<float>" if is_float else "array<double>")
    return df.select(F.col(id_col).cast("long").alias("id"), cast.alias("v")).mapInArrow(run, "id long, vec binary")


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    r = np.random.default_rng(0)
    centroids = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        nearest = distances(x, centroids).argmin(1)
        n = np.bincount(nearest, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, nearest, x)
        centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
    return centroids


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * x @ centroids.T


def multi_sequence(first: np.ndarray, second: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The n cells with the smallest first[i] + second[j], nearest first."""
    a, b = first.argsort(), second.argsort()
    heap, seen, out = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < n:
        _, i, j = heapq.heappop(heap)
        out.append((int(a[i]), int(b[j])))
        for i2, j2 in ((i + 1, j), (i, j + 1)):
            if i2 < len(a) and j2 < len(b) and (i2, j2) not in seen:
                seen.add((i2, j2))
                heapq.heappush(heap, (first[a[i2]] + second[b[j2]], i2, j2))
    return out


class MultiIndex:
    def __init__(self, sample: np.ndarray, n: int, threshold: float = THRESHOLD, recall: float = RECALL):
        """sample: unit vectors; n: how many vectors the index will hold."""
        self.half = max(1, sample.shape[1] // 2)
        k = int(min(MAX_CENTROIDS, max(1, round((n / CELL) ** 0.5)), len(sample)))
        self.books = [kmeans(part, k) for part in (sample[:, : self.half], sample[:, self.half :])]
        self.k = k
        r = np.random.default_rng(1)
        x = sample[r.permutation(len(sample))[:2000]]
        cosine = r.uniform(threshold, 1, len(x))[:, None]
        noise = r.standard_normal(x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        y = cosine * x + np.sqrt(1 - cosine**2) * noise / np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        rank = np.minimum(self._ranks(x, y), self._ranks(y, x))
        self.probes = min(k * k, int(np.quantile(rank, recall, method="higher")) + 1)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many cells x visits before that of y."""
        (a, b), (ya, yb) = self.halves(x), self.halves(y)
        rows = np.arange(len(x))
        there = a[rows, ya.argmin(1)] + b[rows, yb.argmin(1)]
        return np.array([(a[i][:, None] + b[i][None, :] < there[i]).sum() for i in rows])

    def visit(self, x: np.ndarray) -> np.ndarray:
        """Cells in order of visit, the vector's own first; probes per row."""
        a, b = self.halves(x)
        return np.array([[i * self.k + j for i, j in multi_sequence(p, q, self.probes)] for p, q in zip(a, b)], np.int32).reshape(len(x), self.probes)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Indices of links that connect what all links a-b among n nodes connect, fewer than n."""
    label, used, left = np.arange(n), [], np.arange(len(a))
    while True:
        la, lb = label[a[left]], label[b[left]]
        left, low, high = left[la != lb], np.minimum(la, lb)[la != lb], np.maximum(la, lb)[la != lb]
        if not len(left):
            return np.concatenate(used) if used else left
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], np.diff(high[order]) != 0])]
        used.append(left[first])
        up = np.arange(n)
        up[high[first]] = low[first]
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def links(classes: DataFrame, index: MultiIndex, kind: str, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """classes: (rep, n, vec), vec of one length. Returns rows (id, other, n): other null: id has n more
    linked vectors; else a link that connectivity needs."""
    spark = classes.sparkSession
    common.ship(spark)
    book = spark.sparkContext.broadcast(index)
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("vec", pa.binary()), ("cells", pa.list_(pa.int32()))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(np.frombuffer(b"".join(b.column(2).to_pylist()), kind).reshape(b.num_rows, -1))
                cells = book.value.visit(x)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1]), pa.int32()), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[:2], b.column(2).cast(pa.binary()), flat], schema=schema)

    placed = common.stage(classes.select("rep", "n", "vec").mapInArrow(assign, "rep long, n long, vec binary, cells array<int>"), "cells")
    # at most k * k rows each
    held = dict(map(tuple, placed.groupBy(F.col("cells")[0]).count().collect()))
    asked = dict(map(tuple, placed.select(F.explode("cells").alias("c")).groupBy("c").count().collect()))
    in_chunks = spark.sparkContext.broadcast({c: -(-n // chunk) for c, n in held.items()})
    ask_chunks = spark.sparkContext.broadcast({c: -(-n // (8 * chunk)) for c, n in asked.items()})
    dealt = pa.schema([("place", pa.int64()), ("asks", pa.bool_()), ("rep", pa.int64()), ("n", pa.int64()), ("vec", pa.binary()), ("cells", pa.list_(pa.int32()))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, outer = in_chunks.value, ask_chunks.value
        for b in batches:
            rows, place, asks = [], [], []
            for i, (rep, cells) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist())):
                own, mix = cells[0], (rep * 0x9E3779B97F4A7C15 >> 20) & 0xFFFFFFFF
                for c in cells:
                    for k in range(inner.get(c, 0)):
                        rows.append(i)
                        asks.append(True)
                        place.append((c << 32) | (k << 16) | mix % outer[c])
                for j in range(outer[own]):
                    rows.append(i)
                    asks.append(False)
                    place.append((own << 32) | (mix % inner[own] << 16) | j)
            for i in range(0, len(rows), 20_000):
                part = b.take(pa.array(rows[i : i + 20_000], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(place[i : i + 20_000], pa.int64()), pa.array(asks[i : i + 20_000]), *part.columns], schema=dealt)

    out_schema = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])

    def matched(held: list[pa.RecordBatch], asking: pa.RecordBatch) -> pa.RecordBatch | None:
        mine = pa.Table.from_batches(held)
        rep, n = mine["rep"].to_numpy(), mine["n"].to_numpy()
        x = _unit(np.frombuffer(b"".join(mine["vec"].to_pylist()), kind).reshape(len(rep), -1))
        cells = np.array(mine["cells"].to_pylist(), np.int32)
        ids, others, counts = [], [], []
        for i in range(0, asking.num_rows, 256):
            a = asking.slice(i, 256)
            own, weight = a.column(2).to_numpy(), a.column(3).to_numpy()
            y = _unit(np.frombuffer(b"".join(a.column(4).to_pylist()), kind).reshape(len(own), -1))
            from_cell = np.array([c[0] for c in a.column(5).to_pylist()], np.int32)
            q, j = np.nonzero((y @ x.T >= threshold) & (own[:, None] != rep[None, :]))
            if not len(q):
                continue
            found = np.bincount(q, weights=n[j], minlength=len(own)).astype(np.int64)
            one_way = ~(cells[j] == from_cell[q][:, None]).any(1)  # j never visits q's cell, so q tells it
            told = np.bincount(j[one_way], weights=weight[q[one_way]], minlength=len(rep)).astype(np.int64)
            tree = forest(q, j + len(own), len(own) + len(rep))
            ids += [own[found > 0], rep[told > 0], own[q[tree]]]
            nothing = np.full(int((found > 0).sum() + (told > 0).sum()), common.NULL_ID)
            others += [nothing, rep[j[tree]]]
            counts += [found[found > 0], told[told > 0], np.zeros(len(tree), np.int64)]
        if not ids:
            return None
        other = np.concatenate(others)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(other, mask=other == common.NULL_ID), pa.array(np.concatenate(counts))], schema=out_schema)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            place, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (asks[1:] != asks[:-1]), [True]])) if len(place) else []
            for i, j in zip(edges[:-1], edges[1:]):
                if place[i] != now:
                    now, held = place[i], []
                if not asks[i]:
                    held.append(b.slice(i, j - i))
                elif held and (out := matched(held, b.slice(i, j - i))):
                    yield out

    spread = placed.mapInArrow(deal, "place long, asks boolean, rep long, n long, vec binary, cells array<int>")
    return spread.repartition(F.col("place")).sortWithinPartitions("place", "asks").mapInArrow(match, "id long, other long, n long")


def all_links(classes: DataFrame, kind: str, threshold: float = THRESHOLD) -> DataFrame:
    """links() of every pair of one length, for lengths of at most SMALL vectors."""
    common.ship(classes.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])

    def compared(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        rep, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        x = _unit(np.frombuffer(b"".join(r[2] for r in rows), kind).reshape(len(rows), -1))
        i, j = np.nonzero((x @ x.T >= threshold) & (rep[:, None] != rep[None, :]))
        more = np.bincount(i, weights=n[j], minlength=len(rows)).astype(np.int64)
        tree = forest(i, j, len(rows))
        told = np.flatnonzero(more)
        other = [*[None] * len(told), *rep[j[tree]].tolist()]
        return common.batch({"id": np.concatenate([rep[told], rep[i[tree]]]), "other": other, "n": np.concatenate([more[told], np.zeros(len(tree), np.int64)])}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and len(held[0][2]) != len(row[2]):
                    yield compared(held)
                    held = []
                held.append(row)
        if held:
            yield compared(held)

    return classes.select("rep", "n", "vec").repartition(F.length("vec")).sortWithinPartitions(F.length("vec")).mapInArrow(run, "id long, other long, n long")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept per row.

    Vectors that are null, empty, all zero or hold a null or non-finite component link with nothing, and
    those of different lengths not with each other. Rows that share an id are vectors of their own; a
    null id sorts first. An empty table gives no rows. Other columns are not read.
    """
    own = common.stage(vectors(df, id_col, vector_col).withColumn("nid", F.coalesce("id", F.lit(common.NULL_ID))), "vectors")
    kind = "<f4" if "float" in df.select(vector_col).dtypes[0][1] else "<f8"
    classes = own.filter("vec IS NOT NULL").groupBy("vec").agg(F.min("nid").alias("rep"), F.count(F.lit(1)).alias("n"))
    # ids repeat where rows share one; a class then goes by the first id and its vector's hash
    classes = common.stage(classes.withColumn("key", F.xxhash64("rep", "vec")), "vecclasses")
    sizes = classes.groupBy(F.length("vec").alias("size")).count().filter("count > 1").orderBy(F.desc("count"), "size").collect()
    back = F.when(F.col("component") != common.NULL_ID, F.col("component"))
    named = classes.select("vec", "n", "rep", F.col("rep").alias("component"), (F.col("n") - 1).alias("n_links"))
    if sizes:
        ready, parts = classes.select(F.col("key").alias("rep"), "n", "vec"), []
        large = [(size, n) for i, (size, n) in enumerate(sizes) if i == 0 or n > SMALL]
        for size, n in large:
            own_size = F.length("vec") == size
            sample = classes.filter(own_size).orderBy(F.xxhash64("vec")).limit(SAMPLE).select("vec").collect()
            index = MultiIndex(_unit(np.frombuffer(b"".join(bytes(r[0]) for r in sample), kind).reshape(len(sample), -1)), n, threshold)
            parts.append(common.stage(links(ready.filter(own_size), index, kind, threshold, chunk), "veclinks"))
        if len(sizes) > len(large):
            few = ~F.length("vec").isin([size for size, _ in large])
            parts.append(common.stage(all_links(ready.filter(few), kind, threshold), "veclinks"))
        found = functools.reduce(DataFrame.union, parts)
        more = found.filter("other IS NULL").groupBy(F.col("id").alias("key")).agg(F.sum("n").alias("more"))
        roots = common.components(found.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "key")
        joined = classes.join(more, "key", "left").join(roots, "key", "left")
        joined = joined.withColumn("root", F.coalesce("root", "key"))
        lowest = joined.groupBy("root").agg(F.min("rep").alias("component"))
        named = joined.join(lowest, "root").select("vec", "n", "rep", "component", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    out = own.join(named.select("vec", "component", "n_links"), "vec", "left").withColumn("component", F.coalesce("component", "nid"))
    out = out.select("nid", F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), back.alias("component_id"), (F.col("component") == F.col("nid")).alias("kept"))
    return out.drop("nid")


ORACLE = """
WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.9),
c AS (WITH RECURSIVE r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.root AS component_id, c.root = e.vec_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
