"""Transitive property paths: set semantics, safe on cycles.

Few edges (DRIVER_EDGES at most, which bounds what is collected) are searched breadth first on the driver
as long as the answer stays within DRIVER_PAIRS; everything else by doubling on the cluster, with staged
tables per round, so that a path of length n takes about log2(n) rounds. A round joins all pairs known with those
exactly 2^i edges apart, so a pair with one path is made once, and only new pairs are written.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import replace
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import V
from ..plans.algebra import Path, Pattern
from ..plans.lanes import Lane, Rel, alike, fresh, is_constant, union
from ..staging import stage, unstage
from ..terms import Var

if TYPE_CHECKING:
    from ..plans.compiler import Compiler

DRIVER_EDGES = 20_000
DRIVER_PAIRS = 500_000
#: Known pairs per partition where pairs are made distinct.
ROWS_DEALT = 500_000


def _search(edges: list[tuple], starts: list | None) -> list[tuple] | None:
    """Pairs (x, y) with y reached from x by one edge or more; None if there are too many."""
    after = defaultdict(list)
    for a, b in edges:
        after[a].append(b)
    out = []
    for x in starts if starts is not None else list(after):
        seen, front = set(), [x]
        while front:
            nxt = []
            for y in front:
                for z in after.get(y, ()):
                    if z not in seen:
                        seen.add(z)
                        nxt.append(z)
            front = nxt
        out += [(x, y) for y in seen]
        if len(out) > DRIVER_PAIRS:
            return None
    return out


def _doubled(edges: DataFrame, start: object) -> DataFrame:
    """All pairs by path doubling; from a given start, the frontier search that follows only new nodes."""
    if start is not None:
        found = stage(edges.filter(F.col("a") == start).select("a", "b").distinct(), "path")
        new = found
        while not new.isEmpty():
            step = new.select("a", F.col("b").alias("via")).join(edges.select(F.col("a").alias("via"), "b"), "via").select("a", "b").distinct()
            new = stage(step.join(found, ["a", "b"], "left_anti"), "path")
            found = stage(found.union(new), "path")
        return found
    # of the pairs, `found` has those by 1 to 2^i - 1 edges, each once, and `step` those by 2^i edges
    step, found = stage(edges.distinct(), "path"), []
    new, n, n_found = step, 0, 0
    while True:
        n_new = new.count()
        if not n_new:
            return union_all(found or [new])
        found.append(new)
        n, n_found = max(n, step.count()), n_found + n_new
        deals = 1 + (n + n_found) // ROWS_DEALT
        twice = stage(_deal(_joined(step, step), deals).distinct(), "path")
        if twice.isEmpty():
            return union_all(found)
        reach, step, passed = union_all(found), twice, step
        longer = _deal(step.union(_joined(reach, step)), deals).distinct()
        new = stage(longer.join(_deal(reach, deals), ["a", "b"], "left_anti"), "path")
        if passed is not found[0]:
            unstage(passed)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("a", F.col("b").alias("via")).join(right.select(F.col("a").alias("via"), "b"), "via").select("a", "b")


def _deal(pairs: DataFrame, n: int) -> DataFrame:
    """By both ends and before any aggregation, so that no task holds more than its share of distinct pairs."""
    return pairs.repartition(n, "a", "b")


def closure(c: Compiler, node: Path) -> Rel:
    edges = c.compile(node.step)
    edges = Rel(edges.df.distinct(), edges.lanes) if node.high == 1 else edges
    s, o = edges.lanes[node.start.name], edges.lanes[node.end.name]
    if alike(s, o):
        kind, prefix, pairs = s.kind, s.prefix, edges.df.select(F.col(s.col).alias("a"), F.col(o.col).alias("b"))
    else:
        kind, prefix, pairs = "term", None, edges.df.select(s.term().alias("a"), o.term().alias("b"))
    as_lane = lambda col: Lane(kind, col, prefix)
    dtype = dict(pairs.dtypes)["a"]
    start = node.s if not isinstance(node.s, Var) else None
    backward = start is None and not isinstance(node.o, Var)
    if backward:
        pairs = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
        start = node.o
    if node.high == 1:
        reach = pairs.distinct()
    else:
        pairs = stage(pairs.distinct(), "edges")
        few = pairs.limit(DRIVER_EDGES + 1).collect()
        key = None
        if start is not None:
            probe = pairs.filter(is_constant(as_lane("a"), start, dtype)).select("a").limit(1).collect()
            key = probe[0][0] if probe else None
        if start is not None and key is None:
            reach = pairs.limit(0)
        else:
            found = _search([tuple(r) for r in few], [key] if key is not None else None) if len(few) <= DRIVER_EDGES else None
            reach = c.spark.createDataFrame(found, pairs.schema) if found is not None else _doubled(pairs, key)
    if backward:
        reach = reach.select(F.col("b").alias("a"), F.col("a").alias("b"))
    a, b = fresh(), fresh()
    rel = Rel(reach.select(F.col("a").alias(a), F.col("b").alias(b)), {".a": as_lane(a), ".b": as_lane(b)})
    if node.low == 0:
        rel = union([rel, _same(c, node)])
        rel = Rel(rel.df.distinct(), {k: replace(v, null=False) for k, v in rel.lanes.items()})
    df, lanes = rel.df, {}
    types = dict(df.dtypes)
    for t, own in ((node.s, rel.lanes[".a"]), (node.o, rel.lanes[".b"])):
        if not isinstance(t, Var):
            df = df.filter(is_constant(own, t, types[own.col]))
        elif t.name in lanes:
            df = df.filter(F.col(lanes[t.name].col) == F.col(own.col))
        else:
            lanes[t.name] = own
    return Rel(df, lanes)


def _same(c: Compiler, node: Path) -> Rel:
    """Zero steps: every node of the graph to itself, or the given ends if they are equal."""
    ends = [t for t in (node.s, node.o) if not isinstance(t, Var)]
    if ends:
        rel = c.unit()
        if len(ends) == 2 and ends[0] != ends[1]:
            return c.nothing({".a", ".b"})
        rel = rel.with_value(".a", V("term", F.lit(ends[0].n3())), null=False)
    else:
        every = c.compile(Pattern(Var(".s"), Var(".p"), Var(".o"), node.g))
        nodes = union([Rel(every.df, {".a": every.lanes[".s"]}), Rel(every.df, {".a": every.lanes[".o"]})])
        rel = Rel(nodes.df.distinct(), nodes.lanes)
    return Rel(rel.df, {".a": rel.lanes[".a"], ".b": rel.lanes[".a"]})
