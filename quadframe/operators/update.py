"""SPARQL Update: every operation reads one snapshot and yields the next as a staged table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import instantiate
from ..functions.values import number, time
from ..plans.algebra import Query, Unit, Update
from ..plans.compiler import Compiler
from ..plans.parser import parse_update
from ..sources.dataset import QUADS, Dataset, QuadTable
from ..staging import stage
from ..terms import BNode, Var
from .timeline import bulk_delete, compact

#: Bound in a WHERE clause, this variable is the time of that row's changes: integer milliseconds or xsd:dateTime.
TIMESTAMP = "QUADFRAME_TIMESTAMP"


class _All:
    def __contains__(self, x: object) -> bool:
        return True


class Updater:
    def __init__(self, dataset: Dataset, datasets: dict[str, Dataset] | None = None, loader: Callable[[str], DataFrame] | None = None, fork: int = 0):
        self.data, self.datasets, self.loader, self.fork = dataset, datasets or {}, loader, fork
        self.spark = dataset.spark

    def quads(self, data: Dataset | None = None) -> DataFrame:
        data = data or self.data
        return data.quads.df if data.quads else self.spark.createDataFrame([], QUADS)

    def run(self, text: str) -> Dataset:
        """The dataset after all operations of text; the one given stays as it is."""
        if not self.data.writable:
            raise PermissionError("the dataset is read-only")
        for u in parse_update(text, prefixes=self.data.namespaces):
            gone, new, rest = self.delta(u)
            df = self.quads() if rest is None else rest
            df = self.without(df, gone)
            df = df.unionByName(new).distinct() if new is not None else df
            self.keep(df)
        return self.data

    def keep(self, df: DataFrame) -> Dataset:
        df = stage(df.select("s", "p", "o", "g"), "quads")
        self.data = replace(self.data, quads=QuadTable(df, not df.filter("g IS NOT NULL").isEmpty()))
        return self.data

    def add(self, quads: DataFrame) -> Dataset:
        """The dataset with more statements (s, p, o, g)."""
        if not self.data.writable:
            raise PermissionError("the dataset is read-only")
        return self.keep(self.quads().unionByName(quads.select("s", "p", "o", "g")).distinct())

    def remove(self, **pattern) -> Dataset:
        """The dataset without statements of a pattern (s, p, o, graphs), each from its own graph."""
        if not self.data.writable:
            raise PermissionError("the dataset is read-only")
        return self.keep(bulk_delete(self.quads(), **pattern))

    def without(self, df: DataFrame, gone: DataFrame | None) -> DataFrame:
        """A deletion without a graph removes the statement from every graph."""
        if gone is None:
            return df
        gone = stage(gone.distinct(), "gone")
        every = gone.filter("g IS NULL").select("s", "p", "o")
        own = gone.filter("g IS NOT NULL")
        return df.join(every, ["s", "p", "o"], "left_anti").join(own, ["s", "p", "o", "g"], "left_anti").select("s", "p", "o", "g")

    def where(self, u: Update):
        q = Query("SELECT", u.where or Unit(), default_graphs=u.using, named_graphs=u.using_named or [], has_dataset=bool(u.using or u.using_named))
        c = Compiler(self.spark, self.data, self.datasets, q, self.fork)
        if u.using_named is None:
            c.named = _All()
        return c.compile(q.root)

    def delta(self, u: Update) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
        """(quads to delete, quads to insert, what replaces the present quads before that)."""
        g = F.col("g")
        if u.kind == "DATA":
            unit = Compiler(self.spark, self.data).unit()
            kept = [tuple(t if not isinstance(t, BNode) else BNode(t.label) for t in q) for q in u.insert]
            return (instantiate(unit, u.delete) if u.delete else None), (instantiate(unit, kept) if kept else None), None
        if u.kind == "MODIFY":
            rel = self.where(u)
            return (instantiate(rel, u.delete) if u.delete else None), (instantiate(rel, u.insert) if u.insert else None), None
        df = self.quads()
        if u.kind in ("CLEAR", "DROP"):
            keep = {"ALL": F.lit(False), "DEFAULT": g.isNotNull(), "NAMED": g.isNull()}.get(u.target)
            return None, None, df.filter(keep if keep is not None else ~g.eqNullSafe(f"<{u.target}>"))
        if u.kind == "CREATE":
            return None, None, None
        if u.kind == "LOAD":
            if self.loader is None:
                raise ValueError("no loader for LOAD")
            loaded = self.loader(u.source)
            return None, loaded.withColumn("g", F.lit(f"<{u.target}>")) if u.target else loaded, None
        if u.source == u.target:
            return None, None, None
        name = lambda x: None if x == "DEFAULT" else f"<{x}>"
        moved = df.filter(g.eqNullSafe(F.lit(name(u.source)))).withColumn("g", F.lit(name(u.target)).cast("string"))
        rest = df
        if u.kind in ("COPY", "MOVE"):
            rest = rest.filter(~g.eqNullSafe(F.lit(name(u.target))))
        if u.kind == "MOVE":
            rest = rest.filter(~g.eqNullSafe(F.lit(name(u.source))))
        return None, moved, rest

    def events(self, text: str, now: int, operation: int | None = None) -> DataFrame:
        """Change events of an update's INSERT/DELETE operations on the present snapshot, timed row by
        row by ?QUADFRAME_TIMESTAMP where it is bound, else at `now`."""
        out = None
        for k, u in enumerate(parse_update(text, prefixes=self.data.namespaces)):
            if operation is not None and k != operation:
                continue
            rel = self.where(u) if u.kind == "MODIFY" else Compiler(self.spark, self.data).unit()
            ts = F.lit(now).cast("long")
            if TIMESTAMP in rel.lanes:
                v = rel.lanes[TIMESTAMP].value()
                when = time(v)
                ms = F.unix_millis(when.cast("timestamp")) if when is not None else F.lit(None).cast("long")
                n = number(v)
                ts = F.coalesce(n.cast("long") if n is not None else F.lit(None), ms, ts)
            rel.df = rel.df.withColumn("_ts", ts)
            for op, template in (("delete", u.delete), ("insert", u.insert)):
                if template:
                    own = _timed(rel, template).withColumn("op", F.lit(op))
                    out = own if out is None else out.unionByName(own)
        return out if out is not None else self.spark.createDataFrame([], QUADS + ", ts long, op string")


def _timed(rel, template: list[tuple]) -> DataFrame:
    parts = []
    for s, p, o, g in template:
        cols = [x.term() if isinstance(t, Var) and (x := rel.lanes.get(t.name)) else F.lit(None if t is None or isinstance(t, Var) else t.n3()) for t in (s, p, o, g)]
        parts.append(rel.df.select(*[c.cast("string").alias(n) for c, n in zip(cols, "spog")], F.col("_ts").alias("ts")).filter("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def bulk_update(dataset: Dataset, files: list[str], now: int = 0, forks: int = 1) -> Dataset:
    """Stage k runs the k-th operation of every text on one snapshot; all changes take effect together."""
    texts = [parse_update(t, prefixes=dataset.namespaces) for t in files]
    for k in range(max(map(len, texts), default=0)):
        updater = Updater(dataset)
        events = updater.quads().select("s", "p", "o", "g", F.lit(now - 1).cast("long").alias("ts"), F.lit("insert").alias("op"))
        for text, ops in zip(files, texts):
            if k < len(ops):
                for i in range(forks):
                    own = Updater(dataset, fork=i).events(text, now, k)
                    everywhere = own.filter("op = 'delete' AND g IS NULL").drop("g").join(updater.quads(), ["s", "p", "o"]).select("s", "p", "o", "g", "ts", "op")
                    events = events.unionByName(own.filter("NOT (op = 'delete' AND g IS NULL)")).unionByName(everywhere)
        df = stage(compact(events), "quads")
        dataset = replace(dataset, quads=QuadTable(df, not df.filter("g IS NOT NULL").isEmpty()))
    return dataset
