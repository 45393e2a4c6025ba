"""Timestamped change events (s, p, o, g, ts, op): the last writer wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..terms import IRI, BNode, Literal

EVENTS = "s string, p string, o string, g string, ts long, op string"


#: At one time, an insert beats a delete, and a deletion of what was inserted then beats both.
DELETE, INSERT, UNDO = 0, 1, 2


def order_of(ts: str = "ts", op: str = "op", rank: Column | None = None) -> Column:
    """Place in the order of operations: the time, and at one time the rank."""
    own = F.when(F.col(op) == "insert", INSERT).otherwise(DELETE)
    return F.struct(F.col(ts), own if rank is None else F.coalesce(rank, own))


def latest(events: DataFrame, keys: list[str]) -> DataFrame:
    """The last operation per key, by partial aggregation: no key's events meet unreduced."""
    rank = order_of(rank=F.col("rank").cast("int") if "rank" in events.columns else None)
    return events.groupBy(*keys).agg(F.max_by("op", rank).alias("op"), F.max("ts").alias("ts"))


def compact(events: DataFrame) -> DataFrame:
    """The quads that exist after all events."""
    return latest(events, ["s", "p", "o", "g"]).filter("op = 'insert'").select("s", "p", "o", "g")


def matching(df: DataFrame, s: IRI | BNode | None = None, p: IRI | None = None, o: IRI | BNode | Literal | None = None, graphs: list | None = None) -> Column:
    """Condition of a pattern and a list of graphs, None in it meaning no graph."""
    cond = F.lit(True)
    for name, t in (("s", s), ("p", p), ("o", o)):
        if t is not None:
            cond = cond & (F.col(name) == t.n3())
    if graphs:
        named = [f"<{g}>" for g in graphs if g is not None]
        cond = cond & ((F.col("g").isNull() & F.lit(None in graphs)) | F.coalesce(F.col("g").isin(*named), F.lit(False)))
    return cond


def bulk_delete(quads: DataFrame, **pattern) -> DataFrame:
    return quads.filter(~matching(quads, **pattern))


def delete_events(events: DataFrame, **pattern) -> DataFrame:
    """Deletions at the times of the inserts that they hit: they win over these, and a later insert over
    them. `rank`, where it is not null, is the operation's place among those of its time."""
    hit = events.filter((F.col("op") == "insert") & matching(events, **pattern))
    hit = hit.groupBy("s", "p", "o", "g").agg(F.max("ts").alias("ts"))
    gone = hit.select("s", "p", "o", "g", "ts", F.lit("delete").alias("op"), F.lit(UNDO).alias("rank"))
    return events.withColumn("rank", F.col("rank").cast("int") if "rank" in events.columns else F.lit(None).cast("int")).unionByName(gone)
