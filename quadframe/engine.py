"""Entry point: a session's datasets and the queries on them."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import t_is
from .plans.algebra import External, Join, Query, substituted
from .plans.cardinality import Statistics
from .plans.compiler import Compiler, output
from .plans.lanes import Rel
from .plans.parser import parse_query
from .sources.dataset import Dataset
from .terms import BNode, Var


class Engine:
    def __init__(self, spark: SparkSession, dataset: Dataset, datasets: dict[str, Dataset] | None = None, stats: Statistics | None = None):
        self.spark, self.dataset, self.datasets, self.stats = spark, dataset, datasets or {}, stats

    def parse(self, text: str, **options) -> Query:
        return parse_query(text, prefixes=self.dataset.namespaces, **options)

    def compiler(self, q: Query | None, fork: int = 0) -> Compiler:
        return Compiler(self.spark, self.dataset, self.datasets, q, fork, self.stats)

    def query(self, text: str | Query, as_terms: bool = False, fork: int = 0, as_text: bool = False, bindings: DataFrame | None = None) -> DataFrame:
        """SELECT: a column per variable; CONSTRUCT and DESCRIBE: s, p, o; ASK: one boolean. bindings: rows
        that the WHERE clause is joined with, columns named as variables (strings are N-Triples text)."""
        q = self.parse(text) if isinstance(text, str) else text
        if bindings is not None:
            q.root = substituted(q.root, q.where, Join(External(bindings), q.where))
        c = self.compiler(q, fork)
        if q.form == "DESCRIBE":
            return self._describe(q, c)
        rel = c.compile(q.root)
        if q.form == "SELECT":
            return output(rel, as_terms, as_text)
        if q.form == "ASK":
            return rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))
        return instantiate(rel, q.template).select("s", "p", "o").distinct()

    def rows(self, text: str | Query, timeout: float | None = None, **options) -> list:
        """Collected rows; after `timeout` seconds the query's jobs are cancelled and TimeoutError is raised."""
        if timeout is None:
            return self.query(text, **options).collect()
        sc, group, late = self.spark.sparkContext, f"quadframe-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(timeout, stop)
        before = sc.getLocalProperty("spark.jobGroup.id")
        sc.setJobGroup(group, "query with a time limit", True)
        timer.start()
        try:
            return self.query(text, **options).collect()
        except Exception as fault:
            if late.is_set():
                raise TimeoutError(f"the query took more than {timeout} s") from fault
            raise
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", before)

    def ask(self, text: str) -> bool:
        return bool(self.query(text).first()[0])

    def _describe(self, q: Query, c: Compiler) -> DataFrame:
        """Statements with a resource as subject or object, and those of blank nodes they lead to."""
        rel = c.compile(q.root)
        found = []
        for t in q.described:
            if isinstance(t, Var):
                if t.name in rel.lanes:
                    found.append(rel.df.select(rel.lanes[t.name].term().alias("x")))
            else:
                found.append(self.spark.range(1).select(F.lit(t.n3()).alias("x")))
        every = self.dataset.all_quads().select("s", "p", "o").distinct()
        if not found:
            return every.limit(0)
        wanted = found[0]
        for f in found[1:]:
            wanted = wanted.union(f)
        wanted = wanted.filter("x IS NOT NULL").distinct()
        out = every.join(wanted, F.col("s") == F.col("x"), "left_semi").union(every.join(wanted, F.col("o") == F.col("x"), "left_semi")).distinct()
        if self.dataset.quads is None:
            return out
        while True:
            nodes = out.select(F.explode(F.array("s", "o")).alias("x")).filter(t_is(F.col("x"), "_")).distinct()
            more = out.union(every.join(nodes, F.col("s") == F.col("x"), "left_semi")).distinct()
            if more.count() == out.count():
                return out
            out = more


def instantiate(rel: Rel, template: list[tuple]) -> DataFrame:
    """Quads (s, p, o, g) of a template for each row; invalid and partly unbound ones are left out. A
    blank node of the template is one node per distinct solution."""
    row = F.sha1(F.concat_ws("|", *[F.coalesce(x.term(), F.lit("")) for x in rel.lanes.values()])) if rel.lanes else F.lit("0")

    def cell(t):
        if t is None:
            return F.lit(None).cast("string")
        if isinstance(t, Var):
            return rel.lanes[t.name].term() if t.name in rel.lanes else F.lit(None).cast("string")
        if isinstance(t, BNode):
            return F.concat(F.lit(f"_:{t.label}x"), row)
        return F.lit(t.n3())

    parts = [F.struct(cell(s).alias("s"), cell(p).alias("p"), cell(o).alias("o"), cell(g).alias("g"), F.lit(g is not None).alias("named")) for s, p, o, g in template]
    if not parts:
        return rel.df.sparkSession.createDataFrame([], "s string, p string, o string, g string")
    quads = rel.df.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    good = F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & ~t_is(F.col("s"), '"') & t_is(F.col("p"), "<") & (~F.col("named") | F.coalesce(t_is(F.col("g"), "<"), F.lit(False)))
    return quads.filter(good).select("s", "p", "o", "g")
