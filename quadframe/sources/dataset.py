"""Datasets: tables of quads, and ordinary tables mapped to triples without copying them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..terms import RDF, BNode, IRI, Literal

QUADS = "s string, p string, o string, g string"
_KINDS = {"string": "string", "bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "double", "float": "float", "boolean": "boolean", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "date": "date"}


@dataclass
class Column:
    """Where a predicate's objects lie: a column, its kind, and for keys of another table its IRI prefix."""

    name: str
    kind: str
    prefix: str | None = None


@dataclass
class MappedTable:
    """A row is the subject `prefix + key`; each column in `columns` is a predicate of it."""

    df: DataFrame
    prefix: str
    key: str
    columns: dict[str, Column]
    cls: str | None = None
    graph: str | None = None

    @staticmethod
    def of(df: DataFrame, prefix: str, key: str, predicates: str, refs: dict[str, str] | None = None, cls: str | None = None, graph: str | None = None) -> MappedTable:
        """Every column as predicate `predicates + name`; refs: columns that hold keys, with their prefix."""
        refs, columns = refs or {}, {}
        for name, dtype in df.dtypes:
            kind = "decimal" if dtype.startswith("decimal") else _KINDS.get(dtype)
            if name in refs:
                columns[predicates + name] = Column(name, "key", refs[name])
            elif kind:
                columns[predicates + name] = Column(name, kind)
        return MappedTable(df, prefix, key, columns, cls, graph)


@dataclass
class QuadTable:
    """df: s, p, o, g as N-Triples text; g null is the default graph."""

    df: DataFrame
    has_graphs: bool = True


@dataclass
class Dataset:
    spark: SparkSession
    mapped: list[MappedTable] = field(default_factory=list)
    quads: QuadTable | None = None
    namespaces: dict[str, str] = field(default_factory=dict)
    writable: bool = True

    @staticmethod
    def from_quads(spark: SparkSession, rows: Iterable[tuple]) -> Dataset:
        """rows: (s, p, o) or (s, p, o, g) of terms."""
        text = [tuple(None if t is None else t.n3() for t in (*r, None)[:4]) for r in rows]
        return Dataset(spark, quads=QuadTable(spark.createDataFrame(text, QUADS), any(r[3] for r in text)))

    def all_quads(self) -> DataFrame:
        """Every statement as s, p, o, g text; mapped tables are unpivoted in one pass each."""
        from ..plans.lanes import Lane

        parts = [self.quads.df.select("s", "p", "o", "g")] if self.quads else []
        for t in self.mapped:
            subject = Lane("key", t.key, t.prefix).term()
            cells = [F.struct(F.lit(f"<{p}>").alias("p"), Lane(c.kind, c.name, c.prefix).term().alias("o")) for p, c in t.columns.items()]
            if t.cls:
                cells.append(F.struct(F.lit(f"<{RDF}type>").alias("p"), F.lit(f"<{t.cls}>").alias("o")))
            graph = F.lit(f"<{t.graph}>" if t.graph else None).cast("string")
            own = t.df.filter(F.col(t.key).isNotNull()).select(subject.alias("s"), F.explode(F.array(*cells)).alias("x"))
            parts.append(own.select("s", "x.p", "x.o", graph.alias("g")).filter("o IS NOT NULL"))
        out = parts[0] if parts else self.spark.createDataFrame([], QUADS)
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def statements(self, s: IRI | BNode | None = None, p: IRI | None = None, o: IRI | BNode | Literal | None = None, graphs: list | None = None) -> DataFrame:
        """Matching quads, each with its graph; graphs: IRIs, None in the list standing for no graph."""
        out = self.all_quads()
        for name, t in (("s", s), ("p", p), ("o", o)):
            if t is not None:
                out = out.filter(F.col(name) == t.n3())
        if graphs:
            named = [g.n3() if isinstance(g, IRI) else f"<{g}>" for g in graphs if g is not None]
            out = out.filter((F.col("g").isNull() & F.lit(None in graphs)) | F.coalesce(F.col("g").isin(*named), F.lit(False)))
        return out

    def set_namespace(self, prefix: str, iri: str) -> None:
        self.namespaces[prefix] = iri

    def remove_namespace(self, prefix: str) -> None:
        self.namespaces.pop(prefix, None)

    def clear_namespaces(self) -> None:
        self.namespaces.clear()

    def contexts(self) -> DataFrame:
        return self.all_quads().filter("g IS NOT NULL").select("g").distinct()

    def size(self, graphs: list | None = None) -> int:
        return self.statements(graphs=graphs).count()
