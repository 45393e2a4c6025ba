"""VoID statistics of a dataset: totals and frequent subjects, predicates and objects, overall and per graph."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import t_is
from ..plans.cardinality import Statistics
from ..terms import QF, RDF, SD, VOID, VOID_EXT, XSD
from .combine import pre_summed, shares

CONTEXT, ROOT = QF + "statsContext", QF + "statsRoot"
_MEASURES = {
    "triples": VOID + "triples", "subjects": VOID + "distinctSubjects", "properties": VOID + "properties", "objects": VOID + "distinctObjects", "classes": VOID + "classes",
    "iri_subjects": VOID_EXT + "distinctIRIReferenceSubjects", "bnode_subjects": VOID_EXT + "distinctBlankNodeSubjects",
    "iri_objects": VOID_EXT + "distinctIRIReferenceObjects", "bnode_objects": VOID_EXT + "distinctBlankNodeObjects", "literals": VOID_EXT + "distinctLiterals",
}
_ROLES = {"s": "subject", "p": "property", "o": "object"}


def _cells(quads: pa.Table) -> list[pa.Table]:
    """Roles and values of the dataset and of each graph, each counted as 1."""
    out = []
    typed = quads.filter(pc.fill_null(pc.equal(quads["p"], f"<{RDF}type>"), False))
    for t, column, role in ((quads, "s", "s"), (quads, "p", "p"), (quads, "o", "o"), (typed, "o", "c")):
        own = t.filter(pc.is_valid(t["g"]))
        for some, graph in ((t, pa.repeat(f"<{ROOT}>", len(t))), (own, own["g"])):
            out.append(pa.table({"graph": graph, "role": pa.repeat(role, len(some)), "value": some[column], "n": pa.repeat(1, len(some))}))
    return out


def _per_value(quads: DataFrame) -> DataFrame:
    """One row per role and value of the dataset (graph = ROOT) and of each graph, with its quad count.
    Workers count some statements at a time first, which keeps hot predicates and objects from meeting unreduced."""
    some = pre_summed(quads.select("g", "s", "p", "o"), "graph string, role string, value string, n long", _cells)
    return some.repartition(shares(quads), "graph", "role", "value").groupBy("graph", "role", "value").agg(F.sum("n").alias("n"))


def totals(quads: DataFrame) -> DataFrame:
    """graph and one column per measure."""
    v = _per_value(quads.filter(F.col("g").isNull() | (F.col("g") != f"<{CONTEXT}>")))

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    role, value = F.col("role"), F.col("value")
    return v.groupBy("graph").agg(
        F.sum(F.when(role == "p", F.col("n"))).alias("triples"), count(role == "s").alias("subjects"), count(role == "p").alias("properties"), count(role == "o").alias("objects"), count(role == "c").alias("classes"),
        count((role == "s") & t_is(value, "<")).alias("iri_subjects"), count((role == "s") & t_is(value, "_")).alias("bnode_subjects"),
        count((role == "o") & t_is(value, "<")).alias("iri_objects"), count((role == "o") & t_is(value, "_")).alias("bnode_objects"), count((role == "o") & t_is(value, '"')).alias("literals"),
    )


def partitions(quads: DataFrame, threshold: int = 1000) -> DataFrame:
    """(graph, role, value, n): subjects, predicates and objects of at least threshold quads."""
    v = _per_value(quads.filter(F.col("g").isNull() | (F.col("g") != f"<{CONTEXT}>")))
    return v.filter((F.col("role") != "c") & (F.col("n") >= threshold)).select("graph", F.element_at(F.create_map(*[F.lit(x) for kv in _ROLES.items() for x in kv]), F.col("role")).alias("role"), "value", "n")


def _node(graph: Column, role: Column, value: Column) -> Column:
    name = F.rtrim(F.translate(F.base64(F.unhex(F.sha1(value))), "+/", "-_"), F.lit("="))
    return F.concat(F.expr("substring(graph, 1, length(graph) - 1)"), F.lit("_"), role, F.lit("_"), name, F.lit(">"))


def void(quads: DataFrame, threshold: int = 1000, graph: str | None = None) -> DataFrame:
    """The statistics as quads of the statistics graph; graph: that graph's statistics alone. Graphs with
    fewer quads than threshold are only named."""
    lit = lambda x: F.lit(f"<{x}>")
    number = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit(f'"^^<{XSD}long>'))
    t, parts = totals(quads), partitions(quads, threshold)
    if graph:
        t, parts = t.filter(F.col("graph") == f"<{graph}>"), parts.filter(F.col("graph") == f"<{graph}>")
    root = f"<{ROOT}>"
    told = t.filter((F.col("graph") == root) | (F.col("triples") >= threshold))

    def rows(df: DataFrame, *cells: tuple) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(s.alias("s"), p.alias("p"), o.alias("o")) for s, p, o in cells])).alias("x")).select("x.*")

    g = F.col("graph")
    out = rows(told, *[(g, lit(iri), F.when(F.col(m) > 0, number(F.col(m)))) for m, iri in _MEASURES.items()], (g, lit(RDF + "type"), lit(VOID + "Dataset")), (g, lit(RDF + "type"), lit(SD + "Graph")))
    out = out.unionByName(rows(told.filter(g == root), (g, lit(RDF + "type"), lit(SD + "Dataset")), (g, lit(SD + "defaultGraph"), g)))
    out = out.unionByName(rows(told.filter(g != root), (g, lit(RDF + "type"), lit(SD + "NamedGraph")), (g, lit(SD + "name"), g), (g, lit(SD + "graph"), g)))
    out = out.unionByName(rows(t.filter(g != root), (lit(ROOT), lit(SD + "namedGraph"), g)))
    node = _node(g, F.col("role"), F.col("value"))
    of = parts.join(told.select("graph"), "graph", "left_semi")
    out = out.unionByName(rows(of, (g, F.concat(F.lit(f"<{VOID}"), F.col("role"), F.lit("Partition>")), node), (node, lit(RDF + "type"), lit(VOID + "Dataset")), (node, F.concat(F.lit(f"<{VOID}"), F.col("role"), F.lit(">")), F.col("value")), (node, lit(VOID + "triples"), number(F.col("n")))))
    return out.filter("o IS NOT NULL").distinct().withColumn("g", lit(CONTEXT))


def refreshed(quads: DataFrame, threshold: int = 1000, graph: str | None = None) -> DataFrame:
    """quads with their statistics graph made anew, or only one graph's part of it."""
    rest = quads.filter(F.col("g").isNull() | (F.col("g") != f"<{CONTEXT}>"))
    if graph:
        old = quads.filter(F.col("g") == f"<{CONTEXT}>")
        mine = f"<{graph}>"
        prefix = mine[:-1] + "_"
        gone = (F.col("s") == mine) | F.startswith(F.col("s"), F.lit(prefix))
        rest = rest.unionByName(old.filter(~gone))
    return rest.unionByName(void(quads, threshold, graph)).distinct()


def statistics(quads: DataFrame, threshold: int = 1000) -> Statistics:
    """What the join order needs: the total and the frequent terms (at most 3 * triples / threshold)."""
    total = quads.count()
    found = partitions(quads, threshold).filter(F.col("graph") == f"<{ROOT}>").collect()
    return Statistics(float(total), {(r["role"][0], r["value"]): float(r["n"]) for r in found})
