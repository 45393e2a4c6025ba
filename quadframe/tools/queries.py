"""Registered queries of updates, time, the bulk tools and the readers, with their DuckDB equivalents."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeline import bulk_delete, compact, delete_events
from ..operators.update import Updater
from ..plans.cardinality import estimate
from ..plans.parser import parse_query
from ..plans.queries import PREFIX, dataset, table
from ..sources.dataset import Dataset
from ..terms import IRI
from . import presplit, stats, summary

_INT = "\"^^<http://www.w3.org/2001/XMLSchema#integer>"
_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
#: nation and customer as triples, as the SQL side sees them.
_QUADS = f"""
WITH q AS (
  SELECT '<urn:nation/' || n_nationkey || '>' AS s, p, o, NULL AS g FROM nation, (VALUES ('<urn:p/n_nationkey>'), ('<urn:p/n_name>'), ('<urn:p/n_regionkey>'), ('{_TYPE}')) t(p),
    LATERAL (SELECT CASE p WHEN '<urn:p/n_nationkey>' THEN '"' || n_nationkey || '{_INT}' WHEN '<urn:p/n_name>' THEN '"' || n_name || '"' WHEN '<urn:p/n_regionkey>' THEN '<urn:region/' || n_regionkey || '>' ELSE '<urn:class/nation>' END AS o)
  UNION ALL
  SELECT '<urn:orders/' || o_orderkey || '>', p, o, '<urn:status/' || o_orderstatus || '>' FROM (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')), (VALUES ('<urn:p/o_orderkey>'), ('<urn:p/o_custkey>'), ('<urn:p/o_orderstatus>'), ('<urn:p/o_orderpriority>'), ('<urn:p/o_totalprice>'), ('<urn:p/o_orderdate>'), ('{_TYPE}')) t(p),
    LATERAL (SELECT CASE p WHEN '<urn:p/o_orderkey>' THEN '"' || o_orderkey || '{_INT}' WHEN '<urn:p/o_custkey>' THEN '<urn:customer/' || o_custkey || '>' WHEN '<urn:p/o_orderstatus>' THEN '"' || o_orderstatus || '"' WHEN '<urn:p/o_orderpriority>' THEN '"' || o_orderpriority || '"' WHEN '<urn:p/o_totalprice>' THEN '"' || o_totalprice || 'E0"^^<http://www.w3.org/2001/XMLSchema#double>' WHEN '<urn:p/o_orderdate>' THEN '"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '"^^<http://www.w3.org/2001/XMLSchema#dateTime>' ELSE '<urn:class/orders>' END AS o)
)"""


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, "nation")]
    for s in "FOP":
        parts.append(table(spark, sf_dir, "orders", f"urn:status/{s}", f"o_orderstatus = '{s}'"))
    return Dataset(spark, parts).all_quads()




def _escaped(column: str) -> str:
    """SQL for a string as N-Triples escapes it."""
    for a, b in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")):
        column = f"replace({column}, {a}, {b})"
    return column


_MEASURES = f"""count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS properties, count(DISTINCT o) AS objects,
  count(DISTINCT CASE WHEN p = '{_TYPE}' THEN o END) AS classes, count(DISTINCT CASE WHEN o LIKE '<%' THEN o END) AS iri_objects, count(DISTINCT CASE WHEN o LIKE '"%' THEN o END) AS literals"""
_COLUMNS = ["triples", "subjects", "properties", "objects", "classes", "iri_objects", "literals"]


def q60_void_stats_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(_quads(spark, sf_dir)).filter(F.col("graph") == f"<{stats.ROOT}>").select(*_COLUMNS)


def q61_void_stats_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(_quads(spark, sf_dir)).filter(F.col("graph") != f"<{stats.ROOT}>").select("graph", *_COLUMNS)


def q62_void_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.partitions(_quads(spark, sf_dir), 200).filter(F.col("graph") == f"<{stats.ROOT}>").select("role", "value", "n")


def q63_schema_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summary(dataset(spark, sf_dir, "nation", "region", "customer").all_quads())


def _updated(spark: SparkSession, sf_dir: str, *texts: str) -> DataFrame:
    d = dataset(spark, sf_dir, "nation", "supplier")
    for t in texts:
        d = Updater(d).run(PREFIX + t)
    return d.quads.df


_INSERT = "INSERT { GRAPH <urn:names> { ?n <urn:label> ?name . } ?n <urn:in> ?r } WHERE { ?n p:n_name ?name ; p:n_regionkey ?r }"


def q65_update_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(spark, sf_dir, _INSERT)


def q66_update_delete_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(spark, sf_dir, _INSERT, "DELETE { ?n <urn:in> ?r } INSERT { ?r <urn:has> ?n } WHERE { ?n <urn:in> ?r FILTER(?r != <urn:region/0>) }")


def q67_update_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(spark, sf_dir, _INSERT + " ; COPY GRAPH <urn:names> TO GRAPH <urn:copy> ; CLEAR GRAPH <urn:names>")


def q89_update_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USING names the graph that WHERE reads."""
    return _updated(spark, sf_dir, _INSERT, "INSERT { GRAPH <urn:more> { ?n <urn:seen> ?l } } USING <urn:names> WHERE { ?n ?p ?l }")


def q90_prefixes_as_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.load import namespace_quads

    return namespace_quads(spark, {"p": "urn:p/", "c": "urn:class/", "": "urn:none/"}, "urn:g").select("s", "o", "g")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a change log: users get event types, purchases take them away."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    term = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"), F.lit(">"))
    return e.select(term("<urn:user/", F.col("user_id")).alias("s"), F.lit("<urn:p/did>").alias("p"), F.concat(F.lit('"'), F.col("event_type"), F.lit('"')).alias("o"), F.lit(None).cast("string").alias("g"), F.unix_micros(F.to_timestamp(F.col("ts"))).alias("ts"), F.when(F.col("event_id") % 3 == 0, "delete").otherwise("insert").alias("op"))


_LOG = """WITH e AS (SELECT '<urn:user/' || user_id || '>' AS s, '<urn:p/did>' AS p, '"' || event_type || '"' AS o, ts, event_id % 3 <> 0 AS ins FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY s, o ORDER BY ts DESC, ins DESC) AS k FROM e) """


def q68_lww_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(_events(spark, sf_dir)).select("s", "p", "o")


def q69_bulk_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bulk_delete(_quads(spark, sf_dir), p=IRI("urn:p/o_custkey"), graphs=["urn:status/F", None])


def q70_json_to_rdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn as a JSON object read by the JSON reader."""
    from collections.abc import Iterator

    import pyarrow as pa

    from ..ship import ship
    from ..sources.formats import read_json

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [q for text in b.column(0).to_pylist() for q in read_json(text, "urn:json/")]
            rows = [(p.value, o.n3()) for _, p, o, _ in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["p", "o"])

    made = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("j"))
    return made.mapInArrow(run, "p string, o string").groupBy("p", "o").count().select("p", "o", F.col("count").alias("n"))


def q71_presplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presplit.split_points(_quads(spark, sf_dir), limit_bytes=100_000, decimate=1)


#: Queries and their estimates without statistics.
GOLDEN = [("?s ?p ?o", 1000.0), ("?s a ?o", 100.0), ("<urn:a> ?p ?o", 100.0), ("<urn:a> a ?o", 10.0), ("<urn:a> a <urn:b>", 1.0), ('?s ?p "x"^^<urn:quadframe:search>', 0.0001)]


def q72_profile_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for text, _ in GOLDEN:
        node = parse_query(f"SELECT * {{ {text} }}").root.child.patterns[0]
        rows.append((text, estimate(node)))
    return spark.createDataFrame(rows, "pattern string, size double")


def q73_delete_keeps_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk deletion at the inserts' own times wins over these."""
    return compact(delete_events(_events(spark, sf_dir), o=_click())).select("s", "p", "o")


def _click():
    from ..terms import Literal

    return Literal("click")


_Q = [
    (q60_void_stats_root, f"{_QUADS} SELECT {_MEASURES} FROM q"),
    (q61_void_stats_graph, f"{_QUADS} SELECT g AS graph, {_MEASURES} FROM q WHERE g IS NOT NULL GROUP BY g"),
    (q62_void_partitions, f"{_QUADS} SELECT * FROM (SELECT 'subject' AS role, s AS value, count(*) AS n FROM q GROUP BY s UNION ALL SELECT 'property', p, count(*) FROM q GROUP BY p UNION ALL SELECT 'object', o, count(*) FROM q GROUP BY o) WHERE n >= 200"),
    (q65_update_insert, "SELECT '<urn:nation/' || n_nationkey || '>' AS s, '<urn:label>' AS p, '\"' || n_name || '\"' AS o, '<urn:names>' AS g FROM nation UNION ALL SELECT '<urn:nation/' || n_nationkey || '>', '<urn:in>', '<urn:region/' || n_regionkey || '>', NULL FROM nation"),
    (q66_update_delete_insert, "SELECT '<urn:nation/' || n_nationkey || '>' AS s, '<urn:label>' AS p, '\"' || n_name || '\"' AS o, '<urn:names>' AS g FROM nation UNION ALL SELECT CASE WHEN n_regionkey = 0 THEN '<urn:nation/' || n_nationkey || '>' ELSE '<urn:region/' || n_regionkey || '>' END, CASE WHEN n_regionkey = 0 THEN '<urn:in>' ELSE '<urn:has>' END, CASE WHEN n_regionkey = 0 THEN '<urn:region/' || n_regionkey || '>' ELSE '<urn:nation/' || n_nationkey || '>' END, NULL FROM nation"),
    (q67_update_clear, "SELECT '<urn:nation/' || n_nationkey || '>' AS s, '<urn:label>' AS p, '\"' || n_name || '\"' AS o, '<urn:copy>' AS g FROM nation UNION ALL SELECT '<urn:nation/' || n_nationkey || '>', '<urn:in>', '<urn:region/' || n_regionkey || '>', NULL FROM nation"),
    (q68_lww_compaction, _LOG + "SELECT s, p, o FROM r WHERE k = 1 AND ins"),
    (q69_bulk_delete, f"{_QUADS} SELECT s, p, o, g FROM q WHERE NOT (p = '<urn:p/o_custkey>' AND g = '<urn:status/F>') OR g IS NULL"),
    (q70_json_to_rdf, f"WITH c AS (SELECT * FROM conversations) SELECT p, o, count(*) AS n FROM (SELECT '{_TYPE[1:-1]}' AS p, '<urn:json/:Node>' AS o FROM c UNION ALL SELECT 'urn:json/conv_id', '\"' || conv_id || '\"' FROM c UNION ALL SELECT 'urn:json/turn', '\"' || turn || '\"' FROM c UNION ALL SELECT 'urn:json/role', '\"' || role || '\"' FROM c WHERE role IS NOT NULL UNION ALL SELECT 'urn:json/text', '\"' || {_escaped('text')} || '\"' FROM c WHERE text IS NOT NULL) GROUP BY p, o"),
    (q71_presplit, f"""{_QUADS}, z AS (SELECT p, substr(s, 1, 24) AS x, sum(length(s) + length(p) + length(o) + coalesce(length(g), 0)) AS bytes FROM q GROUP BY ALL),
y AS (SELECT p, x, CAST(floor((sum(bytes) OVER (PARTITION BY p ORDER BY x) - bytes) / 100000) AS BIGINT) AS part FROM z) SELECT part, p, min(x) AS s FROM y GROUP BY part, p"""),
    (q89_update_using, "SELECT '<urn:nation/' || n_nationkey || '>' AS s, '<urn:label>' AS p, '\"' || n_name || '\"' AS o, '<urn:names>' AS g FROM nation UNION ALL SELECT '<urn:nation/' || n_nationkey || '>', '<urn:in>', '<urn:region/' || n_regionkey || '>', NULL FROM nation UNION ALL SELECT '<urn:nation/' || n_nationkey || '>', '<urn:seen>', '\"' || n_name || '\"', '<urn:more>' FROM nation"),
    (q90_prefixes_as_triples, "SELECT '<urn:p/>' AS s, '\"p\"' AS o, '<urn:g>' AS g UNION ALL SELECT '<urn:class/>', '\"c\"', '<urn:g>'"),
    (q72_profile_cardinality, "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in GOLDEN) + ") v(pattern, size)"),
    (q73_delete_keeps_time, _LOG + "SELECT s, p, o FROM r WHERE k = 1 AND ins AND o <> '\"click\"'"),
]
_SUMMARY = """
WITH t AS (SELECT '<urn:nation/' || n_nationkey || '>' AS x, '<urn:class/nation>' AS cls FROM nation UNION ALL SELECT '<urn:region/' || r_regionkey || '>', '<urn:class/region>' FROM region UNION ALL SELECT '<urn:customer/' || c_custkey || '>', '<urn:class/customer>' FROM customer),
f AS (SELECT '<urn:nation/' || n_nationkey || '>' AS s, '<urn:p/n_regionkey>' AS p, '<urn:region/' || n_regionkey || '>' AS o, NULL AS dt FROM nation
 UNION ALL SELECT '<urn:nation/' || n_nationkey || '>', '<urn:p/n_name>', NULL, 'string' FROM nation UNION ALL SELECT '<urn:nation/' || n_nationkey || '>', '<urn:p/n_nationkey>', NULL, 'integer' FROM nation
 UNION ALL SELECT '<urn:region/' || r_regionkey || '>', '<urn:p/r_name>', NULL, 'string' FROM region UNION ALL SELECT '<urn:region/' || r_regionkey || '>', '<urn:p/r_regionkey>', NULL, 'integer' FROM region
 UNION ALL SELECT '<urn:customer/' || c_custkey || '>', '<urn:p/c_custkey>', NULL, 'integer' FROM customer UNION ALL SELECT '<urn:customer/' || c_custkey || '>', '<urn:p/c_name>', NULL, 'string' FROM customer
 UNION ALL SELECT '<urn:customer/' || c_custkey || '>', '<urn:p/c_nationkey>', '<urn:nation/' || c_nationkey || '>', NULL FROM customer UNION ALL SELECT '<urn:customer/' || c_custkey || '>', '<urn:p/c_acctbal>', NULL, 'double' FROM customer
 UNION ALL SELECT '<urn:customer/' || c_custkey || '>', '<urn:p/c_mktsegment>', NULL, 'string' FROM customer),
d AS (SELECT f.*, a.cls AS domain, coalesce(b.cls, '<http://www.w3.org/2001/XMLSchema#' || dt || '>') AS range FROM f JOIN t a ON a.x = f.s LEFT JOIN t b ON b.x = f.o),
u AS (SELECT 'class' AS kind, NULL AS predicate, cls AS domain, NULL AS range, count(*) AS n FROM t GROUP BY cls
 UNION ALL SELECT 'property', p, NULL, NULL, count(*) FROM f GROUP BY p UNION ALL SELECT 'domain', p, domain, NULL, count(*) FROM d GROUP BY p, domain
 UNION ALL SELECT 'range', p, NULL, range, count(*) FROM d WHERE range IS NOT NULL GROUP BY p, range UNION ALL SELECT 'slice', p, domain, range, count(*) FROM d WHERE range IS NOT NULL GROUP BY p, domain, range)
SELECT kind, predicate, domain, range, CAST(length(bin(n)) - 1 AS INTEGER) AS cardinality FROM u
"""
ALL = {f.__name__: (f, sql) for f, sql in [*_Q, (q63_schema_summary, _SUMMARY)]}
__all__ = ["ALL"]
