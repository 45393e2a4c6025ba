"""Loading, writing, updates, the change log, statistics, summary, text index, server and command line."""

import bz2
import gzip
import json
import random
import re
import urllib.error
import urllib.parse
import urllib.request

import pytest
from pyspark.sql import functions as F

from quadframe import cli
from quadframe.engine import Engine
from quadframe.operators import timeline
from quadframe.operators.update import Updater, bulk_update
from quadframe.plans.cardinality import Statistics, estimate
from quadframe.plans.parser import parse_query
from quadframe.server import Server, stored_queries
from quadframe.sources import formats, load, writers
from quadframe.sources.catalog import Catalog
from quadframe.sources.dataset import QUADS, Dataset, QuadTable
from quadframe.streaming import changes
from quadframe.terms import IRI, XSD, BNode, Literal, parse_term
from quadframe.tools import presplit, profile, stats, summary, textindex

P = IRI("urn:p")
INT = XSD + "integer"


def quads(spark, rows):
    return Dataset.from_quads(spark, rows).quads.df


def got(df):
    return sorted((tuple(r) for r in df.select("s", "p", "o", "g").collect()), key=str)


def grid(n):
    return [(IRI(f"urn:s{i}"), IRI(f"urn:p{j}"), Literal(f"whatever\n\"\\{i}"), IRI("urn:g") if i % 2 else None) for i in range(n) for j in range(n)]


# loading and formats

DOC = [
    (IRI("urn:a"), IRI("urn:v#name"), Literal('x "y"\n\\ü'), None), (IRI("urn:a"), IRI("urn:v#n"), Literal("5", INT), None),
    (BNode("b"), IRI("urn:v#l"), Literal("hi", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en-gb"), None), (IRI("urn:a"), IRI("urn:v#to"), BNode("b"), None),
]


def unlabelled(rows):
    return sorted((tuple("_" if isinstance(t, BNode) else t for t in r) for r in rows), key=str)


@pytest.mark.parametrize("ext", writers.RDF_EXTENSIONS)
def test_formats_round_trip(ext):
    back = list(formats.READERS[ext](writers.serialise(ext, iter(DOC)), None))
    assert unlabelled(back) == unlabelled(DOC)


@pytest.mark.parametrize("ext", [".nq", ".trig", ".trix", ".rj", ".jsonld"])
def test_graphs_round_trip(ext):
    rows = [(s, p, o, IRI("urn:g") if k % 2 else None) for k, (s, p, o, _) in enumerate(DOC)]
    assert unlabelled(formats.READERS[ext](writers.serialise(ext, iter(rows)), None)) == unlabelled(rows)


def test_turtle_forms():
    text = "@base <http://e/> . PREFIX : <#> <a> a :T ; :p 1, 2.5, 1e3, true, 'q'@en-GB, '''l\n'''^^:d ; :l (1 [ :x <b> ]) . _:z :p _:z ."
    found = list(formats.read_turtle(text))
    objects = {q[2] for q in found}
    assert IRI("http://e/#T") in objects and Literal("2.5", XSD + "decimal") in objects and Literal("l\n", "http://e/#d") in objects and len(found) == 14


def test_rdfxml_forms():
    text = """<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="urn:e#" xml:base="http://b/"><e:T r:about="x" e:k="v"><e:p r:resource="#y"/><e:q r:parseType="Collection"><e:U r:ID="z"/></e:q><r:li>one</r:li><e:w r:parseType="Resource"><e:k>1</e:k></e:w></e:T></r:RDF>"""
    found = list(formats.read_rdfxml(text))
    assert (IRI("http://b/x"), IRI("urn:e#p"), IRI("http://b/#y"), None) in found and len(found) == 10


def test_json_nodes_and_ontology():
    found = list(formats.read_json('[{"a": [{"b": 1.50}, true, null, "s"], "x.y": {}}]', "urn:j/"))
    preds = sorted(q[1].value.rsplit("#")[-1] for q in found)
    assert preds.count("type") == 3 and "urn:j/a" in preds and "urn:j/x%2Ey" in preds and "urn:j/a.b" in preds and "urn:j/a:index" in preds
    assert Literal("1.50") in {q[2] for q in found}
    assert not list(formats.read_json("{}", "urn:j/", data=False)) and list(formats.read_json("{}", "urn:j/", ontology=True))
    with pytest.raises(ValueError):
        list(formats.read_json("[1]"))


def test_bulk_load_mix(spark, tmp_path):
    root = tmp_path / "in" / "deep"
    root.mkdir(parents=True)
    (root / "a.jsonld").write_text(json.dumps([{"@id": f"urn:j{i}", "urn:p": i} for i in range(80)]))
    with gzip.open(root / "b.nt.gz", "wt") as f:
        f.write("".join(f'<urn:n{i}> <urn:p> "x" .\n' for i in range(10)))
    with bz2.open(root / "c.nq.bz2", "wt") as f:
        f.write("".join(f'<urn:q{i}> <urn:p> "x" <urn:g> .\n' for i in range(10)))
    (root / "d.nt").write_text('<urn:l> <urn:p> "\\u00fc"@EN-gb .\n# note\n\n_:b <urn:p> _:b .\n<urn:l> <urn:p> "1"^^<http://www.w3.org/2001/XMLSchema#string> .\n')
    (root / "bad.nt").write_text("<urn:x> nothing .\n<urn:y> <urn:p> <urn:z> .\n")
    (root / "other.txt").write_text("not read")
    (root / "e.trig").write_text("<urn:t> { <urn:a> <urn:p> 1 , 2 . broken")
    at = str(tmp_path / "in")
    df = load.load(spark, at, skip_invalid=True)
    rows = got(df)
    assert len(rows) == 80 + 10 + 10 + 3 + 1 and ('<urn:l>', '<urn:p>', '"ü"@en-gb', None) in rows and ('<urn:l>', '<urn:p>', '"1"', None) in rows
    with pytest.raises(Exception):
        load.load(spark, at).collect()
    named = load.load(spark, at, graph="urn:{2}", skip_invalid=True)
    assert named.filter("g = '<urn:g>'").count() == 10 and named.filter("g = '<urn:a.jsonld>'").count() == 80 and named.filter("g = '<urn:d.nt>'").count() == 3
    assert load.load(spark, at, graph="urn:one", override=True, skip_invalid=True).filter("g = '<urn:one>'").count() == 104
    assert load.load(spark, at, override=True, skip_invalid=True).filter("g IS NULL").count() == 104
    load.write(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 104
    (root / "f.ttl").write_text("@prefix e: <urn:e#> . e:a e:p 1 .")
    (root / "g.rdf").write_text('<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:k="urn:k#"><k:T r:about="urn:t"/></r:RDF>')
    kept = load.load(spark, at, graph="urn:n", skip_invalid=True)
    assert load.namespaces(kept) == {"e": "urn:e#", "k": "urn:k#", "r": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}
    assert kept.filter("o = '\"k\"' AND g = '<urn:n>'").count() == 1
    many = {f"p{i}": f"urn:p{i}#" for i in range(10_500)}
    assert load.namespaces(load.namespace_quads(spark, many)) == many
    assert load.namespaces(load.namespace_quads(spark, {"e": "urn:e#", "": "urn:x"})) == {"e": "urn:e#"}


def test_csv_cells(spark, tmp_path):
    df = spark.createDataFrame([('a"b',), ("x,y",), ("l1\nl2\\",), ("",), (None,), ("ü",), ("x😀y",)], "v string")
    assert [r[0] for r in df.select(writers.csv_cell(F.col("v"))).collect()] == ['"a""b"', '"x,y"', "l1\\nl2\\\\", '""', "", "\\u00FC", "x\\uD83D\\uDE00y"]
    e = Engine(spark, Dataset.from_quads(spark, grid(3)))
    writers.export(e, "SELECT ?s ?o { ?s <urn:p0> ?o }", str(tmp_path / "x.csv.gz"))
    lines = [line for f in (tmp_path / "x.csv.gz").glob("*.gz") for line in gzip.open(f, "rt").read().splitlines()]
    assert [x for x in lines if x != "s,o"] and all("whatever\\n" in x for x in lines if x != "s,o")


def test_export_targets(spark, tmp_path):
    e = Engine(spark, Dataset.from_quads(spark, grid(4)))
    assert writers.export(e, "SELECT * { ?s ?p ?o }", "null:") == 16
    for ext in ("nt", "ttl.bz2", "rdf", "jsonld"):
        writers.export(e, "CONSTRUCT { ?s ?p ?o } { ?s ?p ?o }", str(tmp_path / f"o.{ext}"))
    assert sum(1 for r in spark.read.text(str(tmp_path / "o.nt")).collect() if r[0].endswith(" .")) == 16
    for query, target in (("ASK {}", "null:"), ("SELECT * {}", "x.nt"), ("CONSTRUCT { ?s ?p ?o } { ?s ?p ?o }", "x.csv"), ("SELECT * {}", "x.zip")):
        with pytest.raises(writers.ExportFault):
            writers.export(e, query, str(tmp_path / target) if target != "null:" else target)
    made = writers.bulk_export(e, {"q": "CONSTRUCT { ?s ?p ?o } { ?s ?p ?o FILTER(<urn:quadframe:forkAndFilterBy>(2, ?s)) }"}, str(tmp_path / "{0}-{1}.nt"), forks=2)
    assert sum(spark.read.text(m).count() for m in made) == 16


def test_jdbc(spark, tmp_path):
    url = "jdbc:derby:memory:quads;create=true"
    df = spark.createDataFrame([(1, 2.5, "x")], "i long, d double, t string")
    writers.write_jdbc(df, url, "things")
    writers.write_jdbc(spark.createDataFrame([("7", "8.5", "y")], "i string, d string, t string"), url, "things")
    assert sorted(r[0] for r in spark.read.jdbc(url, "things").select("I").collect()) == [1, 7]
    with pytest.raises(writers.ExportFault):
        writers.write_jdbc(df, url, "a; drop")


# changes

def test_add_remove_scan(spark):
    a, b = IRI("urn:a"), IRI("urn:b")
    d = Dataset.from_quads(spark, [(a, P, b), (a, P, b, IRI("urn:g"))])
    assert d.statements(a).count() == 2 and d.size() == 2 and d.statements(graphs=[None]).count() == 1 and d.size(["urn:g"]) == 1
    assert got(Updater(d).run("DELETE DATA { GRAPH <urn:g> { <urn:a> <urn:p> <urn:b> } }").quads.df) == [("<urn:a>", "<urn:p>", "<urn:b>", None)]
    assert Updater(d).run("DELETE DATA { <urn:a> <urn:p> <urn:b> }").size() == 0
    with pytest.raises(PermissionError):
        Updater(Dataset(spark, quads=d.quads, writable=False)).run("CLEAR ALL")
    more = Updater(d).add(quads(spark, [(a, P, b), (b, P, a, IRI("urn:g"))]))
    assert more.size() == 3 and Updater(more).remove(s=a).size() == 1 and Updater(more).remove(s=a, graphs=[None]).size() == 2


@pytest.mark.parametrize("mask", range(16))
def test_every_pattern_of_colliding_statements(spark, mask):
    rows = [(IRI(f"urn:s{i}"), IRI(f"urn:p{j}"), IRI(f"urn:o{k}"), IRI(f"urn:g{g}")) for i in "12" for j in "12" for k in "12" for g in "12"]
    d = Dataset.from_quads(spark, rows)
    cut = [t if mask >> n & 1 else None for n, t in enumerate((IRI("urn:s1"), IRI("urn:p1"), IRI("urn:o1")))]
    graphs = ["urn:g1"] if mask & 8 else None
    assert d.statements(*cut, graphs=graphs).count() == 16 >> mask.bit_count()


def test_updates(spark, tmp_path):
    d = Dataset.from_quads(spark, [(IRI(f"urn:{i}"), P, Literal(str(i), INT), IRI("urn:g") if i % 2 else None) for i in range(6)])
    new = Updater(d).run("DELETE { ?s ?p ?o } INSERT { ?s <urn:q> ?x } WHERE { ?s ?p ?o BIND(?o + 10 AS ?x) FILTER(?o > 3) } ; INSERT { GRAPH <urn:h> { ?s ?p ?o } } WHERE { ?s <urn:q> ?o . ?s ?p ?o }")
    assert got(new.quads.df.filter("p = '<urn:q>'")) == sorted([(f"<urn:{i}>", "<urn:q>", f'"{i + 10}"^^<{INT}>', g) for i in (4, 5) for g in (None, "<urn:h>")], key=str)
    assert d.size() == 6 and new.size() == 8
    w = Updater(d).run("WITH <urn:g> DELETE { ?s ?p ?o } WHERE { ?s ?p ?o }")
    assert w.contexts().count() == 0 and w.size() == 3
    assert Updater(d).run("MOVE GRAPH <urn:g> TO DEFAULT").contexts().count() == 0
    assert Updater(d).run("COPY DEFAULT TO GRAPH <urn:g>").size(["urn:g"]) == 3
    assert Updater(d).run("ADD DEFAULT TO GRAPH <urn:g>").size(["urn:g"]) == 6
    assert Updater(d).run("DROP NAMED").size() == 3 and Updater(d).run("CLEAR DEFAULT").size() == 3 and Updater(d).run("CLEAR ALL").size() == 0
    (tmp_path / "f.ttl").write_text("<urn:a> <urn:p> 1 .")
    up = Updater(d, loader=lambda uri: load.load(spark, uri))
    assert up.run(f"LOAD <file://{tmp_path}/f.ttl> INTO GRAPH <urn:new>").size(["urn:new"]) == 1


def test_bulk_update_reads_one_snapshot_per_stage(spark):
    d = Dataset.from_quads(spark, [(IRI(f"urn:s{i}"), IRI("urn:pred"), IRI(f"urn:o{j}"), IRI("urn:g") if j % 2 else None) for i in range(5) for j in range(5)])
    one = "INSERT { ?o <urn:new> ?s } WHERE { ?s <urn:pred> ?o } ; DELETE { ?s <urn:pred> ?o } WHERE { ?s <urn:pred> ?o }"
    two = "INSERT { ?s <urn:other> ?o } WHERE { ?s <urn:pred> ?o FILTER(<urn:quadframe:forkAndFilterBy>(2, ?s)) } ; DELETE { ?s <urn:none> ?o } WHERE { ?s <urn:none> ?o }"
    new = bulk_update(d, [one, two], now=5, forks=2)
    assert new.statements(p=IRI("urn:pred")).count() == 0 and new.size() == 50


def test_timed_updates(spark):
    t = (IRI("urn:a"), P, IRI("urn:b"))
    d = Dataset(spark, quads=QuadTable(spark.createDataFrame([], QUADS), False))

    def at(kind, ts):
        return Updater(d).events(f"{kind} {{ <urn:a> <urn:p> <urn:b> }} WHERE {{ BIND({ts} AS ?QUADFRAME_TIMESTAMP) }}", 0)

    log = None
    for kind, ts, there in (("INSERT", "2", True), ("DELETE", "1", True), ("DELETE", "4", False), ("INSERT", "3", False), ("INSERT", "4", True)):
        log = at(kind, ts) if log is None else log.unionByName(at(kind, ts))
        assert (timeline.compact(log).count() == 1) == there
    dated = at("INSERT", f'"2002-05-30T09:30:10.2"^^<{XSD}dateTime>')
    assert dated.first()["ts"] == 1022751010200 and parse_term(dated.first()["s"]) == t[0]


def test_thousand_shuffled_changes(spark, tmp_path):
    r = random.Random(1234)
    state, log = {}, []
    for ts in range(1000):
        q = (f"<urn:s{r.randrange(5)}>", f"<urn:p{r.randrange(5)}>", '"o"', None)
        op = r.choice(["insert", "delete"])
        state[q] = op
        log.append((*q, ts, op))
    r.shuffle(log)
    df = spark.createDataFrame(log, timeline.EVENTS)
    want = sorted((q for q, op in state.items() if op == "insert"), key=str)
    assert got(timeline.compact(df)) == want
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(changes.log_sink(str(tmp_path / "log"))).trigger(availableNow=True).start().awaitTermination()
    assert got(changes.read_log(spark, str(tmp_path / "log"))) == want
    changes.current(stream).writeStream.format("memory").queryName("now").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert got(spark.table("now").filter("op = 'insert'")) == want


def test_bulk_delete_and_its_time(spark):
    df = quads(spark, grid(5))
    assert timeline.bulk_delete(df, s=IRI("urn:s1")).count() == 20
    assert timeline.bulk_delete(df, graphs=[None]).count() == 10 and timeline.bulk_delete(df, graphs=["urn:g"]).count() == 15
    events = df.select("*", F.lit(7).cast("long").alias("ts"), F.lit("insert").alias("op"))
    gone = timeline.delete_events(events, p=IRI("urn:p0"))
    assert timeline.compact(gone).count() == 20
    again = events.filter("p = '<urn:p0>'").withColumn("ts", F.lit(8).cast("long")).withColumn("rank", F.lit(None).cast("double"))
    assert timeline.compact(gone.unionByName(again)).count() == 25
    # nanoseconds of today do not fit a double
    late = (1 << 60) + 1
    close = spark.createDataFrame([("a", "b", "c", None, late, "delete"), ("a", "b", "c", None, late - 1, "insert"), ("d", "b", "c", None, late, "insert"), ("d", "b", "c", None, late - 1, "delete")], timeline.EVENTS)
    assert [r.s for r in timeline.compact(timeline.delete_events(close, p=IRI("urn:none"))).collect()] == ["d"]


def test_fork_hash_is_over_utf16(spark):
    from quadframe.functions.library import _fork_hash, plain

    for text in ("", "hello", "x😀é漢"):
        h = 0
        units = text.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = (31 * h + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
        assert spark.range(1).select(_fork_hash(plain(F.lit(text)))).first()[0] == (h - (1 << 32) if h >> 31 else h)


def test_documents_of_an_export_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "DOCUMENT_QUADS", 10)
    writers.write_rdf(quads(spark, grid(5)).coalesce(1), str(tmp_path / "x.rdf"))
    files = list((tmp_path / "x.rdf").glob("part-*"))
    assert len(files) == 3 and sum(len(list(formats.read_rdfxml(f.read_text()))) for f in files) == 25


# statistics and plans

def test_void_statistics(spark):
    rows = [(IRI(f"urn:s{i}") if i % 3 else BNode(f"b{i}"), IRI("http://www.w3.org/1999/02/22-rdf-syntax-ns#type"), IRI(f"urn:c{i % 7}"), IRI(f"urn:g{i % 2}")) for i in range(120)]
    rows += [(IRI("urn:hub"), IRI(f"urn:p{i % 4}"), Literal(str(i % 50)), None) for i in range(60)]
    rows += [(IRI("urn:lone"), P, BNode("x"), IRI("urn:small"))]
    df = quads(spark, rows)
    df = df.unionByName(stats.void(df, 50)).distinct()
    facts = {(r["s"], r["p"].rsplit("#")[-1][:-1], r["o"]) for r in stats.void(df, 50).collect()}
    root = f"<{stats.ROOT}>"
    data = {tuple(None if t is None else t.n3() for t in (*r, None)[:4]) for r in rows}
    number = lambda x: f'"{x}"^^<{XSD}long>'
    for name, value in (("triples", len(data)), ("distinctSubjects", len({r[0] for r in data})), ("properties", 6), ("distinctObjects", len({r[2] for r in data})), ("classes", 7), ("distinctLiterals", 50), ("distinctBlankNodeSubjects", 40), ("distinctBlankNodeObjects", 1)):
        assert (root, name, number(value)) in facts, name
    assert (root, "namedGraph", "<urn:small>") in facts and not any(s == "<urn:small>" for s, _, _ in facts)
    assert ("<urn:g0>", "triples", number(60)) in facts and ("<urn:g0>", "name", "<urn:g0>") in facts
    parts = {o for s, p, o in facts if s == root and p.endswith("Partition")}
    assert len(parts) == 2 and any(p.startswith("<urn:quadframe:statsRoot_property_") for p in parts)
    again = stats.refreshed(df, 50)
    assert got(again) == got(stats.refreshed(again, 50))
    one = stats.refreshed(df.unionByName(quads(spark, [(IRI("urn:new"), P, IRI("urn:o"), IRI("urn:g1"))])), 50, "urn:g1")
    assert one.filter(f"s = '<urn:g1>' AND p LIKE '%void#triples>' AND o LIKE '\"61\"%'").count() == 1 and one.filter(f"s = '{root}' AND p LIKE '%void#triples>' AND o LIKE '\"{len(data)}\"%'").count() == 1
    s = stats.statistics(df.filter(f"g IS NULL OR g <> '<{stats.CONTEXT}>'"), 50)
    assert s.triples == len(data) and s.parts[("s", "<urn:hub>")] == len([d for d in data if d[0] == "<urn:hub>"])


def test_summary_against_plain_python(spark):
    r = random.Random(66)
    rows = set()
    for i in range(50):
        for c in range(4):
            if r.random() < 0.5:
                rows.add((IRI(f"urn:i{i}"), IRI("http://www.w3.org/1999/02/22-rdf-syntax-ns#type"), IRI(f"urn:c{c}")))
        for p in range(4):
            o = IRI(f"urn:i{r.randrange(50)}") if p % 2 else r.choice([Literal("x"), Literal("1", INT), Literal("2.0", XSD + "double")])
            rows.add((IRI(f"urn:i{i}"), IRI(f"urn:p{p}"), o))
    types = {}
    for s, p, o in rows:
        if p.value.endswith("type"):
            types.setdefault(s, set()).add(o.n3())
    want = {}
    for s, p, o in rows:
        if p.value.endswith("type"):
            keys = [("class", None, o.n3(), None)]
        else:
            ranges = types.get(o, ()) if isinstance(o, IRI) else [f"<{o.dt}>"]
            keys = [("property", p.n3(), None, None), *(("domain", p.n3(), d, None) for d in types.get(s, ())), *(("range", p.n3(), None, x) for x in ranges), *(("slice", p.n3(), d, x) for d in types.get(s, ()) for x in ranges)]
        for k in keys:
            want[k] = want.get(k, 0) + 1
    found = summary.summary(quads(spark, rows))
    assert {tuple(x)[:4]: x["cardinality"] for x in found.collect()} == {k: n.bit_length() - 1 for k, n in want.items()}
    assert summary.as_quads(found).filter("p = '<urn:quadframe:cardinality>'").count() == len(want)


def _shuffles(df):
    """Columns of the shuffles whose number of partitions Spark may lower, of the plan before it runs."""
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ENSURE_REQUIREMENTS" in line]


def test_summary_deals_statements_to_a_given_number_of_tasks(spark, monkeypatch):
    """No aggregation or join of the statements themselves leaves its number of tasks open."""
    staged = []
    for name in ("stage",):
        if hasattr(summary, name):
            own = summary.stage
            monkeypatch.setattr(summary, name, lambda df, n: staged.append(df) or own(df, n))
    rows = [(IRI(f"urn:i{i}"), IRI("http://www.w3.org/1999/02/22-rdf-syntax-ns#type"), IRI("urn:c")) for i in range(50)]
    rows += [(IRI(f"urn:i{i}"), P, IRI("urn:i0")) for i in range(50)]
    found = summary.summary(quads(spark, rows))
    assert {r["kind"]: r["cardinality"] for r in found.collect()} == {"class": 5, "property": 5, "domain": 5, "range": 5, "slice": 5}
    bad = [line for df in [*staged, found] for line in _shuffles(df) if re.search(r"hashpartitioning\(s#\d+, p#|hashpartitioning\(s#", line)]
    assert staged and not bad


def test_statistics_deal_values_to_a_given_number_of_tasks(spark):
    rows = [(IRI(f"urn:s{i % 40}"), P, Literal(f"v{i % 7}"), IRI(f"urn:g{i % 3}") if i % 3 else None) for i in range(200)]
    found = stats.partitions(quads(spark, rows), 20)
    want = {}
    for s, p, o, g in rows:
        for role, v in (("subject", s), ("property", p), ("object", o)):
            for graph in {f"<{stats.ROOT}>", g.n3() if g else f"<{stats.ROOT}>"}:
                want[graph, role, v.n3()] = want.get((graph, role, v.n3()), 0) + 1
    assert {(r["graph"], r["role"], r["value"]): r["n"] for r in found.collect()} == {k: n for k, n in want.items() if n >= 20}
    assert not [line for line in _shuffles(found) if "value#" in line]


def test_totals_deal_values_to_a_given_number_of_tasks(spark):
    rows = [(IRI(f"urn:s{i % 40}"), P, Literal(f"v{i % 7}"), IRI(f"urn:g{i % 3}") if i % 3 else None) for i in range(200)]
    found = stats.totals(quads(spark, rows))
    got = {r["graph"]: (r["triples"], r["subjects"], r["properties"], r["objects"], r["iri_subjects"], r["literals"]) for r in found.collect()}
    assert got[f"<{stats.ROOT}>"] == (200, 40, 1, 7, 40, 7) and len(got) == 3 and got["<urn:g1>"] == (67, 40, 1, 7, 40, 7)
    assert not [line for line in _shuffles(found) if "value#" in line]


def test_split_points_of_one_predicate_in_many_blocks(spark):
    rows = [(IRI(f"urn:s{i:04}"), P, Literal("x" * (i % 17))) for i in range(400)] + [(IRI("urn:s0007"), IRI("urn:q"), Literal("y"))]
    found = presplit.split_points(quads(spark, rows), 300, 1)
    want, at = {}, {}
    for s, p, o in sorted(rows, key=lambda r: (r[1].n3(), r[0].n3())):
        key = at.get(p, 0) // 300, p.n3()
        want.setdefault(key, s.n3())
        at[p] = at.get(p, 0) + sum(len(x.n3()) for x in (s, p, o))
    assert {(r["part"], r["p"]): r["s"] for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(block#" in plan and not re.search(r"windowspecdefinition\(p#\d+, s#", plan)


@pytest.mark.parametrize("n,log", [(1, 0), (2, 1), (3, 1), (4, 2), (2**40, 40), (2**40 - 1, 39)])
def test_log2(spark, n, log):
    assert spark.range(1).select(summary.log2(F.lit(n).cast("long"))).first()[0] == log


@pytest.mark.parametrize("text,bound,first,size", [
    ("?s a ?o", "", "", 100), ("?a ?b ?c; ?d ?e", "", "", 1e8), ("?s ?p ?o", "s", "", 100), ("?s ?p ?o", "", "s", 1e-3), ("?s a <urn:c>", "", "", 10), ("<urn:s> a <urn:c>", "", "", 1),
])
def test_estimates_without_statistics(text, bound, first, size):
    node = parse_query(f"SELECT * {{ {text} }}").root.child
    assert estimate(node, set(bound), set(first)) == pytest.approx(size)


def test_estimates_with_statistics():
    s = Statistics(10_000, {("p", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"): 5000})
    pattern = lambda t: parse_query(f"SELECT * {{ {t} }}").root.child
    assert estimate(pattern("?s a ?o"), stats=s) == 5000 and estimate(pattern("?s ?p ?o"), stats=s) == 10_000
    assert estimate(pattern("?s <urn:unknown> ?o"), stats=s) == 100 and estimate(pattern("<urn:s> a ?o"), stats=s) == 50


def test_profile_presplit_textindex(spark):
    rows = grid(6) + [(IRI(f"urn:t{i}"), P, Literal(f"red {'fox' if i % 2 else 'dog'} {i}"), IRI(f"urn:g{i % 4}") if i % 4 else None) for i in range(20)]
    d = Dataset.from_quads(spark, rows)
    e = Engine(spark, d)
    text = profile.profile(e, "SELECT * { ?s ?p ?o . ?s a <urn:x> }", spark_plan=True)
    assert "Original query:" in text and "[1" in text and "Spark plan:" in text and text.index("Optimised") < text.rindex("urn:x")
    assert presplit.split_points(d.quads.df, 200, 1).count() >= 7
    index = textindex.build(d.quads.df)
    assert textindex.lookup(index, ["FOX"]).count() == 10 and textindex.build(d.quads.df, "urn:g1").select("literal").distinct().count() == 5
    assert len(textindex.documents(d.quads.df).first()["id"]) == 40
    count = lambda q: e.query(f'SELECT ?s {{ ?s ?p "{q}"^^<urn:quadframe:search> }}').count()
    assert count("red AND fox") == 10 and count("fox NOT 3") == 9 and count("fox OR dog") == 20 and count("re*") == 20 and count("'red dog'".replace("'", '\\"')) == 10 and count("(fox AND 1) OR (dog AND 2)") == 2


def test_namespaces_and_timeout(spark):
    d = Dataset.from_quads(spark, [(IRI(f"urn:{i}"), P, Literal(str(i % 9))) for i in range(3000)])
    d.set_namespace("e", "urn:")
    e = Engine(spark, d)
    assert len(e.rows("SELECT ?o { e:5 e:p ?o }", timeout=60)) == 1
    d.remove_namespace("e")
    with pytest.raises(ValueError):
        e.rows("SELECT ?o { e:5 e:p ?o }")

    wait = F.expr("coalesce(length(reflect('java.lang.Thread', 'sleep', bigint(60000))), 0) >= 0")
    slow = Dataset(spark, quads=QuadTable(d.quads.df.filter(wait)))
    with pytest.raises(TimeoutError):
        Engine(spark, slow).rows("SELECT * { ?s ?p ?o }", timeout=2)
    d.clear_namespaces()
    assert not d.namespaces


def test_catalog_keeps_versions(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "root"))
    assert c.names() == []
    c.create("one", quads(spark, grid(3)))
    c.create("two")
    old = c.open("one")
    new = c.change("one", lambda d: Updater(d).run("DELETE WHERE { <urn:s0> ?p ?o }"))
    assert (old.size(), new.size(), c.open("two").size()) == (9, 6, 0) and sorted(c.all()) == c.names() == ["one", "two"]
    c.set_writable("one", False)
    with pytest.raises(PermissionError):
        c.save("one", new.quads.df)
    with pytest.raises(ValueError):
        c.create("one")
    c.set_writable("one", True)
    c.prune("one")
    assert c.open("one").size() == 6
    c.drop("two")
    with pytest.raises(KeyError):
        c.open("two")


# server and command line

@pytest.fixture(scope="module")
def server(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stored")
    (at / "q.sparql").write_text("SELECT ?s { ?s <urn:{{p}}> {{o}} }")
    (at / "all.properties").write_text("# stored\nquery=@q.sparql\nplain=ASK {}\n")
    d = Dataset.from_quads(spark, [(IRI("urn:a"), P, Literal("1"), IRI("urn:g1")), (IRI("urn:b"), P, Literal("x,y"), IRI("urn:g2")), (IRI("urn:c"), P, Literal("z", "", "en"))])
    with Server(Engine(spark, d), stored=stored_queries(str(at / "all.properties"))) as s:
        yield f"http://127.0.0.1:{s.port}/"


def ask(url, data=None, method=None, **headers):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, {k.replace("_", "-"): v for k, v in headers.items()}, method=method)) as r:
            return r.status, r.headers["Content-Type"].split(";")[0], r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, None, e.read().decode()


def q(text, **more):
    return "?" + urllib.parse.urlencode({"query": text, **more})


def test_protocol(server):
    every = "SELECT ?s ?o { ?s <urn:p> ?o } ORDER BY ?s"
    assert ask(server + q(every))[1:] == ("text/csv", 's,o\r\nurn:a,1\r\nurn:b,"x,y"\r\nurn:c,z\r\n')
    status, kind, text = ask(server + q(every), Accept="text/html;q=0.9, application/sparql-results+json;q=0.5")
    assert kind.endswith("results+json") and len(json.loads(text)["results"]["bindings"]) == 3
    assert "<binding" in ask(server + "x.srx" + q(every))[2] and ask(server + "x.tsv" + q(every))[2].startswith("?s\t?o\n")
    assert json.loads(ask(server + q("ASK { ?s ?p 'nothing' }"))[2]) == {"head": {}, "boolean": False}
    assert ask(server + q("CONSTRUCT WHERE { ?s ?p '1' }"))[1:] == ("application/n-triples", '<urn:a> <urn:p> "1" .\n')
    assert ask(server + q("CONSTRUCT WHERE { ?s ?p '1' }"), Accept="text/turtle")[1] == "text/turtle"
    assert ask(server + q(every, **{"default-graph-uri": "urn:g1"}))[2].count("urn:") == 1
    assert ask(server + q("SELECT ?s { GRAPH ?g { ?s ?p ?o } }", **{"named-graph-uri": "urn:g2"}))[2] == "s\r\nurn:b\r\n"
    body = urllib.parse.urlencode({"query": every}).encode()
    assert ask(server, body, Content_Type="application/x-www-form-urlencoded")[0] == 200
    assert ask(server, every.encode(), Content_Type="application/sparql-query; charset=utf-8")[0] == 200
    assert ask(server + "query?p=p&o='1'")[2] == "s\r\nurn:a\r\n" and ask(server + "query.csv?p=p&o='1'")[0] == 200
    assert [ask(server + x)[0] for x in ("", "?query=a&query=b", "query?p=p", q("SELECT nonsense"))] == [400] * 4
    assert ask(server, every.encode(), Content_Type="text/plain")[0] == 400 and ask(server, b"x", "PUT")[0] == 400
    assert ask(server, every.encode(), Content_Type="application/sparql-query; charset=latin1")[0] == 400
    assert ask(server + q(every), b"body", "GET")[0] == 400


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in.ttl").write_text("@prefix : <urn:> . " + " ".join(f":s{i} :p {i} ." for i in range(20)))
    store = str(tmp_path / "store")
    assert cli.main(["bulkload", "-s", str(tmp_path / "in.ttl"), "-t", store, "-g", "urn:g"]) == 0
    assert cli.main(["export", "-s", store, "-q", "SELECT * { ?s ?p ?o FILTER(?o > 9) }", "-t", "null:"]) == 0
    assert capsys.readouterr().out.strip().endswith("10")
    assert cli.main(["update", "-s", store, "-q", "DELETE { ?s ?p ?o } WHERE { ?s ?p ?o FILTER(?o < 5) }", "-t", str(tmp_path / "new")]) == 0
    assert spark.read.parquet(str(tmp_path / "new")).count() == 15
    assert cli.main(["bulkdelete", "-s", store, "-t", str(tmp_path / "less"), "-b", "<urn:s1>", "-g", "urn:g"]) == 0
    assert spark.read.parquet(str(tmp_path / "less")).count() == 19
    assert cli.main(["stats", "-s", store, "-t", str(tmp_path / "stats.nt"), "-r", "5"]) == 0
    assert cli.main(["stats", "-s", store, "-t", str(tmp_path / "refreshed"), "-r", "5", "-u"]) == 0
    both = spark.read.parquet(str(tmp_path / "refreshed"))
    assert both.filter("g = '<urn:g>'").count() == 20 and both.filter("g <> '<urn:g>'").count() == spark.read.text(str(tmp_path / "stats.nt")).count()
    (tmp_path / "asks" / "deep").mkdir(parents=True)
    (tmp_path / "asks" / "one.rq").write_text("SELECT ?s\n{ ?s ?p ?o }")
    (tmp_path / "asks" / "deep" / "two.rq").write_text("SELECT ?o { ?s ?p ?o }")
    assert cli.main(["bulkexport", "-s", store, "-q", str(tmp_path / "asks"), "-t", str(tmp_path / "out-{0}.csv")]) == 0
    assert (tmp_path / "out-one.csv").exists() and (tmp_path / "out-two.csv").exists()
    assert cli.main(["summary", "-s", store, "-t", str(tmp_path / "summary.nq"), "-d", "1"]) == 0
    assert cli.main(["esindex", "-s", store, "-t", str(tmp_path / "index")]) == 0
    assert cli.main(["profile", "-s", store, "-q", "SELECT * { ?s ?p ?o }"]) == 0 and cli.main(["presplit", "-s", store, "-d", "1"]) == 0
    assert cli.main([]) == -1
    for bad in (["export", "-s", "x"], ["export", "-s", "x", "-s", "y", "-q", "q", "-t", "t"], ["nothing"], ["stats", "-z"]):
        with pytest.raises(SystemExit):
            cli.main(bad)
