"""Hand-written cases by W3C category, and the operators beyond the standard."""

import pytest

from quadframe.engine import Engine
from quadframe.functions.library import UnknownFunction, plain, register_function, unregister_function
from quadframe.functions.values import lexical
from quadframe.plans.parser import SyntaxFault, parse_query, parse_update
from quadframe.sources.dataset import Dataset
from quadframe.sources.formats import read_turtle
from quadframe.terms import XSD, IRI, Literal, parse_term

DATA = """
@prefix : <urn:x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a a :Person ; :name "Ann" ; :age 30 ; :knows :b , :c ; :nick "annie"@en , "änn\\n\\"x\\""@de .
:b a :Person ; :name "Bob" ; :age 25 ; :knows :c ; :mail <mailto:b> .
:c a :Person ; :name "Cid" ; :age "x" ; :knows :a .
:d a :Robot ; :name "Dee" ; :weight 1.5 ; :made "2020-02-29T10:20:30.5Z"^^xsd:dateTime ; :part [ :name "arm" ] .
:n1 { :a :name "Ann" . :e :name "Eve" ; :age 7 }
:n2 { :e :name "Eve" . :f :likes :f }
"""


@pytest.fixture(scope="module")
def engine(spark):
    d = Dataset.from_quads(spark, read_turtle(DATA))
    d.namespaces = {"": "urn:x/"}
    return Engine(spark, d)


def rows(engine, text, **options):
    df = engine.query(text, as_terms=True, **options)
    return sorted((tuple(None if t is None else t.replace("urn:x/", ":") for t in r) for r in df.collect()), key=str)


INT = f"^^<{XSD}integer>"


@pytest.mark.parametrize("text,want", [
    ("SELECT ?n { ?s :name ?n ; a :Person }", [('"Ann"',), ('"Bob"',), ('"Cid"',)]),
    ("SELECT ?n { ?s :name ?n FILTER(?s = :e) }", [('"Eve"',)]),  # in two graphs, once
    ("SELECT ?g { GRAPH ?g { :e :name ?n } }", [("<:n1>",), ("<:n2>",)]),
    ("SELECT ?n FROM :n2 { ?s :name ?n }", [('"Eve"',)]),
    ("SELECT ?n FROM :n1 FROM :n2 { ?s :name ?n }", [('"Ann"',), ('"Eve"',)]),
    ("SELECT ?s FROM NAMED :n2 { ?s ?p ?o }", []),
    ("SELECT ?s FROM :n1 { GRAPH ?g { ?s ?p ?o } }", []),
    ("SELECT ?n FROM <http://www.openrdf.org/schema/sesame#nil> { ?s :name ?n FILTER(?n IN (\"Ann\", \"Eve\")) }", [('"Ann"',)]),
    ("SELECT ?x { ?x :likes ?x }", [("<:f>",)]),
    ("SELECT ?a ?m { ?a a :Person OPTIONAL { ?a :mail ?m } }", [("<:a>", None), ("<:b>", "<mailto:b>"), ("<:c>", None)]),
    ("SELECT ?s { ?s a :Person FILTER(?s != :a) MINUS { ?s :mail ?m } }", [("<:c>",)]),
    ("SELECT ?s { ?s :age ?a FILTER(?a > 26) }", [("<:a>",)]),  # "x" is an error
    ("SELECT ?s { ?s :age ?a FILTER(!(?a > 26)) }", [("<:b>",), ("<:e>",)]),
    ("SELECT (SUM(?a) AS ?x) { ?s :age ?a }", [(None,)]),
    ("SELECT (SUM(?a) AS ?x) (AVG(?a) AS ?y) (MIN(?a) AS ?z) { ?s :age ?a FILTER(ISNUMERIC(?a)) }", [(f'"62"{INT}', f'"20.666666666667"^^<{XSD}decimal>', f'"7"{INT}')]),
    ("SELECT (COUNT(*) AS ?n) { ?s :none ?o }", [(f'"0"{INT}',)]),
    ("SELECT ?p (COUNT(*) AS ?n) { ?s :none ?p } GROUP BY ?p", []),
    ("SELECT (GROUP_CONCAT(?n; SEPARATOR=\"|\") AS ?x) { ?s a :Person ; :name ?n }", [('"Ann|Bob|Cid"',)]),
    ("SELECT ?n { ?s :nick ?n FILTER(LANG(?n) = \"de\") }", [('"änn\\n\\"x\\""@de',)]),
    ("SELECT ?l { :a :nick ?n FILTER(LANGMATCHES(LANG(?n), \"EN\")) BIND(UCASE(?n) AS ?l) }", [('"ANNIE"@en',)]),
    ("SELECT (STRLEN(?n) AS ?l) { :a :nick ?n FILTER(LANG(?n) = \"de\") }", [(f'"7"{INT}',)]),
    ("SELECT ?y ?m ?z ?t { :d :made ?d BIND(YEAR(?d) AS ?y) BIND(SECONDS(?d) AS ?m) BIND(TZ(?d) AS ?z) BIND(TIMEZONE(?d) AS ?t) }", [(f'"2020"{INT}', f'"30.5"^^<{XSD}decimal>', '"Z"', f'"PT0S"^^<{XSD}dayTimeDuration>')]),
    ("SELECT ?x { :d :weight ?w BIND(?w * 2 AS ?x) }", [(f'"3.0"^^<{XSD}decimal>',)]),
    ("SELECT ?x { BIND(7 / 2 AS ?x) }", [(f'"3.5"^^<{XSD}decimal>',)]),
    ("SELECT ?x { BIND(1 / 0 AS ?x) }", [(None,)]),
    ("SELECT ?s { BIND(1 / 0 AS ?s) ?s :name ?n }", []),  # a failed BIND stays unbound
    ("SELECT ?s { ?s :knows+ :a }", [("<:a>",), ("<:b>",), ("<:c>",)]),
    ("SELECT ?o { :b :knows* ?o }", [("<:a>",), ("<:b>",), ("<:c>",)]),
    ("SELECT ?o { :b :knows? ?o }", [("<:b>",), ("<:c>",)]),
    ("SELECT ?o { :a :knows/:knows ?o }", [("<:a>",), ("<:c>",)]),
    ("SELECT ?o { :c ^:knows ?o }", [("<:a>",), ("<:b>",)]),
    ("SELECT ?o { :b !(:knows|a|:name|:age) ?o }", [("<mailto:b>",)]),
    ("SELECT ?o { :b !(^:name) ?o }", [("<:a>",)]),
    ("SELECT ?x { :zzz :knows* ?x }", [("<:zzz>",)]),
    ("SELECT ?n { ?s :part/:name ?n }", [('"arm"',)]),
    ("SELECT ?s { ?s a :Person FILTER EXISTS { ?s :knows ?k . ?k :mail ?m } }", [("<:a>",)]),
    ("SELECT ?s { ?s :age ?a FILTER NOT EXISTS { ?t :age ?b FILTER(?b < ?a) } }", [("<:c>",), ("<:e>",)]),
    ("SELECT ?x { VALUES (?x ?y) { (1 2) (UNDEF 3) } }", [(f'"1"{INT}',), (None,)]),
    ("SELECT REDUCED ?a { VALUES ?a { 0 0 1 1 0 0 } }", [(f'"0"{INT}',), (f'"0"{INT}',), (f'"1"{INT}',)]),
    ("SELECT ?a { { SELECT ?a { VALUES ?a { 1 1 2 } } } INTERSECT { SELECT ?a { VALUES ?a { 1 3 } } } }", [(f'"1"{INT}',), (f'"1"{INT}',)]),
    ("SELECT ?a { VALUES ?a { 1 2 3 } FILTER(?a > ANY (SELECT ?b { VALUES ?b { 2 9 } })) }", [(f'"3"{INT}',)]),
    ("SELECT ?a { VALUES ?a { 1 2 3 } FILTER(?a >= ALL (SELECT ?b { VALUES ?b { 2 3 } })) }", [(f'"3"{INT}',)]),
    ("SELECT ?a { VALUES ?a { 1 2 } FILTER(?a >= ALL (SELECT ?b { ?b :none ?c })) }", [(f'"1"{INT}',), (f'"2"{INT}',)]),
    ("SELECT ?n { ?s :name ?n FILTER(?n LIKE \"*E*\" IGNORE CASE) }", [('"Dee"',), ('"Eve"',)]),
    ("SELECT ?n { ?s :name ?n } ORDER BY DESC(?n) LIMIT 2 OFFSET 1", [('"Dee"',), ('"Eve"',)]),
    ("SELECT DISTINCT ?t { ?s a ?t }", [("<:Person>",), ("<:Robot>",)]),
    ("SELECT ?n { { SELECT ?s { ?s a :Person } ORDER BY ?s LIMIT 1 } ?s :name ?n }", [('"Ann"',)]),
    ("SELECT ?x { BIND(IF(1/0, 1, 2) AS ?x) }", [(None,)]),
    ("SELECT ?x { BIND(COALESCE(?u, 1/0, 5) AS ?x) }", [(f'"5"{INT}',)]),
    ("SELECT ?x { BIND(STRDT(\"5\", xsd:byte) AS ?x) }", [(f'"5"^^<{XSD}byte>',)]),
    ("SELECT ?x { BIND(REPLACE(\"abcabc\", \"B\", \"-\", \"i\") AS ?x) }", [('"a-ca-c"',)]),
    ("SELECT ?x { BIND(CONCAT(\"a\"@en, \"b\"@en) AS ?x) }", [('"ab"@en',)]),
    ("SELECT ?x { BIND(ENCODE_FOR_URI(\"a b/ü*~\") AS ?x) }", [('"a%20b%2F%C3%BC%2A~"',)]),
    ("SELECT ?x { BIND(ROUND(-2.5) AS ?x) }", [(f'"-2.0"^^<{XSD}decimal>',)]),
    ("SELECT ?x { BIND(xsd:integer(\"3.7\") AS ?x) BIND(xsd:double(\"1e3\") AS ?y) }", [(None,)]),
    ("SELECT ?x { BIND(LOCALNAME(<urn:q#z>) AS ?x) }", [('"z"',)]),
    ("SELECT ?d { :a :name ?d BIND(1 AS ?q) } HAVING(?q = 1)", [('"Ann"',)]),
    ("SELECT ?s { ?s :nick \"ann*\"^^<urn:quadframe:search> }", [("<:a>",)]),
    ("SELECT ?s ?o { { ?s :mail ?o } UNION { ?s :weight ?o } }", [("<:b>", "<mailto:b>"), ("<:d>", f'"1.5"^^<{XSD}decimal>')]),
    ("SELECT ?k { :a :knows ?k OPTIONAL { ?k :mail ?m } OPTIONAL { ?k :mail ?m2 } FILTER(!BOUND(?m)) }", [("<:c>",)]),
    ("SELECT ?x { VALUES ?x { 1 } FILTER(?x = 1.0) }", [(f'"1"{INT}',)]),
    ("SELECT ?s { ?s :age 30 }", [("<:a>",)]),
    ("SELECT ?s { ?s :age 30.0 }", []),  # another term
])
def test_select(engine, text, want):
    assert rows(engine, "PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> " + text) == sorted(want, key=str)


def test_ask_construct_describe(engine):
    assert engine.ask("ASK { :a :knows :b }") and not engine.ask("ASK { :b :knows :a }")
    got = rows(engine, "CONSTRUCT { ?k :known ?s . ?s :age ?nothing . _:x :of ?s } WHERE { ?s :knows ?k FILTER(?s = :b) OPTIONAL { ?s :nick ?nothing } }")
    assert [r[1:] for r in got if r[0].startswith("_:")] == [("<:of>", "<:b>")] and ("<:c>", "<:known>", "<:b>") in got and len(got) == 2
    got = rows(engine, "DESCRIBE :d")
    assert any(r[0].startswith("_:") and r[2] == '"arm"' for r in got) and len(got) == 6


def test_federation(spark, engine):
    other = Dataset.from_quads(spark, [(IRI("urn:x/b"), IRI("urn:x/rank"), Literal("9", XSD + "integer"))])
    e = Engine(spark, engine.dataset, {"other": other})
    assert rows(e, "SELECT ?s ?r { ?s :mail ?m SERVICE <urn:quadframe:other> { ?s :rank ?r } }") == [("<:b>", f'"9"{INT}')]
    assert rows(e, "SELECT ?g ?r { SERVICE ?g { ?s :rank ?r } }") == [("<urn:quadframe:other>", f'"9"{INT}')]
    assert len(rows(e, "SELECT ?s { ?s :mail ?m SERVICE SILENT <urn:quadframe:no> { ?s :rank ?r } }")) == 1
    with pytest.raises(ValueError):
        rows(e, "SELECT ?s { SERVICE <http://elsewhere/> { ?s :rank ?r } }")


def test_rows_from_outside(spark, engine):
    df = spark.createDataFrame([("<urn:x/a>", 1), ("<urn:x/b>", 2), ("<urn:x/none>", 3)], "s string, rank long")
    assert rows(engine, "SELECT ?n ?rank { ?s :name ?n } ORDER BY ?n", bindings=df) == [('"Ann"', f'"1"{INT}'), ('"Bob"', f'"2"{INT}')]
    assert rows(engine, "SELECT (COUNT(*) AS ?n) { ?s :knows ?k }", bindings=df) == [(f'"3"{INT}',)]


def test_functions_of_users(engine):
    register_function("urn:f", lambda v: plain(lexical(v)))
    assert rows(engine, "SELECT ?x { BIND(<urn:f>(:a) AS ?x) }") == [('":a"',)]
    unregister_function("urn:f")
    with pytest.raises(UnknownFunction):
        rows(engine, "SELECT ?x { BIND(<urn:f>(:a) AS ?x) }")


@pytest.mark.parametrize("text", ["SELECT", "SELECT ?x { ?x }", "SELECT * { ?s ?p ?o", "ASK { BIND(1 AS ?x) BIND(2 AS ?x) }", "SELECT ?x { ?x nope:y 1 }"])
def test_faults(text):
    with pytest.raises((SyntaxFault, ValueError)):
        parse_query(text)


def test_updates_parse():
    ops = parse_update("PREFIX : <u:> INSERT DATA { :a :b 1 } ; DELETE WHERE { ?s :b ?o } ; WITH :g DELETE { ?s ?p ?o } USING :h WHERE { ?s ?p ?o } ; MOVE :a TO DEFAULT ; LOAD SILENT <f.ttl> INTO GRAPH :g ; CREATE GRAPH :z")
    assert [u.kind for u in ops] == ["DATA", "MODIFY", "MODIFY", "MOVE", "LOAD", "CREATE"]


@pytest.mark.parametrize("text", ['"a\\"b\\n"', '"x"@en', f'"1"^^<{XSD}int>', "<urn:a>", "_:b1"])
def test_terms_round_trip(text):
    assert parse_term(text).n3() == text


def test_order_of_kinds(engine):
    got = [r[0] for r in engine.query("SELECT ?x { VALUES ?x { \"b\" 3 <urn:a> 2.5 UNDEF \"a\" } } ORDER BY ?x", as_terms=True).collect()]
    assert got[0] is None and got[1] == "<urn:a>" and got.index('"2.5"^^<http://www.w3.org/2001/XMLSchema#decimal>') < got.index(f'"3"{INT}')


@pytest.mark.parametrize("n", [10, 100, 5000])
def test_path_fan_out(spark, n):
    p = IRI("urn:p")
    d = Dataset.from_quads(spark, [(IRI("urn:root"), p, IRI(f"urn:c{i}")) for i in range(n)] + [(IRI(f"urn:c{n - 1}"), p, IRI("urn:end"))])
    assert Engine(spark, d).ask("ASK { <urn:root> <urn:p>* <urn:end> }")


def test_long_chain_and_cycle_on_the_cluster(spark, monkeypatch):
    from quadframe.operators import paths

    monkeypatch.setattr(paths, "DRIVER_EDGES", 3)
    p = IRI("urn:p")
    chain = Dataset.from_quads(spark, [(IRI(f"urn:{i}"), p, IRI(f"urn:{(i + 1) % 40}")) for i in range(40)])
    assert Engine(spark, chain).query("SELECT * { ?a <urn:p>+ ?b }").count() == 1600
    few = Dataset.from_quads(spark, [(IRI(f"urn:{i}"), p, IRI(f"urn:{i + 1}")) for i in range(6)])
    assert Engine(spark, few).query("SELECT * { <urn:2> <urn:p>+ ?b }").count() == 4


def test_doubling_writes_each_pair_once(spark, monkeypatch):
    from quadframe.operators import paths

    staged = []
    monkeypatch.setattr(paths, "DRIVER_EDGES", 3)
    monkeypatch.setattr(paths, "ROWS_DEALT", 500, raising=False)
    stage = paths.stage
    monkeypatch.setattr(paths, "stage", lambda df, name: staged.append(stage(df, name)) or staged[-1])
    monkeypatch.setattr(paths, "unstage", lambda *frames: None)
    p = IRI("urn:p")
    tree = [(k, k // 2) for k in range(2, 300)]
    more = [(k, k + 2000) for k in range(2, 9)] + [(2003, 2004), (2005, 2003)]  # several ways to a node, and a cycle
    for edges in (tree, tree + more + [(2008, 2)]):
        after, want, staged[:] = {}, set(), []
        for a, b in edges:
            after.setdefault(a, []).append(b)
        for a in after:
            seen, front = set(), [a]
            while front:
                front = [y for x in front for y in after.get(x, ()) if y not in seen and not seen.add(y)]
            want |= {(f"<urn:{a}>", f"<urn:{y}>") for y in seen}
        d = Dataset.from_quads(spark, [(IRI(f"urn:{a}"), p, IRI(f"urn:{b}")) for a, b in edges])
        got = [tuple(r) for r in Engine(spark, d).query("SELECT ?a ?b { ?a <urn:p>+ ?b }", as_terms=True).collect()]
        assert len(got) == len(want) and set(got) == want
        if edges is tree:
            assert sum(x.count() for x in staged) < 2 * len(want)


def test_count_distinct_of_equal_rows(spark, tmp_path):
    """Rows of lineitem that agree in order, line, part and quantity are rows for themselves, as in its SQL."""
    import duckdb

    from quadframe.plans.queries import all_queries

    own = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(50)
    own.unionByName(own.limit(20)).write.parquet(str(tmp_path / "lineitem.parquet"))
    run, sql = all_queries()["q28_count_distinct"]
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        want = c.sql(sql).fetchall()
    assert [tuple(r) for r in run(spark, str(tmp_path)).collect()] == want and want[0][1] == 70


def test_fork_law_and_hash(spark):
    d = Dataset.from_quads(spark, [(IRI(f"urn:{i}"), IRI("urn:p"), Literal(f"v{i}")) for i in range(50)])
    parts = [{r[0] for r in Engine(spark, d).query("SELECT ?s { ?s <urn:p> ?o FILTER(<urn:quadframe:forkAndFilterBy>(3, ?o)) }", fork=i).collect()} for i in range(3)]
    assert sum(map(len, parts)) == len(set().union(*parts)) == 50
    text = "SELECT ?i { VALUES ?x { \"hello\" } FILTER(<urn:quadframe:forkAndFilterBy>(3, ?x)) BIND(1 AS ?i) }"
    assert [Engine(spark, d).query(text, fork=i).count() for i in range(3)] == [0, 0, 1]


# joins on variables that may be unbound

def _values(rows, names):
    cell = lambda x: "UNDEF" if x is None else str(x)
    return f"VALUES ({' '.join('?' + n for n in names)}) {{ {' '.join('(' + ' '.join(map(cell, r)) + ')' for r in rows)} }}"


def _compatible(x, y):
    return all(x[n] is None or y[n] is None or x[n] == y[n] for n in x.keys() & y.keys())


def _joined(x, y):
    return {n: x.get(n) if x.get(n) is not None else y.get(n) for n in x.keys() | y.keys()}


@pytest.mark.parametrize("seed", range(2))
def test_unbound_joins_match_brute_force(spark, seed):
    import random

    r = random.Random(seed)
    names_a, names_b = ("u", "v", "x"), ("u", "v", "y")
    draw = lambda: [tuple(r.choice([None, 1, 2, 3]) for _ in range(2)) + (k,) for k in range(5)]
    rows_a, rows_b = draw(), draw()
    a, b = ([dict(zip(n, row)) for row in own] for n, own in ((names_a, rows_a), (names_b, rows_b)))
    left, right = _values(rows_a, names_a), _values(rows_b, names_b)
    e = Engine(spark, Dataset(spark))
    more = lambda x, y: x["x"] <= y["y"]
    want = {
        "join": (f"{left} {right}", [_joined(x, y) for x in a for y in b if _compatible(x, y)]),
        "optional": (f"{left} OPTIONAL {{ {right} }}", [z for x in a for z in [_joined(x, y) for y in b if _compatible(x, y)] or [x]]),
        "optional if": (f"{left} OPTIONAL {{ {right} FILTER(?x <= ?y) }}", [z for x in a for z in [_joined(x, y) for y in b if _compatible(x, y) and more(x, y)] or [x]]),
        "minus": (f"{left} MINUS {{ {right} }}", [x for x in a if not any(_compatible(x, y) and any(x[n] is not None and y[n] is not None for n in "uv") for y in b)]),
        "exists": (f"{left} FILTER EXISTS {{ {right} }}", [x for x in a if any(_compatible(x, y) for y in b)]),
        "exists if": (f"{left} FILTER EXISTS {{ {right} FILTER(?x <= ?y) }}", [x for x in a if any(_compatible(x, y) and more(x, y) for y in b)]),
        "not exists": (f"{left} FILTER NOT EXISTS {{ {right} FILTER(?x <= ?y) }}", [x for x in a if not any(_compatible(x, y) and more(x, y) for y in b)]),
        "exists or": (f"{left} FILTER(?x = 0 || EXISTS {{ {right} FILTER(?x <= ?y) }})", [x for x in a if x["x"] == 0 or any(_compatible(x, y) and more(x, y) for y in b)]),
    }
    for name, (text, rows_wanted) in want.items():
        got = [tuple(row.asDict().get(n) for n in "uvxy") for row in e.query(f"SELECT * {{ {text} }}").collect()]
        assert sorted(got, key=str) == sorted((tuple(z.get(n) for n in "uvxy") for z in rows_wanted), key=str), name


def test_joins_have_keys(spark, engine):
    for text in ("?s :age ?a OPTIONAL { ?s :mail ?m } OPTIONAL { ?t :mail ?m }", "?s :age ?a OPTIONAL { ?s :mail ?m } MINUS { ?t :mail ?m }", "?s :age ?a OPTIONAL { ?s :mail ?m } FILTER EXISTS { ?t :mail ?m ; :name ?s }"):
        plan = engine.query(f"SELECT * {{ {text} }}")._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Join" in line and " OR " in line], text
    plan = engine.query("SELECT ?s { ?s :age ?a BIND(STR(?a) AS ?b) FILTER(?b = ANY (SELECT ?d { ?t :age ?c BIND(STR(?c) AS ?d) })) }")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_relative_iris(spark):
    from quadframe.terms import resolve

    for base in ("http://h/a/b", "http://h", "http://h/a/b?q=1#f", "http://h/a/b/"):
        for ref in ("", "x", "/x", "../c", "./d", "../../../e", "#f", "?q", "//other/z", "x/..", "x/.", "urn:abs", "g?y/../x", "a/../b#s/../x"):
            got = Engine(spark, Dataset(spark)).query(f'BASE <{base}> SELECT (IRI("{ref}") AS ?x) {{}}').first()[0]
            assert got == resolve(base, ref), (base, ref)
