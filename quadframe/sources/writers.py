"""Sinks of query results and quads: CSV, RDF formats, JDBC, and a dry run."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from xml.sax.saxutils import escape as xml_escape
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.library import utf16
from ..terms import RDF, XSD, BNode, IRI, Literal, parse_term

_TABLE = re.compile(r"[a-zA-Z_0-9.]+")
RDF_EXTENSIONS = (".nt", ".nq", ".ttl", ".trig", ".n3", ".rdf", ".rdfs", ".owl", ".xml", ".trix", ".rj", ".jsonld")
#: Quads of one document of the formats that Spark does not write itself.
DOCUMENT_QUADS = 100_000
_CODECS = {".gz": "gzip", ".bz2": "bzip2"}


class ExportFault(ValueError):
    pass


def csv_cell(c: Column) -> Column:
    """A value as this engine's CSV has it: quotes doubled inside quotes, line ends, backslashes and
    characters beyond plain ASCII as escapes of their UTF-16 units, commas and the empty string quoted, null as nothing."""
    s = c.cast("string")
    text = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for a, b in (("\n", "\\n"), ("\r", "\\r"), ('"', '""')):
        text = F.replace(text, F.lit(a), F.lit(b))
    unit = lambda u: F.concat(F.lit("\\u"), F.lpad(F.hex(u), 4, "0"))
    hexed = lambda x: F.array_join(F.transform(utf16(F.ascii(x).cast("long")), unit), "")
    odd = r"[^\x20-\x7E]"
    coded = F.array_join(F.transform(F.split(text, ""), lambda x: F.when(x.rlike(odd), hexed(x)).otherwise(x)), "")
    text = F.when(text.rlike(odd), coded).otherwise(text)
    quoted = F.contains(s, F.lit('"')) | F.contains(s, F.lit(",")) | (s == "")
    return F.coalesce(F.when(quoted, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text), F.lit(""))


def write_csv(df: DataFrame, path: str, codec: str | None = None, mode: str = "error") -> None:
    """One line per row under path, each file headed by the column names. Rows stay where they are."""
    names = df.columns
    line = F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in names])
    w = df.select(line.alias(",".join(names))).write.mode(mode).option("header", True).option("quote", "\x02").option("escape", "\x02").option("sep", "\x01").option("emptyValue", "")
    (w.option("compression", codec) if codec else w).csv(path)


def write_lines(quads: DataFrame, path: str, with_graph: bool, codec: str | None = None, mode: str = "error") -> None:
    """N-Triples or N-Quads, by Spark alone."""
    cells = [F.col("s"), F.col("p"), F.col("o"), *([F.col("g")] if with_graph and "g" in quads.columns else []), F.lit(".")]
    w = quads.select(F.concat_ws(" ", *cells).alias("value")).write.mode(mode)
    (w.option("compression", codec) if codec else w).text(path)


def serialise(ext: str, quads: Iterator[tuple]) -> str:
    """Quads of terms as one document of a format; Turtle-like and XML formats write terms in full."""
    rows = list(quads)
    if ext in (".ttl", ".n3", ".nt"):
        return "".join(f"{s.n3()} {p.n3()} {o.n3()} .\n" for s, p, o, _ in rows)
    if ext == ".nq":
        return "".join(f"{s.n3()} {p.n3()} {o.n3()} {g.n3() + ' ' if g else ''}.\n" for s, p, o, g in rows)
    by_graph: dict = {}
    for s, p, o, g in rows:
        by_graph.setdefault(g, []).append((s, p, o))
    if ext == ".trig":
        return "".join((f"{g.n3()} " if g else "") + "{\n" + "".join(f"  {s.n3()} {p.n3()} {o.n3()} .\n" for s, p, o in own) + "}\n" for g, own in by_graph.items())
    if ext in (".rdf", ".rdfs", ".owl", ".xml"):
        return '<?xml version="1.0" encoding="UTF-8"?>\n' + f'<rdf:RDF xmlns:rdf="{RDF}">\n' + "".join(_rdfxml(*r[:3]) for r in rows) + "</rdf:RDF>\n"
    if ext == ".trix":
        body = "".join("<graph>" + (_trix(g) if g else "") + "".join("<triple>" + "".join(map(_trix, t)) + "</triple>\n" for t in own) + "</graph>\n" for g, own in by_graph.items())
        return f'<?xml version="1.0" encoding="UTF-8"?>\n<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/">\n{body}</TriX>\n'
    if ext == ".rj":
        out: dict = {}
        for s, p, o, g in rows:
            cell = {"type": "literal", "value": o.lex, **({"lang": o.lang} if o.lang else {"datatype": o.dt})} if isinstance(o, Literal) else {"type": "uri" if isinstance(o, IRI) else "bnode", "value": _name(o)}
            if g:
                cell["graphs"] = [_name(g)]
            out.setdefault(_name(s), {}).setdefault(p.value, []).append(cell)
        return json.dumps(out, ensure_ascii=False)
    if ext == ".jsonld":
        docs = []
        for g, own in by_graph.items():
            nodes: dict = {}
            for s, p, o in own:
                v = {"@id": _name(o)} if not isinstance(o, Literal) else {"@value": o.lex, **({"@language": o.lang} if o.lang else {} if o.dt == XSD + "string" else {"@type": o.dt})}
                nodes.setdefault(_name(s), {"@id": _name(s)}).setdefault(p.value, []).append(v)
            docs += list(nodes.values()) if g is None else [{"@id": _name(g), "@graph": list(nodes.values())}]
        return json.dumps(docs, ensure_ascii=False)
    raise ExportFault(f"no writer for {ext}")


def _name(t) -> str:
    return t.value if isinstance(t, IRI) else t.n3()


def _rdfxml(s, p: IRI, o) -> str:
    cut = re.search(r"[A-Za-z_][\w.\-]*$", p.value)
    if not cut or not cut.start():
        raise ExportFault(f"{p.value} cannot be an XML name")
    about = f'rdf:about={quoteattr(s.value)}' if isinstance(s, IRI) else f'rdf:nodeID="{s.label}"'
    tag, ns = cut[0], p.value[: cut.start()]
    if isinstance(o, Literal):
        extra = f' xml:lang="{o.lang}"' if o.lang else "" if o.dt == XSD + "string" else f" rdf:datatype={quoteattr(o.dt)}"
        inner = f"<n:{tag} xmlns:n={quoteattr(ns)}{extra}>{xml_escape(o.lex)}</n:{tag}>"
    else:
        inner = f"<n:{tag} xmlns:n={quoteattr(ns)} " + (f"rdf:resource={quoteattr(o.value)}" if isinstance(o, IRI) else f'rdf:nodeID="{o.label}"') + "/>"
    return f"<rdf:Description {about}>{inner}</rdf:Description>\n"


def _trix(t) -> str:
    if isinstance(t, IRI):
        return f"<uri>{xml_escape(t.value)}</uri>"
    if isinstance(t, BNode):
        return f"<id>{xml_escape(t.label)}</id>"
    if t.lang:
        return f'<plainLiteral xml:lang="{t.lang}">{xml_escape(t.lex)}</plainLiteral>'
    return f"<plainLiteral>{xml_escape(t.lex)}</plainLiteral>" if t.dt == XSD + "string" else f"<typedLiteral datatype={quoteattr(t.dt)}>{xml_escape(t.lex)}</typedLiteral>"


def write_rdf(quads: DataFrame, path: str, codec: str | None = None, mode: str = "error") -> None:
    """A folder of documents of the path's format, of at most DOCUMENT_QUADS quads each; line formats by Spark
    alone."""
    ext = os.path.splitext(path[: -len(".bz2")] if path.endswith(".bz2") else path[: -len(".gz")] if path.endswith(".gz") else path)[1]
    if ext in (".nt", ".nq"):
        return write_lines(quads, path, ext == ".nq", codec, mode)
    if ext not in RDF_EXTENSIONS:
        raise ExportFault(f"no writer for {ext}")
    from ..ship import ship

    ship(quads.sparkSession)
    cols = quads.select("s", "p", "o", F.col("g") if "g" in quads.columns else F.lit(None).cast("string").alias("g"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def document(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([serialise(ext, iter(rows))])], names=["value"])

        held: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                held.append(tuple(None if t is None else parse_term(t) for t in r))
                if len(held) == DOCUMENT_QUADS:
                    yield document(held)
                    held = []
        if held:
            yield document(held)

    w = cols.mapInArrow(run, "value string").write.mode(mode).option("lineSep", "\n").option("maxRecordsPerFile", 1)
    return (w.option("compression", codec) if codec else w).text(path)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None, truncate: bool = False) -> None:
    """Appends rows in batches of 1000; values take the types of the target's columns of their names."""
    if not _TABLE.fullmatch(table):
        raise ExportFault(f"illegal table name {table!r}")
    spark, props = df.sparkSession, dict(properties or {})
    try:
        target = {n.lower(): t for n, t in spark.read.jdbc(url, table, properties=props).dtypes}
        df = df.select(*[F.col(f"`{c}`").try_cast(target[c.lower()]).alias(c) if c.lower() in target else F.col(f"`{c}`") for c in df.columns])
    except Exception as fault:
        if "not found" not in str(fault).lower() and "does not exist" not in str(fault).lower():
            raise
    df.write.jdbc(url, table, mode="overwrite" if truncate else "append", properties=props | {"batchsize": "1000", "truncate": "true"})


def export(engine: Engine, query: str, target: str, jdbc: dict | None = None, truncate: bool = False, fork: int = 0, mode: str = "error") -> int | None:
    """Query results to null: (counts them), *.csv, an RDF extension, each with .gz or .bz2, or jdbc:url/table."""
    q = engine.parse(query)
    if q.form == "ASK":
        raise ExportFault("an ASK query has no rows to export")
    df = engine.query(q, fork=fork, as_text=True)
    if target.startswith("null:"):
        return df.count()
    codec = _CODECS.get(os.path.splitext(target)[1])
    ext = os.path.splitext(os.path.splitext(target)[0] if codec else target)[1]
    if target.startswith("jdbc:"):
        if q.form != "SELECT":
            raise ExportFault("only SELECT goes to JDBC")
        url, _, table = target.rpartition("/")
        return write_jdbc(df, url, table, jdbc, truncate)
    if ext == ".csv":
        if q.form != "SELECT":
            raise ExportFault("only SELECT goes to CSV")
        return write_csv(df, target, codec, mode)
    if ext in RDF_EXTENSIONS:
        if q.form == "SELECT":
            raise ExportFault("only CONSTRUCT and DESCRIBE go to RDF")
        return write_rdf(df, target, codec, mode)
    raise ExportFault(f"unsupported target {target}")


def bulk_export(engine: Engine, queries: dict[str, str], target: str, forks: int = 1, **options) -> list[str]:
    """Every query, by name, to target with {0} its name and {1} the fork, forks run one after another."""
    if "{0}" not in target:
        raise ExportFault("the target needs {0}, the query's name")
    out = []
    for name, text in queries.items():
        for i in range(forks):
            own = target.replace("{0}", name).replace("{1}", str(i))
            export(engine, text, own, fork=i, **options)
            out.append(own)
    return out
