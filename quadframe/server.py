"""SPARQL protocol over HTTP: queries by GET and POST, stored queries, and content negotiation."""

from __future__ import annotations

import json
import re
import threading
import traceback
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse
from xml.sax.saxutils import escape

from .engine import Engine
from .plans.parser import SyntaxFault
from .sources.writers import serialise
from .terms import XSD, BNode, IRI, Literal, parse_term

SELECT_TYPES = {".csv": "text/csv", ".tsv": "text/tab-separated-values", ".srj": "application/sparql-results+json", ".srx": "application/sparql-results+xml"}
GRAPH_TYPES = {".nt": "application/n-triples", ".ttl": "text/turtle", ".rdf": "application/rdf+xml", ".jsonld": "application/ld+json", ".trix": "application/trix", ".rj": "application/rdf+json", ".nq": "application/n-quads", ".trig": "application/trig"}


class BadRequest(ValueError):
    pass


def _json(names, rows) -> str:
    def cell(t):
        if isinstance(t, IRI):
            return {"type": "uri", "value": t.value}
        if isinstance(t, BNode):
            return {"type": "bnode", "value": t.label}
        extra = {"xml:lang": t.lang} if t.lang else {} if t.dt == XSD + "string" else {"datatype": t.dt}
        return {"type": "literal", "value": t.lex, **extra}

    return json.dumps({"head": {"vars": names}, "results": {"bindings": [{n: cell(t) for n, t in zip(names, r) if t is not None} for r in rows]}}, ensure_ascii=False)


def _xml(names, rows) -> str:
    def cell(t):
        if isinstance(t, IRI):
            return f"<uri>{escape(t.value)}</uri>"
        if isinstance(t, BNode):
            return f"<bnode>{t.label}</bnode>"
        extra = f' xml:lang="{t.lang}"' if t.lang else "" if t.dt == XSD + "string" else f' datatype="{escape(t.dt)}"'
        return f"<literal{extra}>{escape(t.lex)}</literal>"

    head = "".join(f'<variable name="{n}"/>' for n in names)
    body = "".join("<result>" + "".join(f'<binding name="{n}">{cell(t)}</binding>' for n, t in zip(names, r) if t is not None) + "</result>" for r in rows)
    return f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>{head}</head><results>{body}</results></sparql>'


def _csv(names, rows) -> str:
    def cell(t):
        v = "" if t is None else t.lex if isinstance(t, Literal) else t.value if isinstance(t, IRI) else t.n3()
        return '"' + v.replace('"', '""') + '"' if re.search('[",\r\n]', v) else v

    return "".join(",".join(r) + "\r\n" for r in [names, *([cell(t) for t in row] for row in rows)])


def _tsv(names, rows) -> str:
    return "".join("\t".join(r) + "\n" for r in [[f"?{n}" for n in names], *(["" if t is None else t.n3() for t in row] for row in rows)])


_TABLES = {"text/csv": _csv, "text/tab-separated-values": _tsv, "application/sparql-results+json": _json, "application/sparql-results+xml": _xml}


def negotiate(types: dict[str, str], path: str, accept: str, default: str) -> str:
    """By the path's extension, then by Accept (with q), else the default."""
    ext = "." + path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else ""
    if ext in types:
        return types[ext]
    wanted = []
    for part in accept.split(","):
        name, *params = [x.strip() for x in part.split(";")]
        q = next((float(p[2:]) for p in params if p.startswith("q=") and re.fullmatch(r"[\d.]+", p[2:])), 1.0)
        wanted.append((-q, name))
    for _, name in sorted(wanted, key=lambda x: x[0]):
        if name in types.values():
            return name
    return default


class Handler(BaseHTTPRequestHandler):
    engine: Engine
    stored: dict[str, str] = {}
    protocol_version = "HTTP/1.1"

    def log_message(self, *args) -> None:
        pass

    def do_GET(self) -> None:
        self.answer("GET")

    def do_POST(self) -> None:
        self.answer("POST")

    def do_PUT(self) -> None:
        self.send(400, "text/plain", "only GET and POST")

    do_DELETE = do_HEAD = do_PATCH = do_OPTIONS = do_PUT

    def send(self, code: int, kind: str, text: str) -> None:
        body = text.encode()
        self.send_response(code)
        self.send_header("Content-Type", f"{kind}; charset=utf-8")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def answer(self, method: str) -> None:
        try:
            self.send(200, *self.result(method))
        except (BadRequest, ValueError, SyntaxFault) as fault:
            self.send(400, "text/plain", str(fault))
        except Exception:
            self.send(500, "text/plain", traceback.format_exc())

    def result(self, method: str) -> tuple[str, str]:
        url = urlparse(self.path)
        params = parse_qs(url.query, keep_blank_values=True)
        length = int(self.headers.get("Content-Length") or 0)
        if method == "GET":
            if length:
                raise BadRequest("GET takes no body")
        else:
            kind, _, rest = (self.headers.get("Content-Type") or "").partition(";")
            charset = re.search(r"charset=([\w-]+)", rest)
            if charset and charset[1].lower() != "utf-8":
                raise BadRequest("the charset must be UTF-8")
            body = self.rfile.read(length).decode()
            if kind.strip() == "application/x-www-form-urlencoded":
                for k, v in parse_qs(body, keep_blank_values=True).items():
                    params.setdefault(k, []).extend(v)
            elif kind.strip() == "application/sparql-query":
                params.setdefault("query", []).append(body)
            else:
                raise BadRequest(f"unsupported content type {kind!r}")
        template = self.stored.get(url.path.strip("/")) or self.stored.get(url.path.strip("/").rsplit(".", 1)[0])
        if template is not None:
            text = re.sub(r"\{\{([^{}]+)\}\}", lambda m: params[m[1]][0] if m[1] in params else m[0], template)
            if left := re.search(r"\{\{[^{}]+\}\}", text):
                raise BadRequest(f"missing parameter {left[0]}")
        else:
            given = params.get("query", [])
            if len(given) != 1:
                raise BadRequest("exactly one query is needed")
            text = given[0]
        q = self.engine.parse(text)
        default, named = params.get("default-graph-uri", []), params.get("named-graph-uri", [])
        if default or named:
            q.default_graphs, q.named_graphs, q.has_dataset = default, named, True
        accept = self.headers.get("Accept") or ""
        if q.form == "ASK":
            truth = bool(self.engine.query(q).first()[0])
            kind = negotiate({k: v for k, v in SELECT_TYPES.items() if k in (".srj", ".srx")}, url.path, accept, SELECT_TYPES[".srj"])
            if kind.endswith("xml"):
                return kind, f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>{str(truth).lower()}</boolean></sparql>'
            return kind, json.dumps({"head": {}, "boolean": truth})
        df = self.engine.query(q, as_terms=True)
        rows = [[None if t is None else parse_term(t) for t in r] for r in df.toLocalIterator()]
        if q.form == "SELECT":
            kind = negotiate(SELECT_TYPES, url.path, accept, SELECT_TYPES[".csv"])
            return kind, _TABLES[kind](df.columns, rows)
        kind = negotiate(GRAPH_TYPES, url.path, accept, GRAPH_TYPES[".nt"])
        ext = next(e for e, v in GRAPH_TYPES.items() if v == kind)
        return kind, serialise(ext, ((*r, None) for r in rows))


class Server:
    """with Server(engine) as s: ... s.port"""

    def __init__(self, engine: Engine, port: int = 0, stored: dict[str, str] | None = None):
        handler = type("Bound", (Handler,), {"engine": engine, "stored": stored or {}})
        self.http = ThreadingHTTPServer(("127.0.0.1", port), handler)
        self.port = self.http.server_address[1]

    def __enter__(self) -> Server:
        self.thread = threading.Thread(target=self.http.serve_forever, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *exc) -> None:
        self.http.shutdown()
        self.http.server_close()


def stored_queries(path: str) -> dict[str, str]:
    """name=query lines of a properties file; a value @file is read beside it."""
    import os

    out = {}
    for line in open(path, encoding="utf-8"):
        if line.strip() and not line.lstrip().startswith(("#", "!")):
            name, _, value = line.strip().partition("=")
            if value.startswith("@"):
                value = open(os.path.join(os.path.dirname(path), value[1:]), encoding="utf-8").read()
            out[name.strip()] = value.strip()
    return out
