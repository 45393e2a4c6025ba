"""Readers of RDF documents: text in, quads of terms out. Line formats are also read by Spark itself."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import quote

from ..plans.algebra import Pattern
from ..plans.parser import Parser, SyntaxFault
from ..terms import OWL, RDF, RDFS, XSD, BNode, IRI, Literal, parse_term, resolve, unescape

Quad = tuple[Any, Any, Any, Any]
_XML = "http://www.w3.org/XML/1998/namespace"


class Turtle(Parser):
    """Turtle, TriG and N3's Turtle part."""

    def __init__(self, text: str, base: str | None = None):
        super().__init__(text, base)
        self.prefixes = {}

    def quads_of(self, document_graph: Any = None) -> Iterator[Quad]:
        while self.kind != "end":
            if self.kind == "lang" or self.peek("PREFIX", "BASE"):
                word = self.next().lstrip("@").upper()
                if word == "PREFIX":
                    name = self.next()[:-1]
                    self.prefixes[name] = resolve(self.base, unescape(self.next()[1:-1]))
                elif word == "BASE":
                    self.base = resolve(self.base, unescape(self.next()[1:-1]))
                else:
                    raise SyntaxFault(f"unknown directive {word}")
                self.take(".")
                continue
            if self.take("GRAPH"):
                yield from self.block(self.term(data=True))
            elif self.peek("{"):
                yield from self.block(None)
            else:
                out: list = []
                s = self.node(out, document_graph, True)
                if self.peek("{"):
                    yield from self.block(s)
                    continue
                if not (out and self.peek(".")):
                    self.properties(s, out, document_graph, True)
                self.need(".")
                yield from _plain(out)

    def block(self, graph: Any) -> Iterator[Quad]:
        self.need("{")
        out: list = []
        self.quads(out, graph)
        yield from _plain(out)


def _plain(out: list) -> Iterator[Quad]:
    for p in out:
        if not isinstance(p, Pattern):
            raise SyntaxFault("a path is no statement")
        yield p.s, p.p, p.o, p.g


def read_turtle(text: str, base: str | None = None, prefixes: dict[str, str] | None = None) -> Iterator[Quad]:
    """prefixes: gets the document's, while it is read."""
    reader = Turtle(text, base)
    if prefixes is not None:
        reader.prefixes = prefixes
    return reader.quads_of()


_LINE = re.compile(r'\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?')


def read_lines(text: str, base: str | None = None) -> Iterator[Quad]:
    for line in text.splitlines():
        if line.strip() and not line.lstrip().startswith("#"):
            yield read_line(line)


def read_line(line: str) -> Quad:
    m = _LINE.fullmatch(line)
    if not m:
        raise SyntaxFault(f"not a statement: {line[:60]!r}")
    s, p, o, g = (None if t is None else parse_term(t) for t in m.groups())
    return s, p, o, g


def read_rdfxml(text: str, base: str | None = None, prefixes: dict[str, str] | None = None) -> Iterator[Quad]:
    root = ET.fromstring(text)
    if prefixes is not None:
        prefixes |= {name: uri for _, (name, uri) in ET.iterparse(io.StringIO(text), ["start-ns"])}
    count = iter(range(1 << 60))
    out: list[Quad] = []
    rdf = f"{{{RDF}}}"

    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1)

    def subject(el: ET.Element, at: str | None) -> Any:
        if (v := el.get(rdf + "about")) is not None:
            return IRI(resolve(at, v) if v else (at or ""))
        if v := el.get(rdf + "ID"):
            return IRI(resolve(at, "#" + v))
        if v := el.get(rdf + "nodeID"):
            return BNode(v)
        return BNode(f"x{next(count)}")

    def attributes(el: ET.Element, s: Any, lang: str) -> None:
        for k, v in el.attrib.items():
            if k == rdf + "type":
                out.append((s, IRI(RDF + "type"), IRI(v), None))
            elif not k.startswith((rdf, f"{{{_XML}}}")) and k.startswith("{"):
                out.append((s, IRI(name(k)), Literal(v, RDF + "langString", lang) if lang else Literal(v), None))

    def node(el: ET.Element, at: str | None, lang: str) -> Any:
        at, lang = el.get(f"{{{_XML}}}base", at), el.get(f"{{{_XML}}}lang", lang).lower()
        s = subject(el, at)
        if el.tag != rdf + "Description":
            out.append((s, IRI(RDF + "type"), IRI(name(el.tag)), None))
        attributes(el, s, lang)
        item = 0
        for child in el:
            p = name(child.tag)
            if child.tag == rdf + "li":
                item += 1
                p = f"{RDF}_{item}"
            prop(child, s, IRI(p), at, lang)
        return s

    def prop(el: ET.Element, s: Any, p: IRI, at: str | None, lang: str) -> None:
        at, lang = el.get(f"{{{_XML}}}base", at), el.get(f"{{{_XML}}}lang", lang).lower()
        kind = el.get(rdf + "parseType")
        if kind == "Resource":
            o = BNode(f"x{next(count)}")
            for child in el:
                prop(child, o, IRI(name(child.tag)), at, lang)
        elif kind == "Collection":
            o = IRI(RDF + "nil")
            for item in reversed([node(c, at, lang) for c in el]):
                cell = BNode(f"x{next(count)}")
                out.extend([(cell, IRI(RDF + "first"), item, None), (cell, IRI(RDF + "rest"), o, None)])
                o = cell
        elif kind == "Literal":
            o = Literal((el.text or "") + "".join(ET.tostring(c, "unicode") for c in el), RDF + "XMLLiteral")
        elif (v := el.get(rdf + "resource")) is not None:
            o = IRI(resolve(at, v) if v else (at or ""))
            attributes(el, o, lang)
        elif v := el.get(rdf + "nodeID"):
            o = BNode(v)
        elif len(el):
            o = node(el[0], at, lang)
        elif dt := el.get(rdf + "datatype"):
            o = Literal(el.text or "", resolve(at, dt))
        elif any(k.startswith("{") and not k.startswith((rdf, f"{{{_XML}}}")) for k in el.attrib):
            o = BNode(f"x{next(count)}")
            attributes(el, o, lang)
        else:
            o = Literal(el.text or "", RDF + "langString", lang) if lang else Literal(el.text or "")
        out.append((s, p, o, None))

    base = root.get(f"{{{_XML}}}base", base)
    lang = root.get(f"{{{_XML}}}lang", "")
    for el in root if root.tag == rdf + "RDF" else [root]:
        node(el, base, lang)
    yield from out


def read_trix(text: str, base: str | None = None) -> Iterator[Quad]:
    def local(el: ET.Element) -> str:
        return el.tag.rsplit("}", 1)[-1]

    def term(el: ET.Element) -> Any:
        kind, value = local(el), (el.text or "")
        if kind == "uri":
            return IRI(value.strip())
        if kind == "id":
            return BNode(value.strip())
        if kind == "typedLiteral":
            return Literal(value, el.get("datatype"))
        lang = el.get(f"{{{_XML}}}lang")
        return Literal(value, RDF + "langString", lang.lower()) if lang else Literal(value)

    for graph in ET.fromstring(text):
        g = None
        for el in graph:
            if local(el) == "triple":
                s, p, o = map(term, el)
                yield s, p, o, g
            else:
                g = term(el)


def read_rdfjson(text: str, base: str | None = None) -> Iterator[Quad]:
    def resource(x: str) -> Any:
        return BNode(x[2:]) if x.startswith("_:") else IRI(x)

    for s, props in json.loads(text).items():
        for p, objects in props.items():
            for o in objects:
                if o["type"] == "literal":
                    t = Literal(o["value"], RDF + "langString", o["lang"].lower()) if o.get("lang") else Literal(o["value"], o.get("datatype", XSD + "string"))
                else:
                    t = resource(o["value"])
                for g in o.get("graphs", [None]):
                    yield resource(s), IRI(p), t, None if g is None or g == "null" else resource(g)


class JsonLd:
    """JSON-LD 1.0 expansion to quads, with inline contexts (remote ones cannot be fetched here)."""

    def __init__(self, base: str | None = None):
        self.base, self.out, self.n = base, [], 0

    def blank(self) -> BNode:
        self.n += 1
        return BNode(f"j{self.n}")

    def context(self, ctx: dict, new: Any) -> dict:
        out = dict(ctx)
        for c in new if isinstance(new, list) else [new]:
            if c is None:
                out = {}
            elif isinstance(c, str):
                raise SyntaxFault(f"remote context {c}")
            else:
                out.update(c)
        return out

    def iri(self, ctx: dict, x: str, vocab: bool = False, depth: int = 0) -> str:
        if x.startswith("@") or depth > 20:
            return x
        if vocab and x in ctx:
            d = ctx[x]
            d = d.get("@id", x) if isinstance(d, dict) else d
            if d is None or d == x:
                return d or ""
            return self.iri(ctx, d, True, depth + 1)
        head, colon, rest = x.partition(":")
        if colon and not rest.startswith("//") and head in ctx and head != "_":
            return self.iri(ctx, head, True, depth + 1) + rest
        if colon:
            return x
        if vocab and "@vocab" in ctx:
            return ctx["@vocab"] + x
        return resolve(ctx.get("@base", self.base), x) if not vocab else ""

    def resource(self, x: str) -> Any:
        return BNode(x[2:]) if x.startswith("_:") else IRI(x)

    def value(self, ctx: dict, v: Any, d: dict, g: Any) -> Any:
        if isinstance(v, dict):
            v2 = {self.iri(ctx, k, True) or k: x for k, x in v.items()}
            if "@value" in v2:
                raw = v2["@value"]
                if "@language" in v2:
                    return Literal(raw, RDF + "langString", v2["@language"].lower())
                return self.literal(raw, self.iri(ctx, v2["@type"], True) if "@type" in v2 else None)
            if "@list" in v2:
                return self.listed(ctx, v2["@list"], d, g)
            return self.node(ctx, v, g)
        kind = d.get("@type")
        if isinstance(v, str) and kind in ("@id", "@vocab"):
            return self.resource(self.iri(ctx, v, kind == "@vocab"))
        lang = d.get("@language", ctx.get("@language")) if isinstance(v, str) and not kind else None
        if lang:
            return Literal(v, RDF + "langString", lang.lower())
        return self.literal(v, self.iri(ctx, kind, True) if kind else None)

    @staticmethod
    def literal(v: Any, dt: str | None) -> Literal:
        if isinstance(v, bool):
            return Literal(str(v).lower(), dt or XSD + "boolean")
        if isinstance(v, int) or isinstance(v, float) and v == int(v) and dt != XSD + "double" and abs(v) < 1e21:
            return Literal(str(int(v)), dt or XSD + "integer")
        if isinstance(v, float):
            return Literal(re.sub(r"(\.\d*?)0*E", r"\1E", f"{v:.15E}").replace(".E", ".0E").replace("E+0", "E").replace("E-0", "E-").replace("E+", "E"), dt or XSD + "double")
        return Literal(v, dt or XSD + "string")

    def listed(self, ctx: dict, items: Any, d: dict, g: Any) -> Any:
        o: Any = IRI(RDF + "nil")
        for v in reversed([self.value(ctx, x, d, g) for x in (items if isinstance(items, list) else [items])]):
            cell = self.blank()
            self.out += [(cell, IRI(RDF + "first"), v, g), (cell, IRI(RDF + "rest"), o, g)]
            o = cell
        return o

    def node(self, ctx: dict, obj: dict, g: Any) -> Any:
        if "@context" in obj:
            ctx = self.context(ctx, obj["@context"])
        keys = [(k, self.iri(ctx, k, True), v) for k, v in obj.items() if k != "@context"]
        given = next((v for _, k, v in keys if k == "@id"), None)
        s = self.resource(self.iri(ctx, given)) if given is not None else self.blank()
        for k, p, v in keys:
            if p == "@type":
                self.out += [(s, IRI(RDF + "type"), self.resource(self.iri(ctx, t, True) or self.iri(ctx, t)), g) for t in (v if isinstance(v, list) else [v])]
            elif p == "@graph":
                own = g if given is None and len(keys) == 1 else s
                for x in v if isinstance(v, list) else [v]:
                    self.node(ctx, x, own)
            elif p == "@reverse":
                for q, xs in v.items():
                    for x in xs if isinstance(xs, list) else [xs]:
                        self.out.append((self.value(ctx, x, {"@type": "@id"}, g), IRI(self.iri(ctx, q, True)), s, g))
            elif p and not p.startswith("@") and ":" in p and v is not None:
                d = ctx.get(k) if isinstance(ctx.get(k), dict) else {}
                box = d.get("@container")
                if box == "@list":
                    self.out.append((s, IRI(p), self.listed(ctx, v, d, g), g))
                    continue
                if box == "@language" and isinstance(v, dict):
                    v = [{"@value": t, "@language": lang} for lang, ts in v.items() for t in (ts if isinstance(ts, list) else [ts])]
                elif box == "@index" and isinstance(v, dict):
                    v = [t for ts in v.values() for t in (ts if isinstance(ts, list) else [ts])]
                for x in v if isinstance(v, list) else [v]:
                    if x is not None:
                        o = self.value(ctx, x, d, g)
                        back = d.get("@reverse")
                        self.out.append((o, IRI(self.iri(ctx, back, True)), s, g) if back else (s, IRI(p), o, g))
        return s


def read_jsonld(text: str, base: str | None = None, prefixes: dict[str, str] | None = None) -> Iterator[Quad]:
    reader = JsonLd(base)
    root = json.loads(text)
    if prefixes is not None:
        for x in root if isinstance(root, list) else [root]:
            own = x.get("@context") if isinstance(x, dict) else None
            for c in own if isinstance(own, list) else [own]:
                prefixes |= {k: v for k, v in c.items() if isinstance(v, str) and v[-1:] in "/#:" and k[:1] != "@"} if isinstance(c, dict) else {}
    for x in root if isinstance(root, list) else [root]:
        reader.node({}, x, None)
    return iter(reader.out)


def read_ndjsonld(text: str, base: str | None = None) -> Iterator[Quad]:
    """Every line is a document of its own; blank nodes are too."""
    for k, line in enumerate(x for x in text.splitlines() if x.strip()):
        for q in read_jsonld(line, base):
            yield tuple(BNode(f"l{k}{t.label}") if isinstance(t, BNode) else t for t in q)


class _Number(str):
    """A number of JSON as it is written."""


def _digest(value: Any) -> bytes:
    """Canonical bytes of a JSON value: l items e, d sorted keys and values e, strings with their length;
    numbers, true, false and null leave none."""
    if isinstance(value, list):
        return b"l" + b"".join(map(_digest, value)) + b"e"
    if isinstance(value, dict):
        return b"d" + b"".join(_digest(k) + _digest(value[k]) for k in sorted(value, key=lambda s: s.encode("utf-16-be"))) + b"e"
    if isinstance(value, str):
        raw = value.encode()
        return str(len(raw)).encode() + b":" + raw
    return b""


def read_json(text: str, base: str | None = None, data: bool = True, ontology: bool = False) -> Iterator[Quad]:
    """Plain JSON: an object, or objects in an array, as a tree of nodes named by the object's hash."""
    root = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number)
    base = base or "urn:json:"
    a = IRI(RDF + "type")
    if ontology:
        yield IRI(base), a, IRI(OWL + "Ontology"), None
    for top in root if isinstance(root, list) else [root]:
        if not isinstance(top, dict):
            raise SyntaxFault("the root is neither an object nor objects in an array")
        name = base64.urlsafe_b64encode(hashlib.sha512(_digest(top)).digest()).decode().rstrip("=")
        # (node, its place below the parent, path of predicates, label, index in its array, value)
        todo: list[tuple] = [(None, None, base + name, "", None, None, top)]
        while todo:
            parent, owner, place, path, label, index, value = todo.pop()
            link, kind = IRI(base + path), IRI(f"{base}{path}:Node")
            if isinstance(value, list):
                todo += reversed([(parent, owner, f"{place}:{i}", path, label, i, x) for i, x in enumerate(value)])
                continue
            if not isinstance(value, dict):
                if ontology and path:
                    yield link, a, IRI(OWL + "DatatypeProperty"), None
                    yield link, IRI(RDFS + "label"), Literal(label), None
                    yield link, IRI(RDFS + "domain"), owner, None
                if data and isinstance(value, str):
                    yield parent, link, Literal(str(value)), None
                continue
            me = IRI((parent.value if parent else "") + place)
            made = [(me, a, kind, None)] if data else []
            known = [(kind, a, IRI(RDFS + "Class"), None)]
            if parent:
                made += [(parent, link, me, None)] if data else []
                known += [(link, a, IRI(OWL + "ObjectProperty"), None), (link, IRI(RDFS + "label"), Literal(label), None), (link, IRI(RDFS + "domain"), owner, None), (link, IRI(RDFS + "range"), kind, None)]
            if index is not None:
                number = IRI(f"{base}{path}:index")
                made += [(me, number, Literal(str(index), XSD + "integer"), None)] if data else []
                known += [(number, a, IRI(OWL + "DatatypeProperty"), None), (number, IRI(RDFS + "label"), Literal("index"), None), (number, IRI(RDFS + "domain"), kind, None)]
            yield from made + (known if ontology else [])
            fields = []
            for key, x in value.items():
                step = quote(key, safe="!$&'()*+,;=-_~@/?").replace(".", "%2E").replace(":", "%3A")
                fields.append((me, kind, "." + step, f"{path}.{step}" if path else step, key, None, x))
            todo += reversed(fields)


#: Reader by file extension.
READERS: dict[str, Callable[..., Iterator[Quad]]] = {
    ".nt": read_lines, ".nq": read_lines, ".ttl": read_turtle, ".n3": read_turtle, ".trig": read_turtle,
    ".rdf": read_rdfxml, ".rdfs": read_rdfxml, ".owl": read_rdfxml, ".xml": read_rdfxml, ".trix": read_trix,
    ".rj": read_rdfjson, ".jsonld": read_jsonld, ".ndjsonld": read_ndjsonld, ".json": read_json,
}


#: Extensions whose readers report prefixes.
WITH_PREFIXES = {".ttl", ".n3", ".trig", ".rdf", ".rdfs", ".owl", ".xml", ".jsonld"}


def register_format(extension: str, reader: Callable[..., Iterator[Quad]]) -> None:
    READERS[extension] = reader
    WITH_PREFIXES.discard(extension)
