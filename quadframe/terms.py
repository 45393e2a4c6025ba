"""RDF terms in Python, and their N-Triples text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urljoin

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
VOID = "http://rdfs.org/ns/void#"
VOID_EXT = "http://ldf.fi/void-ext#"
SD = "http://www.w3.org/ns/sparql-service-description#"
#: Vocabulary of this engine: statistics and system graphs, forks, text search, federation.
QF = "urn:quadframe:"
#: A dataset clause with this IRI means statements without a graph.
NIL = "http://www.openrdf.org/schema/sesame#nil"

INTEGERS = tuple(XSD + n for n in "integer long int short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte".split())
NUMERIC = (*INTEGERS, XSD + "decimal", XSD + "float", XSD + "double")


@dataclass(frozen=True)
class IRI:
    value: str

    def n3(self) -> str:
        return f"<{escape(self.value, iri=True)}>"


@dataclass(frozen=True)
class BNode:
    label: str

    def n3(self) -> str:
        return f"_:{self.label}"


@dataclass(frozen=True)
class Literal:
    lex: str
    dt: str = XSD + "string"
    lang: str = ""

    def n3(self) -> str:
        tail = f"@{self.lang}" if self.lang else "" if self.dt == XSD + "string" else f"^^<{self.dt}>"
        return f'"{escape(self.lex)}"{tail}'


@dataclass(frozen=True)
class Var:
    name: str


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_BACK = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def escape(s: str, iri: bool = False) -> str:
    if iri:
        return re.sub(r'[\x00-\x20<>"{}|^`\\]', lambda m: f"\\u{ord(m[0]):04X}", s)
    return re.sub(r'[\\"\n\r\t]', lambda m: _ESCAPES[m[0]], s)


def unescape(s: str) -> str:
    if "\\" not in s:
        return s
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _BACK.get(m[1], m[1]), s)


_TERM = re.compile(r'<([^<>"{}|^`\x00-\x20]*)>|_:([^\s<>"]+?)(?=[\s.]*$|[\s<"])|"((?:[^"\\]|\\.)*)"(?:\^\^<([^<>\s]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?', re.S)


def parse_term(text: str) -> IRI | BNode | Literal:
    m = _TERM.fullmatch(text.strip())
    if not m:
        raise ValueError(f"not an RDF term: {text!r}")
    return _of(m)


def _of(m: re.Match) -> IRI | BNode | Literal:
    if m[1] is not None:
        return IRI(unescape(m[1]))
    if m[2] is not None:
        return BNode(m[2])
    if m[5]:
        return Literal(unescape(m[3]), RDF + "langString", m[5].lower())
    return Literal(unescape(m[3]), m[4] or XSD + "string")


def resolve(base: str | None, iri: str) -> str:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) or not base:
        return iri
    if not iri or iri.startswith("#"):
        return base.partition("#")[0] + iri
    out = urljoin(base, iri)
    return out + "#" if iri.endswith("#") and not out.endswith("#") else out
