"""SPARQL functions over typed columns. Unknown functions are an error of the whole query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import INTEGERS, QF, RDF, XSD
from .values import NUMBERS, V, is_literal, is_plain, lexical, null, number, rank, t_is, t_tail, tail, time, to_term


class UnknownFunction(ValueError):
    pass


#: Functions by IRI: called with the argument values, return a value.
REGISTRY: dict[str, Callable[..., V]] = {}


def register_function(iri: str, build: Callable[..., V]) -> None:
    """Make `build(*values) -> V` callable in queries as <iri>(...)."""
    REGISTRY[iri] = build


def unregister_function(iri: str) -> None:
    REGISTRY.pop(iri, None)


def text(v: V) -> Column:
    """Lexical form of a string literal (plain or with a language), else null."""
    if v.kind == "lit" and v.extra is None:
        return v.col
    if v.kind == "lit":
        return F.when((v.extra == "") | F.startswith(v.extra, F.lit("@")), v.col)
    if v.kind == "term":
        t = t_tail(v.col)
        return F.when(t_is(v.col, '"') & ((t == "") | F.startswith(t, F.lit("@"))), lexical(v))
    return F.lit(None).cast("string")


def _tag(v: V) -> Column:
    return tail(v) if v.kind == "lit" else t_tail(to_term(v))


def _fits(a: V, b: V) -> Column:
    """Argument compatibility: the second plain, or of the first's language."""
    if is_plain(b):
        return F.lit(True)
    return (_tag(b) == "") | (_tag(a) == _tag(b))


def plain(c: Column) -> V:
    return V("lit", c)


def boolean(c: Column) -> V:
    return V("boolean", c)


def _like(v: V, c: Column) -> V:
    return V("lit", c, None if is_plain(v) else _tag(v))


def _two(f: Callable[[Column, Column], Column]) -> Callable[[V, V], V]:
    return lambda a, b: boolean(F.when(_fits(a, b), f(text(a), text(b))))


def regex_flags(pattern: Column, flags: V | None) -> Column:
    if flags is None:
        return pattern
    f = text(flags)
    good = F.regexp_replace(F.replace(f, F.lit("i"), F.lit("iu")), "[^smiuxd]", "")
    return F.when(f == "", pattern).when(f.rlike("^[smixdu]+$"), F.concat(F.lit("(?"), good, F.lit(")"), pattern))


def _regex(a: V, p: V, flags: V | None = None) -> V:
    return boolean(F.regexp_like(text(a), regex_flags(text(p), flags)))


def _replace(a: V, p: V, r: V, flags: V | None = None) -> V:
    return _like(a, F.regexp_replace(text(a), regex_flags(text(p), flags), text(r)))


def _substr(a: V, start: V, length: V | None = None) -> V:
    s, at = text(a), F.round(number(start)).cast("int")
    if length is None:
        return _like(a, F.substr(s, F.greatest(at, F.lit(1))))
    end = at + F.round(number(length)).cast("int")
    first = F.greatest(at, F.lit(1))
    return _like(a, F.substr(s, first, F.greatest(end - first, F.lit(0))))


def _before(a: V, b: V) -> V:
    s, p = text(a), text(b)
    at = F.position(p, s)
    hit = at > 0
    cut = F.when(hit, F.substr(s, F.lit(1), at - 1)).otherwise("")
    return V("lit", F.when(_fits(a, b), cut), None if is_plain(a) else None if is_plain(a) else F.when(hit, _tag(a)).otherwise(""))


def _after(a: V, b: V) -> V:
    s, p = text(a), text(b)
    at = F.position(p, s)
    hit = at > 0
    cut = F.when(hit, F.substr(s, at + F.length(p))).otherwise("")
    return V("lit", F.when(_fits(a, b), cut), None if is_plain(a) else None if is_plain(a) else F.when(hit, _tag(a)).otherwise(""))


def _concat(*vs: V) -> V:
    if not vs:
        return plain(F.lit(""))
    if all(map(is_plain, vs)):
        return plain(F.concat(*[v.col for v in vs]))
    tags = [_tag(v) for v in vs]
    same = F.lit(True)
    for t in tags[1:]:
        same = same & (t == tags[0])
    return V("lit", F.concat(*[text(v) for v in vs]), F.when(same, tags[0]).otherwise(""))


def _number(f: Callable[[Column], Column]) -> Callable[[V], V]:
    def run(v: V) -> V:
        if v.kind == "integer":
            return v if f is not F.abs else V("integer", F.abs(v.col))
        n = number(v)
        if n is None:
            return null()
        return V(v.kind, f(n).cast("double")) if v.kind in NUMBERS else V("num", f(n).cast("double"), rank(v))

    return run


_PARTS = r"^-?(\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?(Z|[+-]\d\d:\d\d)?$"


def _part(k: int, native: Callable[[Column], Column], kind: str = "integer") -> Callable[[V], V]:
    def run(v: V) -> V:
        if v.kind in ("dateTime", "date"):
            return V(kind, native(v.col).cast("long" if kind == "integer" else "double"))
        found = F.regexp_extract(F.when(time(v).isNotNull(), lexical(v)) if time(v) is not None else F.lit(None), _PARTS, k)
        return V(kind, found.try_cast("long" if kind == "integer" else "double"))

    return run


def _zone(v: V) -> Column:
    if v.kind in ("dateTime", "date"):
        return F.when(v.col.isNotNull(), "")
    return F.regexp_extract(F.when(time(v).isNotNull(), lexical(v)), _PARTS, 7) if time(v) is not None else F.lit(None).cast("string")


def _timezone(v: V) -> V:
    z = _zone(v)
    hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    sign = F.when(F.startswith(z, F.lit("-")), "-").otherwise("")
    h = F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise("")
    m = F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise("")
    body = F.when((hours == 0) & (minutes == 0), "PT0S").otherwise(F.concat(sign, F.lit("PT"), h, m))
    return V("lit", F.when(z == "Z", "PT0S").when(z != "", body), F.lit(f"^^<{XSD}dayTimeDuration>"))


def _seconds(c: Column) -> Column:
    return F.second(c) + F.date_format(c, "SSSSSS").cast("double") / 1e6


def _hash(f: Callable[[Column], Column]) -> Callable[[V], V]:
    return lambda v: plain(f(F.encode(text(v), "utf-8")))


def _datatype(v: V) -> V:
    if v.kind == "term" or v.kind == "lit":
        t = _tag(v)
        name = F.when(t == "", XSD + "string").when(F.startswith(t, F.lit("@")), RDF + "langString").otherwise(F.regexp_extract(t, "<(.*)>", 1))
        return V("iri", F.when(is_literal(v), name))
    if v.kind in ("iri", "bnode"):
        return V("iri", F.lit(None).cast("string"))
    return V("iri", F.when(v.col.isNotNull(), F.regexp_extract(tail(v), "<(.*)>", 1)))


def _lang(v: V) -> V:
    if v.kind in ("iri", "bnode"):
        return null()
    if v.kind in ("lit", "term"):
        return plain(F.when(is_literal(v), F.regexp_extract(_tag(v), "^@(.*)$", 1)))
    return plain(F.when(v.col.isNotNull(), ""))


def _langmatches(a: V, b: V) -> V:
    tag, want = F.lower(text(a)), F.lower(text(b))
    return boolean(F.when(want == "*", tag != "").otherwise((tag == want) | F.startswith(tag, F.concat(want, F.lit("-")))))


def _is(kind: str) -> Callable[[V], V]:
    first = {"iri": "<", "bnode": "_", "literal": '"'}[kind]

    def run(v: V) -> V:
        own = "literal" if v.kind not in ("iri", "bnode", "term") else v.kind
        return boolean(F.when(v.col.isNotNull(), t_is(v.col, first) if own == "term" else F.lit(own == kind)))

    return run


def _isnumeric(v: V) -> V:
    if v.kind in NUMBERS or v.kind == "num":
        return boolean(F.when(v.col.isNotNull(), F.lit(True)))
    n = number(v)
    return boolean(F.when(v.col.isNotNull(), F.lit(False) if n is None else n.isNotNull()))


def _split(keep: int) -> Callable[[V], V]:
    def run(v: V) -> V:
        iri = F.when(t_is(to_term(v), "<"), lexical(v))
        head = F.when(F.contains(iri, F.lit("#")), F.regexp_extract(iri, r"^(.*#)", 1)).when(F.contains(iri, F.lit("/")), F.regexp_extract(iri, r"^(.*/)", 1)).otherwise(F.regexp_extract(iri, r"^(.*:)", 1))
        return V("iri", head) if keep == 0 else plain(F.substr(iri, F.length(head) + 1))

    return run


def _cast(name: str) -> Callable[[V], V]:
    def run(v: V) -> V:
        s = F.trim(lexical(v)) if v.kind not in ("iri",) else (v.col if name == "string" else F.lit(None).cast("string"))
        n = number(v)
        if name == "string":
            return plain(lexical(v))
        if name == "boolean":
            if v.kind == "boolean":
                return v
            by_text = F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False)
            return boolean(by_text if n is None else F.coalesce(F.when(n.isNotNull(), (n != 0) & ~F.isnan(n)), by_text))
        if name == "dateTime":
            return v if v.kind == "dateTime" else V("lit", F.when(s.rlike(r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$") & s.try_cast("timestamp").isNotNull(), s), F.lit(f"^^<{XSD}dateTime>"))
        from_bool = F.when(v.col, 1.0).otherwise(0.0) if v.kind == "boolean" else None
        shape = {"integer": r"^[+-]?\d+$", "decimal": r"^[+-]?(\d+(\.\d*)?|\.\d+)$"}.get(name, r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$|^[+-]?INF$|^NaN$")
        by_text = F.when(s.rlike(shape), F.regexp_replace(s, "INF", "Infinity").try_cast("double"))
        value = F.when(v.col.isNotNull(), from_bool) if from_bool is not None else by_text if n is None else F.coalesce(n, by_text)
        if name == "integer":
            if v.kind == "integer":
                return v
            exact = F.when(s.rlike(shape), s.try_cast("long"))
            return V("integer", F.coalesce(exact, F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))))
        return V(name, value)

    return run


def _strdt(a: V, dt: V) -> V:
    ok = F.when(_tag(a) == "", text(a))
    return V("lit", ok, F.concat(F.lit("^^<"), lexical(dt), F.lit(">")))


def utf16(code: Column) -> Column:
    """The one or two UTF-16 units of a character's code, as an array."""
    beyond = code - 0x10000
    return F.when(code > 0xFFFF, F.array(F.shiftright(beyond, 10) + 0xD800, beyond.bitwiseAND(F.lit(0x3FF)) + 0xDC00)).otherwise(F.array(code))


def _fork_hash(v: V) -> Column:
    """The 32-bit string hash of a term's text: for each UTF-16 unit, h = 31 h + unit, wrapping."""
    codes = F.flatten(F.transform(F.split(lexical(v), ""), lambda c: utf16(F.ascii(c).cast("long"))))
    wrap = lambda x: F.pmod(x + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))


def fork(index: int, n: V, *vs: V) -> V:
    """True iff the arguments' joint hash falls to fork `index` of n; n is part of the hash."""
    wrap = lambda x: F.pmod(x + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)
    h = F.lit(1).cast("long")
    for v in (n, *vs):
        h = wrap(h * 31 + _fork_hash(v))
    return boolean(F.pmod(h, n.col.cast("long")) == index)


LIBRARY: dict[str, Callable[..., V]] = {
    "STR": lambda v: plain(lexical(v)), "LABEL": lambda v: plain(F.when(is_literal(v), lexical(v))), "LANG": _lang, "LANGMATCHES": _langmatches, "DATATYPE": _datatype,
    "NAMESPACE": _split(0), "LOCALNAME": _split(1),
    "ISIRI": _is("iri"), "ISURI": _is("iri"), "ISBLANK": _is("bnode"), "ISLITERAL": _is("literal"), "ISNUMERIC": _isnumeric,
    "ISRESOURCE": lambda v: boolean(~_is("literal")(v).col),
    "REGEX": _regex, "REPLACE": _replace, "STRLEN": lambda v: V("integer", F.length(text(v)).cast("long")), "SUBSTR": _substr,
    "UCASE": lambda v: _like(v, F.upper(text(v))), "LCASE": lambda v: _like(v, F.lower(text(v))),
    "STRSTARTS": _two(F.startswith), "STRENDS": _two(F.endswith), "CONTAINS": _two(F.contains), "STRBEFORE": _before, "STRAFTER": _after, "CONCAT": _concat,
    "ENCODE_FOR_URI": lambda v: plain(F.replace(F.replace(F.replace(F.url_encode(text(v)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))),
    "STRDT": _strdt, "STRLANG": lambda a, b: V("lit", F.when(_tag(a) == "", text(a)), F.concat(F.lit("@"), F.lower(text(b)))),
    "UUID": lambda: V("iri", F.concat(F.lit("urn:uuid:"), F.uuid())), "STRUUID": lambda: plain(F.uuid()),
    "ABS": _number(F.abs), "CEIL": _number(F.ceil), "FLOOR": _number(F.floor), "ROUND": _number(lambda c: F.floor(c + 0.5)), "RAND": lambda: V("double", F.rand()),
    "YEAR": _part(1, F.year), "MONTH": _part(2, F.month), "DAY": _part(3, F.day), "HOURS": _part(4, F.hour), "MINUTES": _part(5, F.minute), "SECONDS": _part(6, _seconds, "decimal"),
    "TIMEZONE": _timezone, "TZ": lambda v: plain(_zone(v)),
    "MD5": _hash(F.md5), "SHA1": _hash(F.sha1), "SHA256": _hash(lambda c: F.sha2(c, 256)), "SHA384": _hash(lambda c: F.sha2(c, 384)), "SHA512": _hash(lambda c: F.sha2(c, 512)),
}
CASTS = {XSD + n: _cast(n) for n in ("boolean", "integer", "decimal", "float", "double", "string", "dateTime")} | {d: _cast("integer") for d in INTEGERS}
FORK_IRI = QF + "forkAndFilterBy"
