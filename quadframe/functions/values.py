"""Typed values of expressions as Spark columns, and their conversion to term text.

Kinds: iri, bnode, integer, decimal, float, double, boolean, dateTime, date (native columns); lit (lexical
form, and a tail column: '' or '@lang' or '^^<datatype>'); num (double, and a rank column for its
datatype); term (N-Triples text, known only row by row). NULL is unbound or an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import INTEGERS, NUMERIC, XSD, BNode, IRI, Literal

NUMBERS = ("integer", "decimal", "float", "double")


@dataclass
class V:
    kind: str
    col: Column
    extra: Any = None  # lit: tail, None where there is none; num: rank; iri: (prefix, key column) of a mapped key


def null() -> V:
    return V("lit", F.lit(None).cast("string"))


def unescaped(c: Column) -> Column:
    out = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\x00", "\\")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(F.contains(c, F.lit("\\")), out).otherwise(c)


def escaped(c: Column) -> Column:
    out = c
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def t_is(t: Column, first: str) -> Column:
    return F.substring(t, 1, 1) == first


def is_plain(v: V) -> bool:
    """Known, whatever the row, to be a literal without language or datatype."""
    return v.kind == "lit" and v.extra is None


def _cut(t: Column) -> Column:
    """Length of a literal's term text up to its closing quote."""
    return F.length(t) - F.length(t_tail(t))


def t_tail(t: Column) -> Column:
    return F.regexp_extract(t, r'"(@[A-Za-z0-9-]+|\^\^<[^<>"]*>)?$', 1)


def t_lex(t: Column) -> Column:
    return F.when(t_is(t, '"'), unescaped(F.substr(t, F.lit(2), _cut(t) - 2)))


def t_datatype(t: Column) -> Column:
    tail = t_tail(t)
    typed = F.when(tail == "", XSD + "string").when(F.startswith(tail, F.lit("@")), "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").otherwise(F.regexp_extract(tail, r"<(.*)>", 1))
    return F.when(t_is(t, '"'), typed)


def t_number(t: Column) -> Column:
    return F.when(t_datatype(t).isin(*NUMERIC), F.trim(t_lex(t)).try_cast("double"))


def t_rank(t: Column) -> Column:
    dt = t_datatype(t)
    return F.when(dt.isin(*INTEGERS), 0).when(dt == XSD + "decimal", 1).when(dt == XSD + "float", 2).when(dt == XSD + "double", 3)


def t_time(t: Column) -> Column:
    return F.when(t_datatype(t).isin(XSD + "dateTime", XSD + "date"), t_lex(t).try_cast("timestamp"))


def constant(t: IRI | BNode | Literal) -> V:
    if isinstance(t, IRI):
        return V("iri", F.lit(t.value))
    if isinstance(t, BNode):
        return V("bnode", F.lit("_:" + t.label))
    try:
        if t.dt == XSD + "integer" and abs(int(t.lex)) < 1 << 63:
            return V("integer", F.lit(int(t.lex)).cast("long"))
        if t.dt == XSD + "decimal":
            return V("decimal", F.lit(float(t.lex)))
        if t.dt in (XSD + "double", XSD + "float"):
            return V(t.dt[len(XSD) :], F.lit(float(t.lex.replace("INF", "inf"))))
    except ValueError:
        pass
    if t.dt == XSD + "boolean" and t.lex in ("true", "false", "1", "0"):
        return V("boolean", F.lit(t.lex in ("true", "1")))
    if t.dt in (XSD + "dateTime", XSD + "date"):
        return V("lit", F.lit(t.lex), F.lit(f"^^<{t.dt}>"))
    if t.lang:
        return V("lit", F.lit(t.lex), F.lit("@" + t.lang))
    return V("lit", F.lit(t.lex), None if t.dt == XSD + "string" else F.lit(f"^^<{t.dt}>"))


def lexical(v: V) -> Column:
    """STR(): lexical form or IRI text; null for blank nodes."""
    k = v.kind
    if k in ("iri", "lit"):
        return v.col
    if k == "bnode":
        return F.lit(None).cast("string")
    if k == "term":
        return F.when(t_is(v.col, "<"), F.substr(v.col, F.lit(2), F.length(v.col) - 2)).otherwise(t_lex(v.col))
    if k == "num":
        return F.when(v.extra == 0, v.col.cast("decimal(38,0)").cast("string")).when(v.extra == 1, _decimal(v.col)).otherwise(_double(v.col))
    if k == "decimal":
        return _decimal(v.col)
    if k in ("float", "double"):
        return _double(v.col)
    if k == "dateTime":
        whole = F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss")
        part = F.rtrim(F.date_format(v.col, "SSSSSS"), F.lit("0"))
        return F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
    return v.col.cast("string")


def _decimal(c: Column) -> Column:
    s = c.cast("decimal(38,12)").cast("string")
    return F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"(\.\d+?)0+$", "$1")).otherwise(F.concat(s, F.lit(".0")))


def _double(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s == "Infinity", "INF").when(s == "-Infinity", "-INF").when(F.contains(s, F.lit("E")) | (s == "NaN"), s).otherwise(F.concat(s, F.lit("E0")))


def tail(v: V) -> Column:
    """What follows the quoted lexical form."""
    if v.kind == "lit":
        return F.lit("") if v.extra is None else v.extra
    if v.kind == "num":
        return F.element_at(F.array(*[F.lit(f"^^<{XSD}{n}>") for n in NUMBERS]), v.extra.cast("int") + 1)
    return F.lit(f"^^<{XSD}{v.kind}>")


def to_term(v: V) -> Column:
    if v.kind == "term" or v.kind == "bnode":
        return v.col
    if v.kind == "iri":
        return F.concat(F.lit("<"), v.col, F.lit(">"))
    text = escaped(v.col) if v.kind == "lit" else lexical(v)
    return F.concat(F.lit('"'), text, F.lit('"'), tail(v))


def is_literal(v: V) -> Column:
    return F.when(v.col.isNotNull(), t_is(v.col, '"') if v.kind == "term" else F.lit(v.kind not in ("iri", "bnode")))


def number(v: V) -> Column | None:
    """As double; None where the kind is never a number."""
    if v.kind in NUMBERS:
        return v.col.cast("double")
    if v.kind == "num":
        return v.col
    if v.kind == "term":
        return t_number(v.col)
    if v.kind == "lit":
        return None if v.extra is None else F.when(F.regexp_extract(v.extra, "<(.*)>", 1).isin(*NUMERIC), F.trim(v.col).try_cast("double"))
    return None


def rank(v: V) -> Column:
    if v.kind in NUMBERS:
        return F.lit(NUMBERS.index(v.kind))
    return v.extra if v.kind == "num" else t_rank(to_term(v))


def time(v: V) -> Column | None:
    if v.kind in ("dateTime", "date"):
        return v.col.cast("timestamp")
    if v.kind == "term" or (v.kind == "lit" and v.extra is not None):
        return t_time(to_term(v))
    return None


def ebv(v: V) -> Column:
    k, c = v.kind, v.col
    if k == "boolean":
        return c
    if k in NUMBERS or k == "num":
        return F.when(c.isNotNull(), (c != 0) & ~F.isnan(c.cast("double")))
    if k in ("iri", "bnode", "dateTime", "date"):
        return F.lit(None).cast("boolean")
    if is_plain(v):
        return F.length(c) > 0
    t = to_term(v)
    dt, lex = t_datatype(t), t_lex(t)
    n = t_number(t)
    string = F.when(dt.isin(XSD + "string", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"), F.length(lex) > 0)
    return F.when(dt == XSD + "boolean", lex.isin("true", "1")).when(dt.isin(*NUMERIC), F.coalesce((n != 0) & ~F.isnan(n), F.lit(False))).otherwise(string)


def sort_keys(v: V) -> list[Column]:
    """Unbound, blank nodes, IRIs, literals; literals by value, then text."""
    if v.kind in ("integer", "decimal", "float", "double", "boolean", "dateTime", "date"):
        return [v.col]
    if v.kind in ("iri", "bnode"):
        return [v.col]
    if v.kind == "num" or is_plain(v):
        return [v.col]
    t = to_term(v)
    kind = F.when(t.isNull(), 0).when(t_is(t, "_"), 1).when(t_is(t, "<"), 2).otherwise(3)
    return [kind, t_number(t), t_time(t), lexical(V("term", t)), t]


def same_kind(a: V, b: V) -> bool:
    return a.kind == b.kind and a.kind not in ("term", "lit", "num")


def compare(op: str, a: V, b: V) -> Column:
    def do(x: Column, y: Column) -> Column:
        return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    unknown = F.lit(None).cast("boolean")
    if a.kind == b.kind and a.kind in ("integer", "double", "float", "boolean", "dateTime", "date"):
        return do(a.col, b.col)
    if a.kind in ("iri", "bnode") and b.kind in ("iri", "bnode"):
        if op not in ("=", "!="):
            return unknown
        if a.kind != b.kind:
            return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(op == "!="))
        if a.extra and b.extra and a.extra[0] == b.extra[0]:
            return do(a.extra[1], b.extra[1])
        return do(a.col, b.col)
    if a.kind in NUMBERS and b.kind in NUMBERS:
        return do(a.col.cast("double"), b.col.cast("double"))
    dated = {"dateTime", "date"}
    if a.kind in dated and b.kind in dated | {"lit"} or b.kind in dated and a.kind == "lit":
        x, y = time(a), time(b)
        if x is None or y is None:
            return unknown
        return do(x.cast("timestamp"), y.cast("timestamp"))
    if is_plain(a) and is_plain(b):
        return do(a.col, b.col)
    x, y = to_term(a), to_term(b)
    nx, ny = number(a), number(b)
    nx, ny = (F.lit(None).cast("double") if n is None else n for n in (nx, ny))
    tx, ty = (F.lit(None).cast("timestamp") if t is None else t for t in (time(a), time(b)))
    plain = (t_tail(x) == "") & (t_tail(y) == "") & t_is(x, '"') & t_is(y, '"')
    truth = (t_datatype(x) == XSD + "boolean") & (t_datatype(y) == XSD + "boolean")
    out = F.when(nx.isNotNull() & ny.isNotNull(), do(nx, ny)).when(tx.isNotNull() & ty.isNotNull(), do(tx, ty)).when(plain, do(t_lex(x), t_lex(y))).when(truth, do(t_lex(x).isin("true", "1"), t_lex(y).isin("true", "1")))
    if op in ("=", "!="):
        both = t_is(x, '"') & t_is(y, '"')
        known = [*NUMERIC, XSD + "string", XSD + "boolean", XSD + "dateTime"]
        tagged = F.startswith(t_tail(x), F.lit("@")) & F.startswith(t_tail(y), F.lit("@"))
        return out.when(x == y, F.lit(op == "=")).when(~both | tagged, F.lit(op == "!=")).when(t_datatype(x).isin(*known) & t_datatype(y).isin(*known) & F.lit(False), F.lit(op == "!=")).otherwise(unknown)
    return out.otherwise(unknown)


def arithmetic(op: str, a: V, b: V) -> V:
    x, y = number(a), number(b)
    if x is None or y is None:
        return V("double", F.lit(None).cast("double"))
    if a.kind in NUMBERS and b.kind in NUMBERS:
        kind = NUMBERS[max(NUMBERS.index(a.kind), NUMBERS.index(b.kind))]
        if kind == "integer" and op != "/":
            f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
            return V("integer", f(a.col.cast("long"), b.col.cast("long")))
        kind = "decimal" if kind == "integer" else kind
        if op == "/":
            whole = F.lit(None).cast("double") if kind == "decimal" else F.when(x > 0, float("inf")).when(x < 0, float("-inf")).otherwise(float("nan"))
            return V(kind, F.when(y == 0, F.when(x.isNotNull(), whole)).otherwise(x / F.nullif(y, F.lit(0.0))))
        return V(kind, {"+": x + y, "-": x - y, "*": x * y}[op])
    r = F.greatest(rank(a), rank(b))
    r = F.greatest(r, F.lit(1)) if op == "/" else r
    value = F.try_divide(x, y) if op == "/" else {"+": x + y, "-": x - y, "*": x * y}[op]
    return V("num", F.when(r.isNotNull(), value), r)
