"""SPARQL 1.1 Query and Update to algebra, by recursive descent.

Beyond the standard: `x LIKE "a*" [IGNORE CASE]`, `x IN (SELECT ...)`, `x op ANY|ALL (SELECT ...)`, and
`{...} INTERSECT {...}`.
"""

from __future__ import annotations

import re
from typing import Any

from ..terms import OWL, QF, RDF, RDFS, XSD, BNode, IRI, Literal, Var, resolve, unescape
from .algebra import BGP, Distinct, E, Extend, Filter, Group, Intersect, Join, LeftJoin, Minus, Node, OrderBy, Path, Pattern, Project, Query, Reduced, Service, Slice, Union, Unit, Update, Values, variables

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
|(?P<iri><[^<>"{}|^`\\\x00-\x20]*(?:\\u[0-9A-Fa-f]{4}[^<>"{}|^`\\\x00-\x20]*)*>)
|(?P<str>\"\"\"(?:\"{0,2}(?:[^\"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
|(?P<var>[?$]\w+)
|(?P<bnode>_:[\w](?:[\w.\-]*[\w\-])?)
|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
|(?P<num>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
|(?P<pname>(?:[A-Za-zÀ-�](?:[\w\-.]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w\-:.]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w\-:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
|(?P<word>[A-Za-z]\w*)
|(?P<op>\^\^|\|\||&&|!=|<=|>=|[{}()\[\].,;=<>!+\-*/|^?])""",
    re.X | re.S,
)
_AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}
#: Prefixes that need no declaration.
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "owl": OWL, "qf": QF}


class SyntaxFault(ValueError):
    pass


class Parser:
    def __init__(self, text: str, base: str | None = None, prefixes: dict[str, str] | None = None):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SyntaxFault(f"unexpected text at {text[at : at + 30]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.i, self.base, self.fresh = 0, base, 0
        self.prefixes = PREFIXES | (prefixes or {})

    # tokens
    def peek(self, *words: str) -> bool:
        kind, text = self.tokens[self.i]
        return (text.upper() if kind == "word" else text) in words and kind in ("word", "op")

    def take(self, *words: str) -> str | None:
        if self.peek(*words):
            self.i += 1
            return self.tokens[self.i - 1][1].upper()
        return None

    def need(self, *words: str) -> str:
        got = self.take(*words)
        if got is None:
            raise SyntaxFault(f"expected {' or '.join(words)}, not {self.tokens[self.i][1]!r}")
        return got

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    def next(self) -> str:
        self.i += 1
        return self.tokens[self.i - 1][1]

    def new(self) -> Var:
        self.fresh += 1
        return Var(f".{self.fresh}")

    # terms
    def iri(self) -> IRI:
        if self.kind == "iri":
            return IRI(resolve(self.base, unescape(self.next()[1:-1])))
        if self.kind == "pname":
            name, _, local = self.next().partition(":")
            if name not in self.prefixes:
                raise SyntaxFault(f"unknown prefix {name}:")
            return IRI(self.prefixes[name] + re.sub(r"\\(.)", r"\1", local))
        raise SyntaxFault(f"expected an IRI, not {self.tokens[self.i][1]!r}")

    def string(self) -> str:
        t = self.next()
        q = 3 if t[:3] in ('"""', "'''") else 1
        return unescape(t[q:-q])

    def literal(self) -> Literal:
        if self.kind == "str":
            s = self.string()
            if self.kind == "lang":
                return Literal(s, RDF + "langString", self.next()[1:].lower())
            if self.take("^^"):
                return Literal(s, self.iri().value)
            return Literal(s)
        if self.kind == "num":
            t = self.next()
            return Literal(t, XSD + ("double" if re.search("[eE]", t) else "decimal" if "." in t else "integer"))
        return Literal(self.need("TRUE", "FALSE").lower(), XSD + "boolean")

    def number_signed(self) -> Literal:
        sign = self.take("+", "-")
        x = self.literal()
        return Literal("-" + x.lex, x.dt) if sign == "-" else x

    def term(self, data: bool = False) -> Any:
        if self.kind == "var":
            return Var(self.next()[1:])
        if self.kind in ("iri", "pname"):
            return self.iri()
        if self.kind == "bnode":
            label = self.next()[2:]
            return BNode(label) if data else Var("_:" + label)
        if self.peek("+", "-"):
            return self.number_signed()
        return self.literal()

    # queries
    def prologue(self) -> None:
        while True:
            if self.take("PREFIX"):
                name = self.next()
                if self.tokens[self.i - 1][0] != "pname" or not name.endswith(":"):
                    raise SyntaxFault(f"bad prefix {name!r}")
                self.prefixes[name[:-1]] = resolve(self.base, unescape(self.next()[1:-1]))
            elif self.take("BASE"):
                self.base = resolve(self.base, unescape(self.next()[1:-1]))
            else:
                return

    def query(self) -> Query:
        self.prologue()
        form = self.need("SELECT", "ASK", "CONSTRUCT", "DESCRIBE")
        q = Query(form, Unit())
        if form == "SELECT":
            q.root = self.select(q)
        else:
            if form == "CONSTRUCT":
                short = not self.peek("{")
                if not short:
                    q.template = self.template()
                self.dataset(q)
                self.take("WHERE") if short else None
                if short:
                    at = self.i
                    q.template = self.template()
                    self.i = at
            elif form == "DESCRIBE":
                if not self.take("*"):
                    while self.kind in ("var", "iri", "pname"):
                        q.described.append(self.term())
                self.dataset(q)
            else:
                self.dataset(q)
            where = Unit()
            if self.peek("WHERE", "{"):
                self.take("WHERE")
                where = self.group()
            if form == "DESCRIBE" and not q.described:
                q.described = [Var(v) for v in sorted(variables(where)) if not v.startswith((".", "_:"))]
            q.where = where
            q.root = self.modifiers(where, None, False, False)
        if self.kind != "end":
            raise SyntaxFault(f"unexpected {self.tokens[self.i][1]!r}")
        q.base = self.base
        return q

    def dataset(self, q: Query) -> None:
        while self.take("FROM"):
            q.has_dataset = True
            (q.named_graphs if self.take("NAMED") else q.default_graphs).append(self.iri().value)

    def select(self, q: Query | None) -> Node:
        mode = self.take("DISTINCT", "REDUCED")
        items: list[tuple[str, E | None]] | None = []
        if self.take("*"):
            items = None
        else:
            while self.kind == "var" or self.peek("("):
                if self.take("("):
                    e = self.expression()
                    self.need("AS")
                    items.append((self.next()[1:], e))
                    self.need(")")
                else:
                    items.append((self.next()[1:], None))
            if not items:
                raise SyntaxFault("SELECT needs variables")
        if q is not None:
            self.dataset(q)
        self.take("WHERE")
        where = self.group()
        if q is not None:
            q.where = where
        return self.modifiers(where, items, mode == "DISTINCT", mode == "REDUCED", True)

    def modifiers(self, where: Node, items: list | None, distinct: bool, reduced: bool, project: bool = False) -> Node:
        keys: list[tuple[str, E]] = []
        grouped = False
        if self.take("GROUP"):
            self.need("BY")
            grouped = True
            while self.kind in ("var", "iri", "pname", "word") and not self.peek("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES") or self.peek("("):
                if self.kind == "var":
                    v = self.next()[1:]
                    keys.append((v, E("var", [v])))
                elif self.take("("):
                    e = self.expression()
                    name = self.next()[1:] if self.take("AS") else self.new().name
                    self.need(")")
                    keys.append((name, e))
                else:
                    keys.append((self.new().name, self.primary()))
        having: list[E] = []
        if self.take("HAVING"):
            while self.peek("(") or self.kind in ("iri", "pname") or (self.kind == "word" and not self.peek("ORDER", "LIMIT", "OFFSET", "VALUES")):
                having.append(self.primary())
        order: list[tuple[E, bool]] = []
        if self.take("ORDER"):
            self.need("BY")
            while True:
                if self.peek("ASC", "DESC"):
                    up = self.take("ASC", "DESC") == "ASC"
                    order.append((self.primary(), up))
                elif self.kind == "var" or self.peek("(") or self.kind in ("iri", "pname") or (self.kind == "word" and not self.peek("LIMIT", "OFFSET", "VALUES")):
                    order.append((self.primary(), True))
                else:
                    break
        limit, offset = None, 0
        while word := self.take("LIMIT", "OFFSET"):
            n = int(self.next())
            limit, offset = (n, offset) if word == "LIMIT" else (limit, n)
        tail = self.values() if self.take("VALUES") else None

        aggregates: list[tuple[str, E]] = []

        def lift(e: Any) -> Any:
            if isinstance(e, E):
                if e.op == "agg":
                    name = next((n for n, a in aggregates if a == e), None)
                    if name is None:
                        name = self.new().name
                        aggregates.append((name, e))
                    return E("var", [name])
                if e.op in ("exists", "notexists"):
                    return e
                return E(e.op, [lift(a) for a in e.args])
            return [lift(x) for x in e] if isinstance(e, list) else e

        extends = [(v, lift(e)) for v, e in items or () if e is not None]
        having, order = [lift(h) for h in having], [(lift(e), up) for e, up in order]
        node = where
        if grouped or aggregates:
            node = Group(node, keys, aggregates)
        for v, e in extends:
            node = Extend(node, v, e)
        for h in having:
            node = Filter(h, node)
        if tail:
            node = Join(node, tail)
        if order:
            node = OrderBy(node, order)
        if project:
            node = Project(node, None if items is None else [v for v, _ in items])
        node = Distinct(node) if distinct else Reduced(node) if reduced else node
        return Slice(node, offset, limit) if limit is not None or offset else node

    # patterns
    def group(self, graph: Any = None) -> Node:
        self.need("{")
        if self.take("SELECT"):
            node = self.select(None)
            self.need("}")
            return _in_graph(node, graph)
        node: Node = Unit()
        filters: list[E] = []
        triples: list[Node] = []

        def flush() -> None:
            nonlocal node, triples
            if triples:
                node = _join(node, BGP(triples))
                triples = []

        while not self.take("}"):
            if self.take("OPTIONAL"):
                flush()
                right = self.group(graph)
                node = LeftJoin(node, right.child, right.condition) if isinstance(right, Filter) else LeftJoin(node, right)
            elif self.take("MINUS"):
                flush()
                node = Minus(node, self.group(graph))
            elif self.take("FILTER"):
                filters.append(self.primary())
            elif self.take("BIND"):
                flush()
                self.need("(")
                e = self.expression()
                self.need("AS")
                name = self.next()[1:]
                self.need(")")
                if name in variables(node):
                    raise SyntaxFault(f"?{name} is in scope already")
                node = Extend(node, name, e)
            elif self.take("VALUES"):
                flush()
                node = _join(node, self.values())
            elif self.take("GRAPH"):
                flush()
                g = self.term()
                node = _join(node, self.group(g))
            elif self.take("SERVICE"):
                flush()
                silent = bool(self.take("SILENT"))
                target = self.term()
                node = _join(node, Service(target, silent, self.group(None)))
            elif self.peek("{"):
                flush()
                part = self.group(graph)
                while word := self.take("UNION", "INTERSECT"):
                    part = (Union if word == "UNION" else Intersect)(part, self.group(graph))
                node = _join(node, part)
            else:
                triples += self.triples(graph)
            self.take(".")
        flush()
        if filters:
            both = filters[0]
            for f in filters[1:]:
                both = E("&&", [both, f])
            node = Filter(both, node)
        return node

    def values(self) -> Values:
        if self.kind == "var":
            names, single = [self.next()[1:]], True
        else:
            self.need("(")
            names, single = [], False
            while self.kind == "var":
                names.append(self.next()[1:])
            self.need(")")
        rows = []
        self.need("{")
        while not self.take("}"):
            if not single:
                self.need("(")
            row = []
            while len(row) < len(names):
                row.append(None if self.take("UNDEF") else self.term(data=True))
            rows.append(row)
            if not single:
                self.need(")")
        return Values(names, rows)

    def triples(self, graph: Any, data: bool = False) -> list[Node]:
        out: list[Node] = []
        s = self.node(out, graph, data)
        if not (out and self.peek(".", "}")):
            self.properties(s, out, graph, data)
        return out

    def properties(self, s: Any, out: list[Node], graph: Any, data: bool) -> None:
        while True:
            path = ("link", Var(self.next()[1:])) if self.kind == "var" else self.path()
            while True:
                o = self.node(out, graph, data)
                self.link(s, path, o, out, graph)
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.peek(".", "}", "]"):
                return

    def node(self, out: list[Node], graph: Any, data: bool) -> Any:
        if self.take("["):
            s = BNode(f"anon{self.new().name[1:]}") if data else self.new()
            if not self.take("]"):
                self.properties(s, out, graph, data)
                self.need("]")
            return s
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node(out, graph, data))
            head: Any = IRI(RDF + "nil")
            for x in reversed(items):
                cell = BNode(f"list{self.new().name[1:]}") if data else self.new()
                out += [Pattern(cell, IRI(RDF + "first"), x, graph), Pattern(cell, IRI(RDF + "rest"), head, graph)]
                head = cell
            return head
        return self.term(data)

    # property paths: ("link", p) ("inv", x) ("seq", x, y) ("alt", x, y) ("neg", forward, backward) ("mod", x, low, high)
    def path(self) -> tuple:
        x = self.path_sequence()
        while self.take("|"):
            x = ("alt", x, self.path_sequence())
        return x

    def path_sequence(self) -> tuple:
        x = self.path_step()
        while self.take("/"):
            x = ("seq", x, self.path_step())
        return x

    def path_step(self) -> tuple:
        if self.take("^"):
            return ("inv", self.path_step())
        if self.take("!"):
            forward, backward = [], []
            many = self.take("(")
            while True:
                back = self.take("^")
                p = IRI(RDF + "type") if self.take("A") else self.iri()
                (backward if back else forward).append(p)
                if not many or not self.take("|"):
                    break
            if many:
                self.need(")")
            return ("neg", forward, backward)
        if self.take("("):
            x = self.path()
            self.need(")")
        elif self.kind == "word" and self.tokens[self.i][1] == "a":
            self.i += 1
            x = ("link", IRI(RDF + "type"))
        else:
            x = ("link", self.iri())
        if m := self.take("*", "+", "?"):
            return ("mod", x, 0 if m in "*?" else 1, 1 if m == "?" else None)
        return x

    def link(self, s: Any, path: tuple, o: Any, out: list[Node], graph: Any) -> None:
        kind = path[0]
        if kind == "link":
            out.append(Pattern(s, path[1], o, graph))
        elif kind == "inv":
            self.link(o, path[1], s, out, graph)
        elif kind == "seq":
            mid = self.new()
            self.link(s, path[1], mid, out, graph)
            self.link(mid, path[2], o, out, graph)
        else:
            out.append(self.path_node(s, path, o, graph))

    def path_node(self, s: Any, path: tuple, o: Any, graph: Any) -> Node:
        kind = path[0]
        if kind == "alt":
            parts = []
            for x in path[1:]:
                own: list[Node] = []
                self.link(s, x, o, own, graph)
                parts.append(BGP(own))
            return Union(*parts)
        if kind == "neg":
            forward, backward = path[1:]
            parts = []
            for preds, a, b in ((forward, s, o), (backward, o, s)):
                if preds or (not forward and not backward):
                    p = self.new()
                    parts.append(Filter(E("notin", [E("var", [p.name]), [E("const", [x]) for x in preds]]), BGP([Pattern(a, p, b, graph)])))
            return parts[0] if len(parts) == 1 else Union(*parts)
        a, b = self.new(), self.new()
        own = []
        self.link(a, path[1], b, own, graph)
        return Path(s, BGP(own), a, b, path[2], path[3], o, graph)

    # expressions
    def expression(self) -> E:
        x = self.conjunction()
        while self.take("||"):
            x = E("||", [x, self.conjunction()])
        return x

    def conjunction(self) -> E:
        x = self.relation()
        while self.take("&&"):
            x = E("&&", [x, self.relation()])
        return x

    def relation(self) -> E:
        x = self.sum()
        if op := self.take("=", "!=", "<", ">", "<=", ">="):
            if word := self.take("ANY", "ALL"):
                self.need("(")
                self.need("SELECT")
                sub = self.select(None)
                self.need(")")
                return E(word.lower(), [op, x, sub])
            return E(op, [x, self.sum()])
        if self.take("LIKE"):
            pattern = self.string()
            fold = bool(self.take("IGNORE") and self.need("CASE"))
            return E("like", [x, pattern, fold])
        negate = self.peek("NOT") and self.tokens[self.i + 1][1].upper() == "IN" and bool(self.take("NOT"))
        if self.take("IN"):
            self.need("(")
            if self.take("SELECT"):
                e = E("insub", [x, self.select(None)])
                self.need(")")
                return E("!", [e]) if negate else e
            items = []
            while not self.take(")"):
                items.append(self.expression())
                self.take(",")
            return E("notin" if negate else "in", [x, items])
        return x

    def sum(self) -> E:
        x = self.product()
        while True:
            if op := self.take("+", "-"):
                x = E(op, [x, self.product()])
            else:
                return x

    def product(self) -> E:
        x = self.unary()
        while op := self.take("*", "/"):
            x = E(op, [x, self.unary()])
        return x

    def unary(self) -> E:
        if self.take("!"):
            return E("!", [self.unary()])
        if self.take("-"):
            return E("neg", [self.unary()])
        if self.take("+"):
            return self.unary()
        return self.primary()

    def primary(self) -> E:
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.kind == "var":
            return E("var", [self.next()[1:]])
        if self.kind in ("iri", "pname"):
            name = self.iri()
            if self.peek("("):
                return E("call", [name.value, self.arguments()])
            return E("const", [name])
        if self.kind in ("str", "num") or self.peek("TRUE", "FALSE"):
            return E("const", [self.literal()])
        if self.take("NOT"):
            self.need("EXISTS")
            return E("notexists", [self.group()])
        if self.take("EXISTS"):
            return E("exists", [self.group()])
        if self.kind != "word":
            raise SyntaxFault(f"unexpected {self.tokens[self.i][1]!r}")
        name = self.next().upper()
        if name in _AGGREGATES:
            self.need("(")
            distinct = bool(self.take("DISTINCT"))
            arg = None if self.take("*") else self.expression()
            separator = " "
            if self.take(";"):
                self.need("SEPARATOR")
                self.need("=")
                separator = self.string()
            self.need(")")
            return E("agg", [name, distinct, arg, separator])
        return E("fn", [name, self.arguments()])

    def arguments(self) -> list[E]:
        self.need("(")
        self.take("DISTINCT")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            self.take(",")
        return out

    # templates and updates
    def template(self) -> list[tuple]:
        """Quads (s, p, o, g); blank nodes are BNode."""
        out: list[Node] = []
        self.need("{")
        self.quads(out, None)
        return [(p.s, p.p, p.o, p.g) for p in out]

    def quads(self, out: list[Node], graph: Any) -> None:
        while not self.take("}"):
            if self.take("GRAPH"):
                g = self.term(data=True)
                self.need("{")
                self.quads(out, g)
            else:
                out += self.triples(graph, data=True)
            self.take(".")

    def graph_ref(self) -> Any:
        if word := self.take("DEFAULT", "NAMED", "ALL"):
            return word
        self.take("GRAPH")
        return self.iri().value

    def updates(self) -> list[Update]:
        out = []
        while True:
            self.prologue()
            if self.kind == "end":
                return out
            out.append(self.update())
            if not self.take(";") and self.kind != "end":
                raise SyntaxFault(f"unexpected {self.tokens[self.i][1]!r}")

    def update(self) -> Update:
        with_graph = self.iri() if self.take("WITH") else None
        word = self.need("INSERT", "DELETE", "CLEAR", "DROP", "CREATE", "ADD", "MOVE", "COPY", "LOAD")
        if word in ("CLEAR", "DROP", "CREATE"):
            silent = bool(self.take("SILENT"))
            return Update(word, target=self.graph_ref(), silent=silent)
        if word in ("ADD", "MOVE", "COPY"):
            silent = bool(self.take("SILENT"))
            source = self.graph_ref()
            self.need("TO")
            return Update(word, source=source, target=self.graph_ref(), silent=silent)
        if word == "LOAD":
            silent = bool(self.take("SILENT"))
            source = self.iri().value
            return Update("LOAD", source=source, target=self.graph_ref() if self.take("INTO") else None, silent=silent)
        if self.take("DATA"):
            quads = self.template()
            return Update("DATA", insert=quads if word == "INSERT" else [], delete=quads if word == "DELETE" else [])
        u = Update("MODIFY")
        if word == "DELETE" and self.take("WHERE"):
            at = self.i
            u.delete = [tuple(Var("_:" + t.label) if isinstance(t, BNode) else t for t in q) for q in self.template()]
            self.i = at
            u.where = self.group()
            return u
        own = self.template()
        if word == "DELETE":
            u.delete = own
            if self.take("INSERT"):
                u.insert = self.template()
        else:
            u.insert = own
        if with_graph:
            u.insert, u.delete = ([(s, p, o, g or with_graph) for s, p, o, g in x] for x in (u.insert, u.delete))
        while self.take("USING"):
            (u.using_named if self.take("NAMED") else u.using).append(self.iri().value)
        self.need("WHERE")
        if with_graph and not u.using and not u.using_named:
            u.using = [with_graph.value]
            u.using_named = None
        u.where = self.group()
        return u


def _join(a: Node, b: Node) -> Node:
    return b if isinstance(a, Unit) else Join(a, b)


def _in_graph(node: Any, graph: Any) -> Any:
    """Patterns of a sub-select inside GRAPH read that graph."""
    if graph is None:
        return node
    if isinstance(node, (Pattern, Path)) and node.g is None:
        node.g = graph
    for x in vars(node).values() if isinstance(node, (Node, E)) else ():
        for y in x if isinstance(x, list) else [x]:
            _in_graph(y, graph)
    return node


def parse_query(text: str, base: str | None = None, prefixes: dict[str, str] | None = None) -> Query:
    return Parser(text, base, prefixes).query()


def parse_update(text: str, base: str | None = None, prefixes: dict[str, str] | None = None) -> list[Update]:
    return Parser(text, base, prefixes).updates()
