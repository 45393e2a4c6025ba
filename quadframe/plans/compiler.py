"""Algebra to DataFrames. Catalyst and adaptive execution choose the physical plan."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import library as L
from ..functions.values import V, arithmetic, compare, constant, ebv, is_literal, is_plain, lexical, null, number, rank, sort_keys, to_term
from ..operators import paths
from ..sources.dataset import Dataset, MappedTable
from ..staging import stage
from ..terms import NIL, QF, RDF, XSD, BNode, IRI, Literal, Var
from .algebra import BGP, Distinct, E, Extend, External, Filter, Group, Intersect, Join, LeftJoin, Minus, Node, OrderBy, Path, Pattern, Project, Query, Reduced, Service, Slice, Union, Unit, Values, used, variables
from .cardinality import Statistics, fork_variables, ordered
from .lanes import Lane, Rel, alike, fresh, is_constant, never, pair, to_lane, union


class CompileFault(ValueError):
    pass


class Compiler:
    def __init__(self, spark: SparkSession, dataset: Dataset, datasets: dict[str, Dataset] | None = None, query: Query | None = None, fork: int = 0, stats: Statistics | None = None, base: str | None = None):
        self.spark, self.data, self.datasets, self.fork, self.stats = spark, dataset, datasets or {}, fork, stats
        self.base = base or (query.base if query else None)
        self.scoped = bool(query and query.has_dataset)
        self.default = list(query.default_graphs) if query else []
        self.named = list(query.named_graphs) if query else []
        self.now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
        self.first: set[str] = set()

    def compile(self, node: Node) -> Rel:
        return getattr(self, "_" + type(node).__name__.lower())(node)

    # leaves
    def unit(self) -> Rel:
        return Rel(self.spark.range(1).select(F.lit(1).alias(fresh())), {})

    def nothing(self, names: set[str]) -> Rel:
        lanes = {n: Lane("term", fresh(), null=True) for n in sorted(names)}
        df = self.spark.range(0).select(*[F.lit(None).cast("string").alias(x.col) for x in lanes.values()] or [F.lit(1).alias(fresh())])
        return Rel(df, lanes)

    def _unit(self, node: Unit) -> Rel:
        return self.unit()

    def _values(self, node: Values) -> Rel:
        lanes, fields, columns = {}, [], []
        for k, name in enumerate(node.names):
            own = [r[k] for r in node.rows]
            bound = [t for t in own if t is not None]
            kind = "term"
            if bound and all(isinstance(t, IRI) for t in bound):
                kind = "iri"
            elif bound and all(isinstance(t, Literal) and t.dt == XSD + "string" for t in bound):
                kind = "string"
            elif bound and all(isinstance(t, Literal) and t.dt == XSD + "integer" and t.lex.lstrip("+-").isdigit() and str(int(t.lex)) == t.lex and abs(int(t.lex)) < 1 << 63 for t in bound):
                kind = "integer"
            lanes[name] = Lane(kind, fresh(), null=len(bound) < len(own))
            fields.append(f"{lanes[name].col} {'long' if kind == 'integer' else 'string'}")
            columns.append([None if t is None else t.n3() if kind == "term" else t.value if kind == "iri" else int(t.lex) if kind == "integer" else t.lex for t in own])
        if not node.names:
            return Rel(self.spark.range(len(node.rows)).select(F.lit(1).alias(fresh())), {})
        return Rel(self.spark.createDataFrame(list(zip(*columns)), ", ".join(fields)), lanes)

    def _external(self, node: External) -> Rel:
        kinds = {"bigint": "integer", "int": "integer", "double": "double", "float": "float", "boolean": "boolean", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "date": "date"}
        lanes = {n: Lane("term" if t == "string" else kinds[t], fresh(), null=True) for n, t in node.df.dtypes}
        return Rel(node.df.select(*[F.col(f"`{n}`").cast("long" if x.kind == "integer" else t).alias(x.col) for (n, t), x in zip(node.df.dtypes, lanes.values())]), lanes)

    def _bgp(self, node: BGP) -> Rel:
        if not node.patterns:
            return self.unit()
        units: list[list[Node]] = []
        stars: dict[Any, list[Pattern]] = {}
        for p in node.patterns:
            key = (p.s, p.g) if isinstance(p, Pattern) and isinstance(p.p, IRI) and self.data.mapped and not self.data.quads and not _is_search(p.o) and not self.scoped else None
            if key is not None and key in stars:
                stars[key].append(p)
                continue
            units.append([p])
            if key is not None:
                stars[key] = units[-1]
        by_first = {id(u[0]): u for u in units}
        rel = None
        for p in ordered([u[0] for u in units], set(), self.first, self.stats):
            u = by_first[id(p)]
            part = self.star(u) if len(u) > 1 else self.compile(p)
            rel = part if rel is None else self.join(rel, part)
        return rel

    def star(self, patterns: list[Pattern]) -> Rel:
        """Patterns of one subject: one scan per table that has all their predicates, where subjects tell
        tables apart; else a join of the patterns."""
        tables = [[t for t in self.tables(p) if self.has(t, p)] for p in patterns]
        prefixes = [t.prefix for t in {id(t): t for own in tables for t in own}.values()]
        apart = len(set(prefixes)) == len(prefixes) and not any(a != b and a.startswith(b) for a in prefixes for b in prefixes)
        if not apart or isinstance(patterns[0].g, Var):
            rel = self.compile(patterns[0])
            for p in patterns[1:]:
                rel = self.join(rel, self.compile(p))
            return rel
        every = [t for t in tables[0] if all(any(t is x for x in own) for own in tables)]
        return union([self.scan(t, patterns) for t in every]) if every else self.nothing(set().union(*map(variables, patterns)))

    def tables(self, p: Pattern) -> list[MappedTable]:
        g = p.g
        out = []
        for t in self.data.mapped:
            if g is None:
                ok = not self.scoped or (t.graph in self.default if t.graph else NIL in self.default)
            elif isinstance(g, IRI):
                ok = t.graph == g.value and (not self.scoped or g.value in self.named)
            else:
                ok = t.graph is not None and (not self.scoped or t.graph in self.named)
            if ok and not (isinstance(p.s, IRI) and not p.s.value.startswith(t.prefix)) and not isinstance(p.s, (Literal, BNode)):
                out.append(t)
        return out

    def has(self, t: MappedTable, p: Pattern) -> bool:
        if p.p.value == RDF + "type" and t.cls:
            return not isinstance(p.o, (Literal, BNode)) and not (isinstance(p.o, IRI) and p.o.value != t.cls)
        c = t.columns.get(p.p.value)
        return c is not None and not (isinstance(p.o, IRI) and (c.kind != "key" or not p.o.value.startswith(c.prefix)))

    def scan(self, t: MappedTable, patterns: list[Pattern]) -> Rel:
        """One pass over a mapped table for patterns of one subject with constant predicates."""
        types = dict(t.df.dtypes)
        found: list[tuple[Any, Lane]] = [(patterns[0].s, Lane("key", t.key, t.prefix))]
        df = t.df
        for p in patterns:
            if p.p.value == RDF + "type" and t.cls:
                if isinstance(p.o, Var):
                    name = fresh()
                    df = df.withColumn(name, F.lit(t.cls))
                    types[name] = "string"
                    found.append((p.o, Lane("iri", name)))
                continue
            c = t.columns[p.p.value]
            found.append((p.o, Lane(c.kind, c.name, c.prefix)))
        if isinstance(patterns[0].g, Var):
            name = fresh()
            df = df.withColumn(name, F.lit(t.graph))
            types[name] = "string"
            found.append((patterns[0].g, Lane("iri", name)))
        for col in dict.fromkeys(x.col for _, x in found):
            df = df.filter(F.col(col).isNotNull())
        lanes: dict[str, Lane] = {}
        picked: list[Column] = []
        for term, lane in found:
            if not isinstance(term, Var):
                df = df.filter(is_constant(lane, term, types[lane.col]))
            elif term.name in lanes:
                a, b = pair(lanes[term.name], lane)
                df = df.filter(F.lit(False) if never(lanes[term.name], lane) else a == b)
            else:
                lanes[term.name] = lane
        new = {}
        for name, lane in lanes.items():
            col = fresh()
            c = F.col(lane.col)
            picked.append((c.cast("long") if lane.kind in ("integer", "key") and types[lane.col] in ("int", "smallint", "tinyint") else c).alias(col))
            new[name] = replace(lane, col=col)
        return Rel(df.select(*picked) if picked else df.select(F.lit(1).alias(fresh())), new)

    def _pattern(self, p: Pattern) -> Rel:
        if _is_search(p.o):
            hit = Var(f".search{fresh()}")
            rel = self.compile(Pattern(p.s, p.p, hit, p.g))
            from ..tools.textindex import matches

            lane = rel.lanes[hit.name]
            text = F.when(is_literal(lane.value()), lexical(lane.value()))
            return Rel(rel.df.filter(matches(text, p.o.lex)), {k: v for k, v in rel.lanes.items() if k != hit.name})
        parts = []
        tables = self.tables(p)
        for t in tables:
            if isinstance(p.p, IRI):
                if self.has(t, p):
                    parts.append(self.scan(t, [p]))
                continue
            if isinstance(p.p, Var):
                names = [*t.columns, *([RDF + "type"] if t.cls else [])]
                for name in names:
                    own = Pattern(p.s, IRI(name), p.o, p.g)
                    if self.has(t, own):
                        r = self.scan(t, [own])
                        same = p.p.name in r.lanes
                        r2 = r.with_value(p.p.name if not same else ".p", V("iri", F.lit(name)), null=False)
                        if same:
                            a, b = pair(r2.lanes[p.p.name], r2.lanes[".p"])
                            r2 = Rel(r2.df.filter(a == b), {k: v for k, v in r2.lanes.items() if k != ".p"})
                        parts.append(r2)
        if self.data.quads:
            parts.append(self.quads(p))
        if not parts:
            return self.nothing(variables(p))
        rel = union(parts) if len(parts) > 1 else parts[0]
        overlap = len({t.prefix for t in tables}) < len(tables) or (self.data.quads and len(parts) > 1)
        if len(parts) > 1 and overlap and not isinstance(p.g, IRI):
            rel = Rel(rel.df.distinct(), rel.lanes) if rel.lanes else rel
        return rel

    def quads(self, p: Pattern) -> Rel:
        df, g = self.data.quads.df, p.g
        for name, t in (("s", p.s), ("p", p.p), ("o", p.o), ("g", g)):
            if t is not None and not isinstance(t, Var):
                df = df.filter(F.col(name) == t.n3())
        once = False
        if g is None:
            if self.scoped:
                named = [f"<{x}>" for x in self.default if x != NIL]
                df = df.filter(F.coalesce(F.col("g").isin(*named), F.lit(False)) | (F.col("g").isNull() & F.lit(NIL in self.default)))
                once = len(self.default) > 1
            else:
                once = self.data.quads.has_graphs
        elif isinstance(g, Var):
            df = df.filter("g IS NOT NULL")
            if self.scoped and isinstance(self.named, list):
                df = df.filter(F.col("g").isin(*[f"<{x}>" for x in self.named]))
        elif self.scoped and g.value not in self.named:
            df = df.filter(F.lit(False))
        if once:
            df = df.select("s", "p", "o").distinct()
        lanes, picked = {}, []
        for name, t in (("s", p.s), ("p", p.p), ("o", p.o), ("g", g)):
            if isinstance(t, Var):
                if t.name in lanes:
                    df = df.filter(F.col(lanes[t.name]) == F.col(name))
                else:
                    lanes[t.name] = name
        new = {v: Lane("term", fresh()) for v in lanes}
        picked = [F.col(lanes[v]).alias(x.col) for v, x in new.items()]
        return Rel(df.select(*picked) if picked else df.select(F.lit(1).alias(fresh())), new)

    def _path(self, node: Path) -> Rel:
        return paths.closure(self, node)

    # joins
    def join(self, a: Rel, b: Rel) -> Rel:
        shared = [n for n in a.lanes if n in b.lanes]
        if any(never(a.lanes[n], b.lanes[n]) and not (a.lanes[n].null or b.lanes[n].null) for n in shared):
            return self.nothing(set(a.lanes) | set(b.lanes))
        parts = []
        for x, free in by_unbound(a, shared):
            for y, too in by_unbound(b, shared):
                # columns of their own, as the parts of a side share theirs
                x, y = (x, y) if x is a and y is b else (x.renamed(), y.renamed())
                tight = [n for n in shared if n not in free | too]
                parts.append(self.merged(x, y, x.df.join(y.df, self.on(x, y, tight), "inner") if tight else x.df.crossJoin(y.df)))
        return union(parts) if len(parts) > 1 else parts[0]

    def on(self, a: Rel, b: Rel, shared: list[str]) -> Column:
        """Equality of shared variables; where one is unbound there is none."""
        out = F.lit(True)
        for k, n in enumerate(shared):
            left, right = pair(a.lanes[n], b.lanes[n])
            same = F.lit(False) if never(a.lanes[n], b.lanes[n]) else left == right
            out = same if k == 0 else out & same
        return out

    def kept(self, a: Rel, b: Rel, shared: list[str], keep: bool, more: Callable[[Rel, Rel], Column] | None = None, bound: bool = False) -> Rel:
        """Rows of a that are (keep), or are not, compatible with some row of b on shared variables, which
        either side may leave unbound, and for which more(a, b) holds. bound: with one shared variable bound
        on both sides at least (MINUS). Every step is an equi-join where a variable is bound on both sides."""
        parts = []
        others = by_unbound(b, shared)
        for x, free in by_unbound(a, shared):
            rest, hits = x, []
            for y, too in others:
                tight = [n for n in shared if n not in free | too]
                if bound and not tight:
                    continue
                cond, other = self.on(rest, y, tight), y.df
                if more is not None:
                    cond = (cond & more(rest, y)) if tight else more(rest, y)
                elif tight:
                    other = other.select(*[y.lanes[n].col for n in tight]).distinct()
                else:
                    other = other.limit(1)  # any row will do
                if keep:
                    hits.append(Rel(rest.df.join(other, cond, "left_semi"), x.lanes))
                if not keep or y is not others[-1][0]:
                    rest = Rel(rest.df.join(other, cond, "left_anti"), x.lanes)
            parts += hits if keep else [rest]
        if not parts:
            return Rel(a.df.filter(F.lit(False)), a.lanes, a.order)
        df = parts[0].df
        for p in parts[1:]:
            df = df.union(p.df)
        return Rel(df, a.lanes, a.order)

    def merged(self, a: Rel, b: Rel, df: DataFrame, outer: bool = False) -> Rel:
        """Lanes of a join; values of a that may be unbound are filled from b."""
        lanes = dict(a.lanes)
        for n, y in b.lanes.items():
            x = lanes.get(n)
            if x is None:
                lanes[n] = replace(y, null=True, poisoned=False) if outer else y
            elif x.null:
                if alike(x, y):
                    lane, col = replace(x, col=fresh()), F.coalesce(F.col(x.col), F.col(y.col))
                else:
                    lane, col = Lane("term", fresh()), F.coalesce(x.term(), y.term())
                df = df.withColumn(lane.col, col)
                lanes[n] = replace(lane, null=outer or (x.null and y.null), poisoned=False)
        return Rel(df, lanes)

    def _join(self, node: Join) -> Rel:
        return self.join(self.compile(node.left), self.compile(node.right))

    def _leftjoin(self, node: LeftJoin) -> Rel:
        a, b = self.compile(node.left), self.compile(node.right)
        shared = [n for n in a.lanes if n in b.lanes]
        if node.condition is not None and _has_exists(node.condition):
            row = fresh()
            a = numbered(a, row)
            carried = Rel(a.df, a.lanes | {f".{row}": Lane("integer", row)})
            matched = self.filtered(self.join(carried, b), node.condition)
            row_col = matched.lanes[f".{row}"].col
            matched = Rel(matched.df, {n: x for n, x in matched.lanes.items() if n != f".{row}"})
            extra = [n for n in matched.lanes if n not in a.lanes or a.lanes[n].null]
            names = {n: fresh() for n in extra}
            cols = [F.col(matched.lanes[n].col).alias(col) for n, col in names.items()]
            right = Rel(matched.df.select(F.col(row_col).alias(row + "r"), *cols), {n: replace(matched.lanes[n], col=col) for n, col in names.items()})
            return self.merged(a, right, a.df.join(right.df, F.col(row) == F.col(row + "r"), "left"), outer=True)

        def holds(x: Rel, y: Rel) -> Column:
            both = y.lanes | {n: lane for n, lane in x.lanes.items() if n not in y.lanes or not lane.null}
            return F.coalesce(ebv(self.value(node.condition, Rel(x.df, both))), F.lit(False))

        more = holds if node.condition is not None else None
        if not any(is_loose(r.lanes[n]) for r in (a, b) for n in shared):
            cond = self.on(a, b, shared)
            return self.merged(a, b, a.df.join(b.df, cond & more(a, b) if more else cond, "left"), outer=True)
        matched = []
        for x, free in by_unbound(a, shared):
            for y, too in by_unbound(b, shared):
                x, y = x.renamed(), y.renamed()
                tight = [n for n in shared if n not in free | too]
                cond = self.on(x, y, tight)
                matched.append(self.merged(x, y, x.df.join(y.df, cond & more(x, y) if more else cond, "inner")))
        return union([*matched, self.kept(a, b, shared, False, more).renamed()])

    def _union(self, node: Union) -> Rel:
        return union([self.compile(node.left), self.compile(node.right)])

    def _minus(self, node: Minus) -> Rel:
        a, b = self.compile(node.left), self.compile(node.right)
        shared = [n for n in a.lanes if n in b.lanes]
        if not shared:
            return a
        return self.kept(a, b, shared, False, bound=True)

    def _intersect(self, node: Intersect) -> Rel:
        a, b = self.compile(node.left), self.compile(node.right)
        cond = F.lit(True)
        for n in dict.fromkeys([*a.lanes, *b.lanes]):
            if n in a.lanes and n in b.lanes:
                x, y = pair(a.lanes[n], b.lanes[n])
                cond = cond & (F.lit(False) if never(a.lanes[n], b.lanes[n]) else x.eqNullSafe(y))
            else:
                cond = cond & F.col((a.lanes.get(n) or b.lanes[n]).col).isNull()
        return Rel(a.df.join(b.df, cond, "left_semi"), a.lanes)

    def _service(self, node: Service) -> Rel:
        try:
            if isinstance(node.target, Var):
                parts = []
                for name, d in self.datasets.items():
                    own = Compiler(self.spark, d, self.datasets, base=self.base).compile(node.child)
                    parts.append(own.with_value(node.target.name, V("iri", F.lit(QF + name)), null=False))
                return union(parts) if parts else self.nothing(variables(node.child) | {node.target.name})
            name = node.target.value
            if not name.startswith(QF) or name[len(QF) :] not in self.datasets:
                raise CompileFault(f"unknown service {name}")
            return Compiler(self.spark, self.datasets[name[len(QF) :]], self.datasets, base=self.base).compile(node.child)
        except (CompileFault, L.UnknownFunction):
            if node.silent:
                return self.unit()
            raise

    # filters
    def _filter(self, node: Filter) -> Rel:
        self.first |= fork_variables(node.condition)
        return self.filtered(self.compile(node.child), node.condition)

    def filtered(self, rel: Rel, cond: E) -> Rel:
        for c in _conjuncts(cond):
            if c.op in ("exists", "notexists"):
                rel = self.semi(rel, c.args[0], c.op == "exists")
            elif c.op in ("any", "all", "insub"):
                rel = self.quantified(rel, c)
            else:
                rel, c = self.flagged(rel, c)
                rel = Rel(rel.df.filter(ebv(self.value(c, rel))), rel.lanes, rel.order)
        return rel

    def inner(self, rel: Rel, node: Node) -> tuple[Rel, list[E]]:
        """A pattern inside EXISTS, and its filters on outer variables."""
        conds: list[E] = []
        while isinstance(node, Filter):
            outside = (used(node.condition) - variables(node.child)) & set(rel.lanes)
            mine = [c for c in _conjuncts(node.condition) if used(c) & outside and not _has_exists(c)]
            rest = [c for c in _conjuncts(node.condition) if c not in mine]
            conds += mine
            if not rest:
                node = node.child
                continue
            node = Filter(rest[0] if len(rest) == 1 else E("&&", rest), node.child)
            break
        own = self.compile(node).renamed()
        return own, conds

    def semi(self, rel: Rel, node: Node, keep: bool) -> Rel:
        own, conds = self.inner(rel, node)

        def hold(x: Rel, y: Rel) -> Column:
            out = F.lit(True)
            for c in conds:
                out = out & F.coalesce(ebv(self.value(c, Rel(x.df, y.lanes | x.lanes))), F.lit(False))
            return out

        return self.kept(rel, own, [n for n in rel.lanes if n in own.lanes], keep, hold if conds else None)

    def quantified(self, rel: Rel, c: E) -> Rel:
        if c.op == "insub":
            op, x, sub = "=", c.args[0], c.args[1]
        else:
            op, x, sub = c.args
        own = self.compile(sub).renamed()
        name = sub.names[0] if isinstance(sub, Project) and sub.names else next(iter(own.lanes))
        v = self.value(x, rel)
        other = own.lanes[name]
        if c.op == "insub":
            hit = to_term(v) == other.term()
            if v.kind == other.value().kind and v.kind not in ("lit", "term"):
                hit = v.col == other.value().col
            return Rel(rel.df.join(own.df, hit, "left_semi"), rel.lanes, rel.order)
        # comparison with a set needs only its extremes, unless it is (in)equality of terms
        numeric = other.kind in ("integer", "decimal", "float", "double", "dateTime", "date", "string")
        if numeric and op in ("<", "<=", ">", ">="):
            low = (c.op == "any") == (op in (">", ">="))
            bound, n = fresh(), fresh()
            f = F.min if low else F.max
            one = own.df.agg(f(other.col).alias(bound), F.count(F.lit(1)).alias(n))
            holds = compare(op, v, replace(other, col=bound).value())
            df = rel.df.crossJoin(F.broadcast(one))  # one row
            keep = F.coalesce(holds, F.lit(False)) & (F.col(n) > 0) if c.op == "any" else (F.col(n) == 0) | F.coalesce(holds, F.lit(False))
            return Rel(df.filter(keep), rel.lanes, rel.order)
        holds = F.coalesce(compare(op, v, other.value()), F.lit(False))
        w = other.value()
        if c.op == "any" and op == "=" and (is_plain(v) and is_plain(w) or v.kind == w.kind and v.kind in ("integer", "double", "float", "boolean", "date", "dateTime")):
            holds = (v.col == w.col) & holds  # a key to join by
        return Rel(rel.df.join(own.df.distinct(), holds if c.op == "any" else ~holds, "left_semi" if c.op == "any" else "left_anti"), rel.lanes, rel.order)

    def flagged(self, rel: Rel, e: Any) -> tuple[Rel, Any]:
        """Replace EXISTS and sub-query tests inside an expression by flag columns."""
        if not _has_exists(e):
            return rel, e
        if isinstance(e, list):
            out = []
            for x in e:
                rel, y = self.flagged(rel, x)
                out.append(y)
            return rel, out
        if e.op in ("exists", "notexists", "any", "all", "insub"):
            flag = fresh()
            if e.op in ("exists", "notexists"):
                own, conds = self.inner(rel, e.args[0])
                shared = [n for n in rel.lanes if n in own.lanes]
                if shared and not conds and not any(own.lanes[n].null or rel.lanes[n].null for n in shared):
                    seen = own.df.select(*[own.lanes[n].col for n in shared]).distinct().withColumn(flag + "x", F.lit(True))
                    df = rel.df.join(seen, self.on(rel, own, shared), "left").withColumn(flag, F.col(flag + "x").isNotNull())
                    return Rel(df, rel.lanes, rel.order), E("flag", [flag, e.op == "exists"])
            row = fresh()
            with_row = numbered(rel, row)
            hit = self.filtered(with_row, e if e.op != "notexists" else E("exists", e.args)).df.select(F.col(row).alias(row + "h")).distinct()
            df = with_row.df.join(hit, F.col(row) == F.col(row + "h"), "left").withColumn(flag, F.col(row + "h").isNotNull())
            return Rel(df, rel.lanes, rel.order), E("flag", [flag, e.op != "notexists"])
        args = []
        for a in e.args:
            rel, b = self.flagged(rel, a) if isinstance(a, (E, list)) else (rel, a)
            args.append(b)
        return rel, E(e.op, args)

    # modifiers
    def _extend(self, node: Extend) -> Rel:
        self.first |= fork_variables(node.value)
        rel, e = self.flagged(self.compile(node.child), node.value)
        if e.op == "var" and e.args[0] in rel.lanes:
            return Rel(rel.df, rel.lanes | {node.var: rel.lanes[e.args[0]]}, rel.order)
        # an error leaves the variable unbound, and no later pattern may bind it
        sure = e.op == "const"
        return rel.with_value(node.var, self.value(e, rel), null=not sure, poisoned=not sure)

    def _group(self, node: Group) -> Rel:
        rel = self.compile(node.child)
        lanes: dict[str, Lane] = {}
        for name, e in node.keys:
            rel, e = self.flagged(rel, e)
            lane, col = to_lane(self.value(e, rel))
            rel = Rel(rel.df.withColumn(lane.col, col), rel.lanes)
            lanes[name] = replace(lane, null=True)
        aggregates = [(name, *self.aggregate(e, rel)) for name, e in node.aggregates]
        keys = [x.col for x in lanes.values()]
        hidden = {f"{fresh()}": c for _, cols, _ in aggregates for c in cols}
        names = iter(hidden)
        finish = []
        for name, cols, final in aggregates:
            own = [next(names) for _ in cols]
            finish.append((name, final, own))
        if not hidden:
            out = Rel(rel.df.select(*keys).distinct() if keys else rel.df.limit(1), lanes)
        else:
            out = Rel(rel.df.groupBy(*keys).agg(*[c.alias(n) for n, c in hidden.items()]), lanes)
        for name, final, own in finish:
            out = out.with_value(name, final(*[F.col(n) for n in own]), null=True)
        return out

    def aggregate(self, e: E, rel: Rel) -> tuple[list[Column], Callable[..., V]]:
        """Spark aggregates of an aggregate expression and how its value is made of them."""
        name, distinct, arg, separator = e.args
        if arg is None:
            if not distinct:
                return [F.count(F.lit(1))], lambda n: V("integer", n)
            rows = F.struct(*[F.col(x.col) for x in rel.lanes.values()]) if rel.lanes else F.lit(1)
            return [F.count_distinct(rows)], lambda n: V("integer", n)
        v = self.value(arg, rel)
        own = v.col if v.kind in ("integer", "double", "float", "decimal", "boolean", "dateTime", "date", "iri") else to_term(v)
        if v.kind == "iri" and v.extra:
            own = v.extra[1]
        if name == "COUNT":
            return [F.count_distinct(own) if distinct else F.count(own)], lambda n: V("integer", n)
        if name in ("SUM", "AVG"):
            if v.kind in ("integer", "decimal", "float", "double"):
                if name == "SUM":
                    col = v.col if v.kind == "integer" else v.col.cast("double")
                    total = F.sum_distinct(col) if distinct else F.try_sum(col)
                    return [total, F.count(col)], lambda s, n: V(v.kind, F.when(n == 0, F.lit(0).cast("long" if v.kind == "integer" else "double")).otherwise(s))
                col = v.col.cast("double")
                mean = F.sum_distinct(col) / F.count_distinct(col) if distinct else F.avg(col)
                return [mean], lambda m: V("decimal" if v.kind == "integer" else v.kind, F.coalesce(m, F.lit(0.0)))
            t = to_term(v)
            n = number(v) if number(v) is not None else F.lit(None).cast("double")
            wrong = F.max(F.when(t.isNotNull() & n.isNull(), 1).otherwise(0))
            top = F.max(rank(v))
            pairs = F.collect_set(F.when(n.isNotNull(), F.struct(t.alias("t"), n.alias("n")))) if distinct else None
            total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["n"]) if distinct else F.sum(n)
            count = F.size(pairs) if distinct else F.count(n)
            if name == "SUM":
                return [wrong, top, total], lambda w, r, s: V("num", F.when(w == 0, F.coalesce(s, F.lit(0.0))), F.coalesce(r, F.lit(0)))
            return [wrong, top, total, count], lambda w, r, s, k: V("num", F.when(w == 0, F.when(k == 0, 0.0).otherwise(F.try_divide(s, k.cast("double")))), F.when(k == 0, 0).otherwise(F.greatest(r, F.lit(1))))
        if name in ("MIN", "MAX"):
            f = F.min if name == "MIN" else F.max
            if v.kind in ("integer", "decimal", "float", "double", "boolean", "dateTime", "date"):
                return [f(v.col)], lambda x: V(v.kind, x)
            if is_plain(v):
                return [f(v.col)], lambda x: V("lit", x)
            t = to_term(v)
            by = F.min_by if name == "MIN" else F.max_by
            return [by(t, F.struct(*sort_keys(V("term", t))))], lambda x: V("term", x)
        if name == "SAMPLE":
            if v.kind in ("integer", "decimal", "float", "double", "boolean", "dateTime", "date"):
                return [F.any_value(v.col, F.lit(True))], lambda x: V(v.kind, x)
            if is_plain(v):
                return [F.any_value(v.col, F.lit(True))], lambda x: V("lit", x)
            if v.kind == "iri" and v.extra:
                return [F.any_value(v.extra[1], F.lit(True))], lambda x: V("iri", F.concat(F.lit(v.extra[0]), x.cast("string")), (v.extra[0], x))
            return [F.any_value(to_term(v), F.lit(True))], lambda x: V("term", x)
        text = lexical(v)
        listed = F.sort_array(F.collect_set(text) if distinct else F.collect_list(text))
        return [F.array_join(listed, separator)], lambda x: V("lit", x)

    def _orderby(self, node: OrderBy) -> Rel:
        rel = self.compile(node.child)
        order = []
        for e, up in node.keys:
            rel, e = self.flagged(rel, e)
            for c in sort_keys(self.value(e, rel)):
                name = fresh()
                rel = Rel(rel.df.withColumn(name, c), rel.lanes, rel.order)
                order.append(F.col(name).asc_nulls_first() if up else F.col(name).desc_nulls_last())
        return Rel(rel.df, rel.lanes, order)

    def _project(self, node: Project) -> Rel:
        rel = self.compile(node.child)
        names = node.names if node.names is not None else [n for n in rel.lanes if not n.startswith((".", "_:"))]
        return Rel(rel.df, {n: rel.lanes[n] for n in names if n in rel.lanes}, rel.order)

    def _distinct(self, node: Distinct) -> Rel:
        rel = self.compile(node.child)
        if not rel.lanes:
            return Rel(rel.df.limit(1), {}, rel.order)
        return Rel(rel.df.dropDuplicates(list(dict.fromkeys(x.col for x in rel.lanes.values()))), rel.lanes, rel.order)

    def _reduced(self, node: Reduced) -> Rel:
        child = node.child
        if isinstance(child, Project) and isinstance(child.child, Values) and child.names in (None, child.child.names):
            rows = [r for i, r in enumerate(child.child.rows) if i == 0 or r != child.child.rows[i - 1]]
            return self.compile(Values(child.child.names, rows))
        return self._distinct(Distinct(child))

    def _slice(self, node: Slice) -> Rel:
        rel = self.compile(node.child)
        df = rel.sorted()
        if node.offset:
            df = df.offset(node.offset)
        if node.limit is not None:
            df = df.limit(node.limit)
        return Rel(df, rel.lanes, rel.order)

    # expressions
    def value(self, e: E, rel: Rel) -> V:
        op, a = e.op, e.args
        if op == "var":
            return rel.lanes[a[0]].value() if a[0] in rel.lanes else null()
        if op == "const":
            return constant(a[0])
        if op == "flag":
            return L.boolean(F.col(a[0]) if a[1] else ~F.col(a[0]))
        if op == "&&":
            out = ebv(self.value(a[0], rel))
            for x in a[1:]:
                out = out & ebv(self.value(x, rel))
            return L.boolean(out)
        if op == "||":
            return L.boolean(ebv(self.value(a[0], rel)) | ebv(self.value(a[1], rel)))
        if op == "!":
            return L.boolean(~ebv(self.value(a[0], rel)))
        if op in ("=", "!=", "<", "<=", ">", ">="):
            return L.boolean(compare(op, self.value(a[0], rel), self.value(a[1], rel)))
        if op in ("+", "-", "*", "/"):
            return arithmetic(op, self.value(a[0], rel), self.value(a[1], rel))
        if op == "neg":
            return arithmetic("-", constant(Literal("0", XSD + "integer")), self.value(a[0], rel))
        if op in ("in", "notin"):
            v = self.value(a[0], rel)
            hit = F.lit(False)
            for x in a[1]:
                hit = hit | compare("=", v, self.value(x, rel))
            hit = F.when(v.col.isNotNull(), hit)
            return L.boolean(hit if op == "in" else ~hit)
        if op == "like":
            v = self.value(a[0], rel)
            text = lexical(v)
            want = "".join("%" if c == "*" else "\\" + c if c in "%_\\" else c for c in a[1])
            return L.boolean(F.lower(text).like(want.lower()) if a[2] else text.like(want))
        if op == "call":
            return self.call(a[0], [self.value(x, rel) for x in a[1]])
        if op == "fn":
            return self.function(a[0], a[1], rel)
        raise CompileFault(f"unknown expression {op}")

    def call(self, iri: str, args: list[V]) -> V:
        if iri == L.FORK_IRI:
            if len(args) < 2:
                raise CompileFault("a fork needs a count and a variable")
            return L.fork(self.fork, *args)
        f = L.REGISTRY.get(iri) or L.CASTS.get(iri)
        if f is None:
            raise L.UnknownFunction(f"unknown function <{iri}>")
        return f(*args)

    def function(self, name: str, args: list[E], rel: Rel) -> V:
        if name == "BOUND":
            return L.boolean(F.col(rel.lanes[args[0].args[0]].col).isNotNull() if args[0].args[0] in rel.lanes else F.lit(False))
        if name == "NOW":
            return V("dateTime", F.lit(self.now).cast("timestamp_ntz"))
        vs = [self.value(x, rel) for x in args]
        if name == "COALESCE":
            kinds = {(v.kind, v.extra[0] if v.kind == "iri" and v.extra else None) for v in vs}
            if len(kinds) == 1 and vs[0].kind not in ("lit", "num", "iri"):
                return V(vs[0].kind, F.coalesce(*[v.col for v in vs]))
            if all(map(is_plain, vs)):
                return V("lit", F.coalesce(*[v.col for v in vs]))
            return V("term", F.coalesce(*[to_term(v) for v in vs]))
        if name == "IF":
            c, x, y = ebv(vs[0]), vs[1], vs[2]
            if x.kind == y.kind and x.kind not in ("lit", "num", "iri"):
                return V(x.kind, F.when(c, x.col).when(~c, y.col))
            if is_plain(x) and is_plain(y):
                return V("lit", F.when(c, x.col).when(~c, y.col))
            return V("term", F.when(c, to_term(x)).when(~c, to_term(y)))
        if name == "SAMETERM":
            return L.boolean(to_term(vs[0]) == to_term(vs[1]))
        if name in ("IRI", "URI"):
            v = vs[0]
            s = lexical(v)
            absolute = s.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
            if v.kind == "iri":
                return v
            return V("iri", F.when(absolute, s).otherwise(_resolved(self.base, s) if self.base else F.lit(None).cast("string")))
        if name == "BNODE":
            row = F.sha1(F.concat_ws("|", *[F.coalesce(x.term(), F.lit("")) for x in rel.lanes.values()])) if rel.lanes else F.lit("")
            return V("bnode", F.concat(F.lit("_:b"), F.sha1(F.concat(lexical(vs[0]), row)) if vs else F.replace(F.uuid(), F.lit("-"), F.lit(""))))
        f = L.LIBRARY.get(name)
        if f is None:
            raise L.UnknownFunction(f"unknown function {name}")
        return f(*vs)


def _resolved(base: str, s: Column) -> Column:
    """A relative reference against base, as terms.resolve() has it."""
    scheme, rest = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*:)?(.*)", base.partition("#")[0], re.S).groups()
    authority, path, query = re.fullmatch(r"(//[^/?]*)?([^?]*)(\?.*)?", rest, re.S).groups()
    root = (scheme or "") + (authority or "")
    folder = path[: path.rfind("/") + 1] or ("/" if authority else "")
    own, more = F.regexp_extract(s, r"^([^?#]*)", 1), F.regexp_extract(s, r"^[^?#]*([?#].*)?$", 1)
    segments = F.split(F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.lit(folder), own)), "/")
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x))))
    kept = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    whole = F.concat(F.lit(root), F.array_join(kept, "/"), more)
    same = F.when(F.startswith(s, F.lit("?")), F.concat(F.lit(root + path), s)).otherwise(F.concat(F.lit(root + path + (query or "")), s))
    return F.when((s == "") | F.startswith(s, F.lit("#")) | F.startswith(s, F.lit("?")), same).when(F.startswith(s, F.lit("//")), F.concat(F.lit(scheme or ""), s)).otherwise(whole)


def is_loose(x: Lane) -> bool:
    """An unbound value there agrees with any other."""
    return x.null and not x.poisoned


def by_unbound(rel: Rel, names: list[str]) -> list[tuple[Rel, set[str]]]:
    """rel's rows by which of the variables they leave unbound, and these."""
    parts: list[tuple[Rel, set[str]]] = [(rel, set())]
    for n in names:
        lane = rel.lanes[n]
        if is_loose(lane):
            there, col = replace(lane, null=False), F.col(lane.col)
            parts = [part for r, free in parts for part in ((Rel(r.df.filter(col.isNotNull()), r.lanes | {n: there}), free), (Rel(r.df.filter(col.isNull()), r.lanes), free | {n}))]
    return parts


def numbered(rel: Rel, row: str) -> Rel:
    """rel with a number of each row in column row; staged, so that every use sees the same numbers."""
    return Rel(stage(rel.df.withColumn(row, F.monotonically_increasing_id()), "rows"), rel.lanes, rel.order)


def _is_search(t: Any) -> bool:
    return isinstance(t, Literal) and t.dt == QF + "search"


def _conjuncts(e: E) -> list[E]:
    return [c for a in e.args for c in _conjuncts(a)] if e.op == "&&" else [e]


def _has_exists(e: Any) -> bool:
    if isinstance(e, list):
        return any(map(_has_exists, e))
    return isinstance(e, E) and (e.op in ("exists", "notexists", "any", "all", "insub") or any(map(_has_exists, e.args)))


def output(rel: Rel, as_terms: bool = False, as_text: bool = False) -> DataFrame:
    """The relation's visible variables as columns of their names: native columns, N-Triples text with
    as_terms, or with as_text what STR() gives (for blank nodes their labels)."""
    cols = []
    for n, x in rel.lanes.items():
        if n.startswith((".", "_:")):
            continue
        native = x.value() if x.kind not in ("key", "iri") else V("iri", lexical(x.value()))
        cols.append((x.term() if as_terms else F.coalesce(lexical(x.value()), x.term()) if as_text else native.col).alias(n))
    return rel.sorted().select(*cols)

