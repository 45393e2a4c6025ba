"""Estimated result sizes of patterns, which order joins and annotate profiles."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..functions.library import FORK_IRI
from ..terms import QF, IRI, Literal, Var
from .algebra import BGP, E, Extend, Filter, Intersect, Join, LeftJoin, Minus, Node, Path, Pattern, Service, Union, Unit, Values

# Fixed values of the model: a free position, a text search, and how far a fork variable lowers a pattern.
FREE, SEARCH, PRIORITY, UNKNOWN_CONSTANT = 10.0, 0.0001, 1e6, 100.0


@dataclass
class Statistics:
    """Counts of a dataset: all triples, and triples by subject, predicate, object (term text)."""

    triples: float = 0
    parts: dict[tuple[str, str], float] = field(default_factory=dict)

    def estimate(self, p: Pattern, bound: set[str]) -> float:
        sizes = []
        for role, t in (("s", p.s), ("p", p.p), ("o", p.o)):
            if isinstance(t, Var):
                if t.name in bound:
                    sizes.append(self.triples**0.5)
            else:
                sizes.append(self.parts.get((role, t.n3()), UNKNOWN_CONSTANT))
        if not sizes:
            return self.triples
        if len(sizes) == 3:
            return 1.0
        out = sizes[0]
        for x in sizes[1:]:
            out = out * x / max(1.0, self.triples)
        return out


def fork_variables(node: Any) -> set[str]:
    """Variables given to the fork function anywhere below: they come first."""
    if isinstance(node, E):
        if node.op == "call" and node.args[0] == FORK_IRI:
            return {a.args[0] for a in node.args[1] if a.op == "var"}
        return set().union(*map(fork_variables, node.args)) if node.args else set()
    if isinstance(node, (list, tuple)):
        return set().union(*map(fork_variables, node)) if node else set()
    return set().union(*map(fork_variables, vars(node).values())) if isinstance(node, Node) and vars(node) else set()


def estimate(node: Node, bound: set[str] = frozenset(), first: set[str] = frozenset(), stats: Statistics | None = None) -> float:
    from .algebra import variables

    if isinstance(node, Pattern):
        if isinstance(node.o, Literal) and node.o.dt == QF + "search":
            return SEARCH
        if stats and stats.triples:
            size = stats.estimate(node, set(bound))
        else:
            size = 1.0
            for t in (node.s, node.p, node.o, node.g):
                if isinstance(t, Var) and t.name not in bound:
                    size *= FREE
        for v in {t.name for t in (node.s, node.p, node.o, node.g) if isinstance(t, Var)} & set(first):
            size /= PRIORITY
        return size
    if isinstance(node, Path):
        return estimate(Pattern(node.s, IRI("path"), node.o, node.g), bound, first) * 10
    if isinstance(node, BGP):
        size, seen = 1.0, set(bound)
        for p in ordered(node.patterns, seen, first, stats):
            size = joined(size, estimate(p, seen, first, stats))
            seen |= variables(p)
        return size
    if isinstance(node, (Join, LeftJoin)):
        left = estimate(node.left, bound, first, stats)
        return joined(left, estimate(node.right, set(bound) | variables(node.left), first, stats))
    if isinstance(node, (Union, Minus, Intersect)):
        return estimate(node.left, bound, first, stats) + estimate(node.right, bound, first, stats)
    if isinstance(node, Values):
        return float(len(node.rows))
    if isinstance(node, Unit):
        return 1.0
    child = getattr(node, "child", None)
    if isinstance(node, (Filter, Extend, Service)) or child is not None:
        return estimate(child, bound, first, stats)
    return 1.0


def joined(left: float, right: float) -> float:
    """Cost of a join: the left side weighs twice, so that small left sides win."""
    return right * left * left


def ordered(patterns: list[Node], bound: set[str], first: set[str], stats: Statistics | None = None) -> list[Node]:
    """Greedy order: always the pattern with the fewest estimated results, connected ones before others."""
    from .algebra import variables

    left, out, seen = list(patterns), [], set(bound)
    while left:
        linked = [p for p in left if variables(p) & seen] if seen and out else left
        best = min(linked or left, key=lambda p: estimate(p, seen, first, stats))
        left.remove(best)
        out.append(best)
        seen |= variables(best)
    return out
