"""Query algebra."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..terms import Var


@dataclass
class Node:
    pass


@dataclass
class Unit(Node):
    pass


@dataclass
class Pattern(Node):
    """s, p, o: terms or Var; g: None (default graph), a term or a Var."""

    s: Any
    p: Any
    o: Any
    g: Any = None


@dataclass
class Path(Node):
    """Closure of a path between s and o; low is 0 or 1, high is 1 or None (unlimited)."""

    s: Any
    step: Node
    start: Var
    end: Var
    low: int
    high: int | None
    o: Any
    g: Any = None


@dataclass
class BGP(Node):
    patterns: list[Node] = field(default_factory=list)


@dataclass
class Join(Node):
    left: Node
    right: Node


@dataclass
class LeftJoin(Node):
    left: Node
    right: Node
    condition: E | None = None


@dataclass
class Union(Node):
    left: Node
    right: Node


@dataclass
class Minus(Node):
    left: Node
    right: Node


@dataclass
class Intersect(Node):
    left: Node
    right: Node


@dataclass
class Filter(Node):
    condition: E
    child: Node


@dataclass
class Extend(Node):
    child: Node
    var: str
    value: E


@dataclass
class Values(Node):
    names: list[str]
    rows: list[list]


@dataclass
class External(Node):
    """Rows of a DataFrame: columns are variables, string columns N-Triples text, others literals."""

    df: Any


@dataclass
class Group(Node):
    child: Node
    keys: list[tuple[str, E]]
    aggregates: list[tuple[str, E]]


@dataclass
class OrderBy(Node):
    child: Node
    keys: list[tuple[E, bool]]


@dataclass
class Project(Node):
    child: Node
    names: list[str] | None


@dataclass
class Distinct(Node):
    child: Node


@dataclass
class Reduced(Node):
    child: Node


@dataclass
class Slice(Node):
    child: Node
    offset: int
    limit: int | None


@dataclass
class Service(Node):
    target: Any
    silent: bool
    child: Node


@dataclass
class E:
    """Expression: op and arguments (E, terms or plain values by op)."""

    op: str
    args: list = field(default_factory=list)


@dataclass
class Query:
    form: str  # SELECT, ASK, CONSTRUCT, DESCRIBE
    root: Node
    template: list[tuple] = field(default_factory=list)
    described: list = field(default_factory=list)
    default_graphs: list[str] = field(default_factory=list)
    named_graphs: list[str] = field(default_factory=list)
    has_dataset: bool = False
    base: str | None = None
    where: Node | None = None


@dataclass
class Update:
    kind: str
    where: Node | None = None
    insert: list[tuple] = field(default_factory=list)
    delete: list[tuple] = field(default_factory=list)
    using: list[str] = field(default_factory=list)
    using_named: list[str] = field(default_factory=list)
    source: Any = None
    target: Any = None
    silent: bool = False


def substituted(node: Any, old: Node, new: Node) -> Any:
    """The tree with one node replaced."""
    if node is old:
        return new
    if isinstance(node, Node):
        for name, x in vars(node).items():
            if isinstance(x, Node):
                setattr(node, name, substituted(x, old, new))
    return node


def variables(node: Any) -> set[str]:
    """Variables in scope above a node."""
    if isinstance(node, Pattern):
        return {t.name for t in (node.s, node.p, node.o, node.g) if isinstance(t, Var)}
    if isinstance(node, Path):
        return {t.name for t in (node.s, node.o, node.g) if isinstance(t, Var)}
    if isinstance(node, BGP):
        return set().union(*map(variables, node.patterns)) if node.patterns else set()
    if isinstance(node, (Join, LeftJoin, Union)):
        return variables(node.left) | variables(node.right)
    if isinstance(node, (Minus, Intersect)):
        return variables(node.left)
    if isinstance(node, Extend):
        return variables(node.child) | {node.var}
    if isinstance(node, Values):
        return set(node.names)
    if isinstance(node, External):
        return set(node.df.columns)
    if isinstance(node, Group):
        return {k for k, _ in node.keys} | {k for k, _ in node.aggregates}
    if isinstance(node, Project):
        return variables(node.child) if node.names is None else set(node.names)
    if isinstance(node, (Filter, OrderBy, Distinct, Reduced, Slice, Service)):
        return variables(node.child)
    return set()


def used(e: Any) -> set[str]:
    """Variables that an expression reads, those inside EXISTS included."""
    if isinstance(e, E):
        if e.op == "var":
            return {e.args[0]}
        return set().union(*map(used, e.args)) if e.args else set()
    if isinstance(e, Filter):
        return used(e.condition) | used(e.child)
    if isinstance(e, Node):
        inner = [used(x) for x in vars(e).values() if isinstance(x, (Node, E))]
        return variables(e).union(*inner)
    if isinstance(e, (list, tuple)):
        return set().union(*map(used, e)) if e else set()
    return set()
