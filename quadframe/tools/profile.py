"""Query plans with estimated sizes, without running them."""

from __future__ import annotations

from ..engine import Engine
from ..plans.algebra import BGP, E, Node
from ..plans.cardinality import estimate, fork_variables, ordered


def profile(engine: Engine, text: str, spark_plan: bool = False) -> str:
    """The algebra as written and with patterns in join order, each node with its estimate in brackets."""
    q = engine.parse(text)
    first = fork_variables(q.root)
    out = ["Original query:", *_lines(q.root, engine, first, False, 1), "Optimised query:", *_lines(q.root, engine, first, True, 1)]
    if spark_plan:
        out += ["Spark plan:", engine.query(q)._jdf.queryExecution().explainString(engine.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))]
    return "\n".join(out)


def _lines(node: Node, engine: Engine, first: set[str], best: bool, depth: int) -> list[str]:
    size = estimate(node, set(), first, engine.stats)
    plain = {k: v for k, v in vars(node).items() if not isinstance(v, (Node, E)) and not (isinstance(v, list) and v and isinstance(v[0], Node))}
    out = ["  " * depth + f"{type(node).__name__} [{size:.6g}]" + (f" {plain}" if plain else "")]
    children = [v for v in vars(node).values() if isinstance(v, Node)]
    if isinstance(node, BGP):
        children = ordered(node.patterns, set(), first, engine.stats) if best else node.patterns
    for c in children:
        out += _lines(c, engine, first, best, depth + 1)
    return out
