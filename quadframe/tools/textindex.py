"""Full-text search of literals: query language, matching, and an inverted index."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import t_is, t_lex


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def matches(text: Column, query: str) -> Column:
    """terms, "phrases", AND / OR / NOT, -term, prefix*, parentheses; neighbours without a word mean OR."""
    parts = re.findall(r'"[^"]*"|[()]|[^\s()"]+', query)
    at, words = 0, tokens(text)

    def atom() -> Column:
        nonlocal at
        if at >= len(parts):
            raise ValueError(f"incomplete search {query!r}")
        t = parts[at]
        at += 1
        if t == "(":
            out = alternatives()
            at += 1
            return out
        if t.upper() == "NOT" or t == "-":
            return ~atom()
        if t.startswith("-") and len(t) > 1:
            at -= 1
            parts[at] = t[1:]
            return ~atom()
        own = [w for w in re.split(r"[\W_]+", t.strip('"').lower()) if w]
        if not own:
            return F.lit(True)
        if t.endswith("*"):
            return F.exists(words, lambda x: F.startswith(x, F.lit(own[-1])))
        if len(own) == 1:
            return F.array_contains(words, own[0])
        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        return F.contains(joined, F.lit(f" {' '.join(own)} "))

    def conjunction() -> Column:
        nonlocal at
        out = atom()
        while at < len(parts) and parts[at].upper() in ("AND", "&&"):
            at += 1
            out = out & atom()
        return out

    def alternatives() -> Column:
        nonlocal at
        out = conjunction()
        while at < len(parts) and parts[at] != ")":
            if parts[at].upper() in ("OR", "||"):
                at += 1
            if parts[at].upper() in ("NOT", "-") or parts[at].startswith("-"):
                out = out & conjunction()
            else:
                out = out | conjunction()
        return out

    return F.coalesce(alternatives(), F.lit(False)) if parts else F.lit(False)


def build(quads: DataFrame, graph: str | None = None) -> DataFrame:
    """(token, id, literal): one entry per token of each distinct literal; id is the hex SHA-1 of the
    literal's quoted text."""
    own = quads.filter(F.col("g") == f"<{graph}>") if graph else quads
    literals = own.filter(t_is(F.col("o"), '"')).select(F.col("o").alias("literal")).distinct()
    return literals.select(F.explode(F.array_distinct(tokens(t_lex(F.col("literal"))))).alias("token"), F.sha1("literal").alias("id"), "literal")


def documents(quads: DataFrame, graph: str | None = None) -> DataFrame:
    """(id, literal, label) per distinct literal, as a search server takes them."""
    own = quads.filter(F.col("g") == f"<{graph}>") if graph else quads
    literals = own.filter(t_is(F.col("o"), '"')).select(F.col("o").alias("literal")).distinct()
    return literals.select(F.sha1("literal").alias("id"), "literal", t_lex(F.col("literal")).alias("label"))


def lookup(index: DataFrame, words: list[str]) -> DataFrame:
    """Literals that hold any of the words, from the index."""
    return index.filter(F.col("token").isin(*[w.lower() for w in words])).select("id", "literal").distinct()
