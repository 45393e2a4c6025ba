"""Approximate schema summary: classes, properties, and what connects them, with log2 cardinalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import t_datatype, t_is
from ..staging import stage
from ..terms import QF, RDF, RDFS, XSD
from .combine import shares


def log2(n: Column) -> Column:
    """floor(log2 n), exactly."""
    return F.length(F.bin(n)) - 1


def summary(quads: DataFrame, decimate: int = 1, seed: int = 0) -> DataFrame:
    """(kind, predicate, domain, range, cardinality): kind is class (in `domain`), property, domain, range
    (a class or a literal's datatype) or slice (domain and range). One in `decimate` statements is read."""
    deals = shares(quads)
    every = quads.filter(F.col("g").isNull() | (F.col("g") != f"<{QF}statsContext>")).select("s", "p", "o")
    every = stage(every.repartition(deals, "s", "p", "o").distinct(), "summary")
    seen = every if decimate <= 1 else every.sample(1 / decimate, seed)
    types = every.filter((F.col("p") == f"<{RDF}type>") & t_is(F.col("o"), "<"))
    facts = seen.filter((F.col("p") != f"<{RDF}type>") & ~F.startswith(F.col("p"), F.lit(f"<{QF}")))
    # a literal counts by its datatype; other objects are counted before their classes are looked up, so a hot one is one row
    text = t_is(F.col("o"), '"')
    facts = facts.select("s", "p", text.alias("text"), F.when(text, F.concat(F.lit("<"), t_datatype(F.col("o")), F.lit(">"))).otherwise(F.col("o")).alias("to"))
    null = F.lit(None).cast("string")
    count, n = F.count(F.lit(1)).alias("n"), F.sum("n").alias("n")
    domains = types.select("s", F.col("o").alias("domain")).repartition(deals, "s")
    from_s = stage(facts.repartition(deals, "s").join(domains, "s").groupBy("p", "domain", "text", "to").agg(count), "summary")
    direct = stage(facts.groupBy("p", "text", "to").agg(count), "summary")

    def ranged(counted: DataFrame) -> DataFrame:
        classes = types.select(F.col("s").alias("to"), F.col("o").alias("range"))
        return counted.filter("text").withColumn("range", F.col("to")).unionByName(counted.filter(~F.col("text")).join(classes, "to"))

    classes = seen.filter((F.col("p") == f"<{RDF}type>") & t_is(F.col("o"), "<")).groupBy(F.col("o").alias("domain")).agg(count)
    parts = [
        classes.select(F.lit("class").alias("kind"), null.alias("predicate"), "domain", null.alias("range"), "n"),
        direct.groupBy("p").agg(n).select(F.lit("property").alias("kind"), F.col("p").alias("predicate"), null.alias("domain"), null.alias("range"), "n"),
        from_s.groupBy("p", "domain").agg(n).select(F.lit("domain").alias("kind"), F.col("p").alias("predicate"), "domain", null.alias("range"), "n"),
        ranged(direct).groupBy("p", "range").agg(n).select(F.lit("range").alias("kind"), F.col("p").alias("predicate"), null.alias("domain"), "range", "n"),
        ranged(from_s).groupBy("p", "domain", "range").agg(n).select(F.lit("slice").alias("kind"), F.col("p").alias("predicate"), "domain", "range", "n"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("kind", "predicate", "domain", "range", log2(F.col("n") * max(1, decimate)).alias("cardinality"))


def as_quads(summarised: DataFrame) -> DataFrame:
    """The summary as triples: a node per row, named by its hash."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("kind", "predicate", "domain", "range")])
    name = F.rtrim(F.translate(F.base64(F.unhex(F.sha1(key))), "+/", "-_"), F.lit("="))
    node = F.when(F.col("kind") == "class", F.col("domain")).when(F.col("kind") == "property", F.col("predicate")).otherwise(F.concat(F.lit(f"<{QF}"), F.col("kind"), F.lit("_"), name, F.lit(">")))
    kind = F.when(F.col("kind") == "class", f"<{RDFS}Class>").when(F.col("kind") == "property", f"<{RDF}Property>").otherwise(F.concat(F.lit(f"<{QF}"), F.initcap("kind"), F.lit(">")))
    cells = [(f"<{RDF}type>", kind), (f"<{QF}cardinality>", F.concat(F.lit('"'), F.col("cardinality").cast("string"), F.lit(f'"^^<{XSD}integer>')))]
    cells += [(f"<{QF}predicate>", F.when(~F.col("kind").isin("class", "property"), F.col("predicate"))), (f"<{RDFS}domain>", F.when(F.col("kind") != "class", F.col("domain"))), (f"<{RDFS}range>", F.col("range"))]
    rows = F.array(*[F.struct(node.alias("s"), F.lit(p).alias("p"), o.alias("o")) for p, o in cells])
    return summarised.select(F.explode(rows).alias("x")).select("x.*").filter("o IS NOT NULL").distinct().withColumn("g", F.lit(None).cast("string"))
