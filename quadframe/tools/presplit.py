"""Range split points for a balanced layout, from a sample of statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage, unstage
from .combine import pre_summed, shares


def split_points(quads: DataFrame, limit_bytes: int = 80_000_000, decimate: int = 1000, seed: int = 0) -> DataFrame:
    """(part, p, s): lower ends of ranges of about limit_bytes of text by predicate and subject. One in
    `decimate` statements is read; sums per predicate and subject prefix are taken before they are ordered.
    They are dealt in order to blocks, and a block's sums begin where those of the blocks before it end."""
    own = quads if decimate <= 1 else quads.sample(1 / decimate, seed)
    size = F.length("s") + F.length("p") + F.length("o") + F.coalesce(F.length("g"), F.lit(0))
    cells = own.select("p", F.substring("s", 1, 24).alias("s"), size.cast("long").alias("bytes"))
    n = shares(quads)
    some = stage(pre_summed(cells, "p string, s string, bytes long"), "split")  # ranges are found by a sample, which reads it once more
    sums = some.repartitionByRange(n, "p", "s").groupBy("p", "s").agg((F.sum("bytes") * max(1, decimate)).alias("bytes"))
    placed = stage(sums.withColumn("block", F.spark_partition_id()), "split")
    unstage(some)
    blocks = placed.groupBy("block", "p").agg(F.sum("bytes").alias("own"))
    ahead = blocks.select("block", "p", (F.sum("own").over(Window.partitionBy("p").orderBy("block")) - F.col("own")).alias("ahead"))
    by = Window.partitionBy("block", "p").orderBy("s")
    before = F.col("ahead") + F.sum("bytes").over(by) - F.col("bytes")
    parts = placed.repartitionByRange(n, "block", "p").join(F.broadcast(ahead), ["block", "p"]).withColumn("part", F.floor(before / limit_bytes))
    return parts.groupBy("p", "part").agg(F.min("s").alias("s")).select("part", "p", "s")
