"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Slot k of the schedule belongs to the source in whose share of [0, 1) the golden-ratio point frac(k * phi)
falls, so every stretch of the schedule holds the sources in nearly their shares. The r-th slot of a source
takes words r * block .. (r + 1) * block of that source's documents, laid end to end in hashed order and
repeated as often as the target needs; a source that the points leave short gets its last slots at the end.
Ranks and running sums are taken in two steps (within a bucket, then over bucket totals), so no source,
however large, meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3
BLOCK_WORDS = 1024
WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949
_SLOTS_PER_CHUNK = 4096
_CELLS = 4096
_ROWS_PER_BUCKET = 2000


def order_key(id_col: str, text_col: str) -> Column:
    """Where a document lies among its source's: the hash of id and text."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.md5(text_col), F.lit(""))))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size in words, and order_key."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), order_key(id_col, text_col).alias("order_key"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: source, s (its number), n_docs, source_size, target, words (the target in
    whole words), low and high (its share of the schedule)."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int"))
    base = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    base = base.withColumn("s", F.row_number().over(by_name) - 1).withColumn("w", weight).withColumn("most", max_passes * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), "s")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double")
    level = base.withColumn("level", rest / F.sum("w").over(after)).withColumn("ratio", F.col("most") / F.col("w"))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "s", "level"))).over(every)
    level = level.withColumn("first", first)
    capped = F.struct("ratio", "s") < F.struct(F.col("first.ratio"), F.col("first.s"))
    out = level.withColumn("target", F.when(capped, F.col("most").cast("double")).otherwise(F.col("first.level") * F.col("w")))
    out = out.withColumn("words", F.floor(F.col("target") + 0.5))
    upto, total = F.sum("words").over(Window.orderBy("s")), F.sum("words").over(every)
    return out.select("source", "s", "n_docs", "source_size", "target", "words", ((upto - F.col("words")) / total).alias("low"), (upto / total).alias("high"))


def schedule(shares: DataFrame, block: int) -> DataFrame:
    """(s, rank, slot): which source each slot draws on, and how many slots it had before."""
    spark = shares.sparkSession
    n = shares.agg(F.sum(F.ceil(F.col("words") / block))).collect()[0][0] or 0
    point = F.col("slot") * F.lit(GOLDEN)
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumn("u", point - F.floor(point)).withColumn("cell", F.floor(F.col("u") * _CELLS))
    covered = F.sequence(F.floor(F.col("low") * _CELLS), F.least(F.floor(F.col("high") * _CELLS), F.lit(_CELLS).cast("long")))
    spans = shares.filter("words > 0").select("s", "low", "high", F.explode(covered).alias("cell"))
    drawn = slots.join(spans, "cell").filter("u >= low AND u < high").select("s", "slot", F.floor(F.col("slot") / _SLOTS_PER_CHUNK).alias("chunk"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = drawn.groupBy("s", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before)
    within = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("within", within).join(chunks, ["s", "chunk"]).select("s", (F.col("before") + F.col("within")).alias("rank"), "slot")
    had = chunks.groupBy("s").agg(F.sum("n").alias("had"))
    need = F.ceil(F.col("words") / block)
    short = shares.join(had, "s", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter(need > F.col("had"))
    extra = short.select("s", F.explode(F.sequence(F.col("had"), need - 1)).alias("rank")).withColumn("slot", F.lit(n) + F.col("rank"))
    used = ranked.join(shares.select("s", "words"), "s").filter(F.col("rank") * block < F.col("words")).select("s", "rank", "slot")
    return used.unionByName(extra)


def _laid_out(sizes: DataFrame, shares: DataFrame, rows: int) -> DataFrame:
    """Documents with `at`, their first word's place in their source's stream, and a unique (s, bucket, nth)."""
    digits = max(1, min(8, math.ceil(math.log(max(1, rows / _ROWS_PER_BUCKET), 16))))
    d = sizes.withColumnRenamed("source", "of").join(shares, F.col("of").eqNullSafe(F.col("source"))).withColumn("bucket", F.substring("order_key", 1, digits))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = d.groupBy("s", "bucket").agg(F.sum("size").alias("n")).withColumn("before", before).select("s", "bucket", "before")
    w = Window.partitionBy("s", "bucket").orderBy("order_key", "doc_id", "size")
    d = d.withColumn("nth", F.row_number().over(w)).withColumn("upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.join(buckets, ["s", "bucket"]).withColumn("at", F.col("before") + F.col("upto") - F.col("size"))


def _least(a: Column, b: Column) -> Column:
    return F.when(a < b, a).otherwise(b)


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_passes: int = MAX_PASSES, block: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(per document, per slot and document). The first has doc_id, source, size, source_size, target,
    taken, order_key; the second source, slot, rank, doc_id, first_word (within the document's source stream), words.

    Null or wordless texts have size 0 and are taken 0 times; a null source is a source of its own, the
    last; repeated rows count each; an empty table gives no rows. Other columns are not read. Documents
    that share an id lie apart, by the hash of their texts.
    """
    sizes = common.stage(sized(docs, id_col, text_col, source_col), "sizes")
    shares = common.stage(targets(sizes, weights, max_passes), "shares")
    rows = shares.agg(F.sum("n_docs")).collect()[0][0] or 0
    slots = schedule(shares, block)
    d = _laid_out(sizes, shares, rows)
    words, size = F.col("words"), F.col("source_size")
    passes = F.when((F.col("size") > 0) & (words > F.col("at")), F.sequence(F.lit(0).cast("long"), F.floor((words - F.col("at") - 1) / size)))
    d = d.withColumn("pass", F.explode_outer(passes)).withColumn("from", F.col("pass") * size + F.col("at"))
    d = d.withColumn("to", _least(F.col("from") + F.col("size"), words))
    d = d.withColumn("rank", F.explode_outer(F.when(F.col("pass").isNotNull(), F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block)))))
    d = d.withColumn("first_word", F.greatest("from", F.col("rank") * block)).withColumn("part", _least(F.col("to"), (F.col("rank") + 1) * block) - F.col("first_word"))
    placed = d.select("s", "bucket", "nth", "order_key", "doc_id", "source", "size", "source_size", "target", "rank", "first_word", "part").join(slots, ["s", "rank"], "left")
    taken = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("part"))), F.lit(0)).alias("taken")
    per_doc = placed.groupBy("s", "bucket", "nth", "order_key", "doc_id", "source", "size", "source_size", "target").agg(taken)
    per_slot = placed.filter("slot IS NOT NULL").select("source", "slot", "rank", "doc_id", (F.col("first_word") % F.col("source_size")).alias("first_word"), F.col("part").alias("words"))
    return per_doc.select("doc_id", "source", "size", "source_size", "target", "taken", "order_key"), per_slot


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs' rows, each repeated as often as the mixture takes it, to the nearest whole time.

    Of rows that share an id, each is repeated for itself; equal rows, alike. Rows without words, null and empty texts
    among them, go; a null source is a source of its own; a null id is an id. An empty table gives no rows.
    Other columns may have any names and are kept.
    """
    key, of, source, times, nth = common.unused(docs, "_key", "_of", "_source", "_times", "_nth")
    per_doc, _ = mixture(docs, **options)
    taken = per_doc.filter("taken > 0").select(F.col("order_key").alias(of), F.col("source").alias(source), F.floor(F.col("taken") / F.col("size") + 0.5).alias(times))
    taken = taken.groupBy(of, source).agg(F.max(times).alias(times)).filter(F.col(times) > 0)
    joined = docs.withColumn(key, order_key("doc_id", "text")).join(taken, (F.col(key) == F.col(of)) & F.col("source").eqNullSafe(F.col(source)))
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*[f"`{c}`" for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS k FROM documents),
b AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS s FROM d GROUP BY source),
w AS (SELECT *, CASE s % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3 * source_size AS most FROM b),
r AS (SELECT *, CAST(most AS DOUBLE) / w AS ratio FROM w),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM b) - coalesce(sum(most) OVER (ORDER BY ratio, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                / sum(w) OVER (ORDER BY ratio, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT ratio, s, level FROM l WHERE level <= ratio ORDER BY ratio, s LIMIT 1),
t AS (SELECT l.*, CASE WHEN (l.ratio, l.s) < (f.ratio, f.s) THEN CAST(most AS DOUBLE) ELSE f.level * l.w END AS target FROM l, f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS words,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY t.s ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * size + greatest(0, least(size, words % source_size - pos)) END AS taken FROM p
"""
