"""Bulk load of RDF files into quads."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import os
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..terms import QF, BNode, IRI, Literal
from . import formats
from .dataset import QUADS

PREFIX_PREDICATE = QF + "namespacePrefix"
_SHORT = re.compile(r"[+-]?\d+|true|false|1|0")


def extension(path: str) -> tuple[str, str]:
    """(RDF extension, compression extension) of a file name."""
    name = path.lower()
    packed = next((x for x in (".gz", ".bz2") if name.endswith(x)), "")
    return os.path.splitext(name[: -len(packed)] if packed else name)[1], packed


def graph_name(pattern: str, uri: str) -> str:
    """{0}: the file's URI, {1}: its path, {2}: its name."""
    path = unquote(urlparse(uri).path) or uri
    return pattern.replace("{0}", uri).replace("{1}", path).replace("{2}", os.path.basename(path))


def files_under(spark: SparkSession, paths: str) -> list[str]:
    """Files under the comma-separated paths, of any store that Hadoop reads; folders are searched."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for p in paths.split(","):
        root = jvm.org.apache.hadoop.fs.Path(p.strip())
        fs = root.getFileSystem(conf)
        for status in fs.globStatus(root) or []:
            files = fs.listFiles(status.getPath(), True)
            while files.hasNext():
                out.append(files.next().getPath().toString())
    return sorted(set(out))


def load(spark: SparkSession, paths: str, graph: str | None = None, override: bool = False, skip_invalid: bool = False, verify_datatypes: bool = False, ontology: bool = False, splits: int = 1) -> DataFrame:
    """s, p, o, g of all RDF files under paths (folders are searched).

    graph: pattern of the graph of statements that have none; with override, of all statements (without a
    pattern, graphs are removed). skip_invalid leaves out bad lines, and what follows the first fault of
    other files. Blank nodes are renamed by file. Line formats, packed ones too, are read by Spark as streams
    and split where they can be. Prefixes that a document declares are kept as triples, as namespaces() reads
    them.
    """
    files = [f for f in files_under(spark, paths) if extension(f)[0] in formats.READERS]
    lines = [f for f in files if extension(f)[0] in (".nt", ".nq") and formats.READERS[extension(f)[0]] is formats.read_lines]
    rest = [f for f in files if f not in lines]
    schema = pa.schema([(n, pa.string()) for n in "spog"])

    def rows(path: str, quads: Iterator) -> Iterator[tuple]:
        mark = hashlib.sha1(path.encode()).hexdigest()[:8]
        own = graph_name(graph, path) if graph else None
        while True:
            try:
                q = next(quads)
                if verify_datatypes:
                    _verify(q[2])
            except StopIteration:
                return
            except Exception:
                if skip_invalid:
                    return
                raise
            s, p, o, g = (BNode(f"{t.label}f{mark}") if isinstance(t, BNode) else t for t in q)
            g = (IRI(own) if own else None) if override else g or (IRI(own) if own else None)
            yield s.n3(), p.n3(), o.n3(), g.n3() if g else None

    def batches(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held = []
        for r in found:
            held.append(r)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], schema=schema)

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ext, packed = extension(path)
                raw = gzip.decompress(content) if packed == ".gz" else bz2.decompress(content) if packed == ".bz2" else content
                options: dict = {"ontology": True} if ontology and ext == ".json" else {}
                prefixes: dict[str, str] = {}
                if ext in formats.WITH_PREFIXES:
                    options["prefixes"] = prefixes
                yield from batches(rows(path, _guarded(formats.READERS[ext], raw, path, skip_invalid, options)))
                yield from batches(iter(namespace_rows(prefixes, graph_name(graph, path) if graph else None)))

    def by_line(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for path, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if line.strip() and not line.lstrip().startswith("#"):
                    yield from batches(rows(path, _guarded(formats.read_lines, line.encode(), path, skip_invalid, {})))

    from ..ship import ship

    ship(spark)
    out = None
    if rest:
        df = spark.read.format("binaryFile").load(rest).select("path", "content")
        out = df.repartition(max(splits, min(len(rest), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(whole, QUADS)
    if lines:
        native = _native_lines(spark, lines, graph, override)
        if not skip_invalid:
            native = native.withColumn("s", F.when(F.col("ok") | F.col("odd"), F.col("s")).otherwise(F.raise_error(F.concat(F.lit("not a statement: "), F.col("line")))))
        good = native.filter("ok AND NOT odd").select("s", "p", "o", "g")
        odd = native.filter("odd").select("path", "line").mapInArrow(by_line, QUADS)
        good = good.unionByName(odd)
        out = good if out is None else out.unionByName(good)
    return out if out is not None else spark.createDataFrame([], QUADS)


def _guarded(reader, raw: bytes, path: str, skip: bool, options: dict) -> Iterator:
    try:
        yield from reader(raw.decode(), path, **options)
    except Exception:
        if not skip:
            raise


def _verify(o) -> None:
    if isinstance(o, Literal) and o.dt.endswith(("#integer", "#boolean")) and not _SHORT.fullmatch(o.lex):
        raise formats.SyntaxFault(f"bad value {o.lex!r} of <{o.dt}>")


def _native_lines(spark: SparkSession, files: list[str], graph: str | None, override: bool) -> DataFrame:
    """Statements by regular expression in the JVM. `odd` lines hold escapes or forms that need the parser."""
    df = spark.read.text(files).select(F.col("value").alias("line"), F.input_file_name().alias("path")).filter(~F.col("line").rlike(r"^\s*(#.*)?$"))
    pattern = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'
    cell = lambda k: F.regexp_extract("line", pattern, k)
    odd = F.col("line").rlike(r'\\[uUbf\']|XMLSchema#string>|"@[a-z-]*[A-Z]')
    mark = F.concat(F.lit("f"), F.substring(F.sha1("path"), 1, 8))
    named = lambda c: F.when(F.startswith(c, F.lit("_:")), F.concat(c, mark)).otherwise(c)
    own = F.lit(None).cast("string")
    if graph:
        file_path = F.regexp_replace("path", r"^[a-z0-9+.-]+:/*(?=/)", "")
        text = F.lit(graph)
        for k, v in (("{0}", F.col("path")), ("{1}", file_path), ("{2}", F.element_at(F.split("path", "/"), -1))):
            text = F.replace(text, F.lit(k), v)
        own = F.concat(F.lit("<"), text, F.lit(">"))
    g = own if override else F.coalesce(named(F.nullif(cell(4), F.lit(""))), own)
    return df.select("line", "path", F.col("line").rlike(pattern).alias("ok"), odd.alias("odd"), named(cell(1)).alias("s"), cell(2).alias("p"), named(cell(3)).alias("o"), g.alias("g"))


def write(quads: DataFrame, path: str, mode: str = "append", sort: bool = True) -> None:
    """Parquet ordered for lookups by predicate and subject, which row-group statistics then serve."""
    out = quads.select("s", "p", "o", "g")
    if sort:
        out = out.repartitionByRange("p", "s").sortWithinPartitions("p", "s", "o")
    out.write.mode(mode).parquet(path)


def namespace_rows(prefixes: dict[str, str], graph: str | None = None) -> list[tuple]:
    return [(IRI(ns).n3(), f"<{PREFIX_PREDICATE}>", Literal(p).n3(), f"<{graph}>" if graph else None) for p, ns in prefixes.items() if p]


def namespace_quads(spark: SparkSession, prefixes: dict[str, str], graph: str | None = None) -> DataFrame:
    return spark.createDataFrame(namespace_rows(prefixes, graph), QUADS)


def namespaces(quads: DataFrame) -> dict[str, str]:
    """Prefixes kept as triples; of several namespaces of one prefix, the first by name."""
    from ..terms import parse_term

    found = quads.filter(F.col("p") == f"<{PREFIX_PREDICATE}>").groupBy("o").agg(F.min("s").alias("s")).collect()
    return {parse_term(r["o"]).lex: parse_term(r["s"]).value for r in found}
