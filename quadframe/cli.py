"""Command line: python -m quadframe.cli COMMAND ..."""

from __future__ import annotations

import argparse
import os
import subprocess
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .operators.timeline import bulk_delete
from .operators.update import Updater, bulk_update
from .sources import load as loading
from .sources.dataset import Dataset, QuadTable
from .sources.writers import bulk_export, export, write_rdf
from .tools import presplit, profile, stats, summary, textindex

VERSION = "0.1.0"


class Once(argparse.Action):
    """An option that may be given only once."""

    def __call__(self, parser, namespace, value, option=None):
        if getattr(namespace, f"_{self.dest}_seen", False):
            parser.error(f"{option} is given twice")
        setattr(namespace, f"_{self.dest}_seen", True)
        setattr(namespace, self.dest, value)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quadframe", description="graph queries and bulk jobs on Spark")
    p.add_argument("-v", "--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command")

    def command(name: str, *options: tuple, **flags: str) -> None:
        c = sub.add_parser(name)
        for short, dest, kind, default in options:
            required = default is ...
            if kind is bool:
                c.add_argument(short, dest=dest, action="store_true")
            elif kind is list:
                c.add_argument(short, dest=dest, action="append", default=[] if required else default, required=required)
            else:
                c.add_argument(short, dest=dest, type=kind, action=Once, default=None if required else default, required=required)

    s, t = ("-s", "source", str, ...), ("-t", "target", str, ...)
    command("bulkload", s, t, ("-g", "graph", str, None), ("-o", "override", bool, 0), ("-i", "skip", bool, 0), ("-d", "verify", bool, 0), ("-r", "truncate", bool, 0), ("-m", "splits", int, 1))
    command("export", s, ("-q", "query", str, ...), t, ("-p", "properties", list, None), ("-r", "truncate", bool, 0), ("-i", "elastic", str, None))
    command("bulkexport", s, ("-q", "query", str, ...), t, ("-n", "forks", int, 1))
    command("update", s, ("-q", "query", str, ...), ("-t", "target", str, None))
    command("bulkupdate", s, ("-q", "query", str, ...), t, ("-e", "time", int, 0), ("-n", "forks", int, 1))
    command("bulkdelete", s, t, ("-p", "predicate", str, None), ("-b", "subject", str, None), ("-o", "object", str, None), ("-g", "graph", list, None))
    command("stats", s, t, ("-r", "threshold", int, 1000), ("-c", "graph", str, None), ("-u", "refresh", bool, 0))
    command("summary", s, t, ("-d", "decimate", int, 100))
    command("esindex", s, t, ("-g", "graph", str, None))
    command("presplit", s, ("-d", "decimate", int, 1000), ("-l", "limit", int, 80_000_000))
    command("profile", s, ("-q", "query", str, ...))
    command("endpoint", s, ("-p", "port", int, 0), ("-q", "stored", str, None))
    sub.choices["endpoint"].add_argument("child", nargs=argparse.REMAINDER)
    return p


def _query(text: str) -> str:
    return open(text[1:], encoding="utf-8").read() if text.startswith("@") else text


def _queries(spark: SparkSession, pattern: str) -> dict[str, str]:
    """The texts of the files under comma-separated paths, by name."""
    files = loading.files_under(spark, pattern)
    if not files:
        raise SystemExit(f"no query files in {pattern}")
    read = lambda f: (spark.read.text(f, wholetext=True).first() or [""])[0]
    return {os.path.splitext(os.path.basename(f))[0]: read(f) for f in files}


def dataset(spark: SparkSession, path: str) -> Dataset:
    """A quad table under path, with the namespaces it holds."""
    df = spark.read.parquet(path)
    return Dataset(spark, quads=QuadTable(df, not df.filter("g IS NOT NULL").isEmpty()), namespaces=loading.namespaces(df))


def main(args: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(args)
    if not a.command:
        p.print_help()
        return -1
    spark = SparkSession.builder.appName("quadframe").getOrCreate()
    if a.command == "bulkload":
        quads = loading.load(spark, a.source, a.graph, a.override, a.skip, a.verify, splits=a.splits)
        loading.write(quads, a.target, "overwrite" if a.truncate else "append")
        return 0
    d = dataset(spark, a.source)
    engine, quads = Engine(spark, d), d.quads.df
    if a.command == "export":
        n = export(engine, _query(a.query), a.target, dict(x.split("=", 1) for x in a.properties or []), a.truncate)
        if n is not None:
            print(n)
    elif a.command == "bulkexport":
        print("\n".join(bulk_export(engine, _queries(spark, a.query), a.target, a.forks)))
    elif a.command == "update":
        new = Updater(d, loader=lambda uri: loading.load(spark, uri)).run(_query(a.query))
        loading.write(new.quads.df, a.target or a.source + ".updated", "overwrite")
    elif a.command == "bulkupdate":
        loading.write(bulk_update(d, list(_queries(spark, a.query).values()), a.time, a.forks).quads.df, a.target, "overwrite")
    elif a.command == "bulkdelete":
        from .terms import parse_term

        term = lambda x: parse_term(x) if x else None
        graphs = [None if g == "NONE" else g for g in a.graph] if a.graph else None
        loading.write(bulk_delete(quads, s=term(a.subject), p=term(a.predicate), o=term(a.object), graphs=graphs), a.target, "overwrite")
    elif a.command == "stats":
        out = (stats.refreshed if a.refresh else stats.void)(quads, a.threshold, a.graph)
        write_rdf(out, a.target) if "." in os.path.basename(a.target) else loading.write(out, a.target)
    elif a.command == "summary":
        out = summary.as_quads(summary.summary(quads, a.decimate))
        write_rdf(out, a.target) if "." in os.path.basename(a.target) else loading.write(out, a.target)
    elif a.command == "esindex":
        textindex.build(quads, a.graph).write.parquet(a.target)
    elif a.command == "presplit":
        for r in presplit.split_points(quads, a.limit, a.decimate).toLocalIterator():
            print(r["part"], r["p"], r["s"])
    elif a.command == "profile":
        print(profile.profile(engine, _query(a.query)))
    elif a.command == "endpoint":
        from .server import Server, stored_queries

        with Server(engine, a.port, stored_queries(a.stored) if a.stored else None) as server:
            url = f"http://127.0.0.1:{server.port}/"
            print(url, flush=True)
            if a.child:
                return subprocess.run(a.child, env=os.environ | {"ENDPOINT": url}).returncode
            server.thread.join()
    return 0


if __name__ == "__main__":
    sys.exit(main())
