"""Command line: init, ingest, search, traverse, show, docs, stats, history, export, compact."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .client import Client, Expansion, SearchOptions


def main(argv=None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--store", default="./tessera-data")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "stats", "compact"):
        sub.add_parser(name)
    x = sub.add_parser("ingest")
    x.add_argument("path")
    x.add_argument("--no-recursive", action="store_true")
    x = sub.add_parser("search")
    x.add_argument("text")
    x.add_argument("--top-k", type=int, default=10)
    x.add_argument("--all-versions", action="store_true")
    x.add_argument("--expand", type=int, default=0)
    x = sub.add_parser("traverse")
    x.add_argument("ids", nargs="+")
    x.add_argument("--hops", type=int, default=1)
    x.add_argument("--direction", default="both")
    for name in ("show", "history"):
        sub.add_parser(name).add_argument("id")
    sub.add_parser("docs").add_argument("--all", action="store_true")
    sub.add_parser("export").add_argument("out")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    if a.command == "init":
        Client.create(spark, a.store)
        return 0
    c = Client.open(spark, a.store)
    match a.command:
        case "ingest":
            out = c.ingest(a.path, not a.no_recursive)
        case "search":
            out = c.search(a.text, SearchOptions(a.top_k, not a.all_versions, expand=Expansion(max_hops=a.expand) if a.expand else None)).orderBy("_ord").select("id", "kind", "score", "hops", "via", "text", "name")
        case "traverse":
            out = c.traverse(a.ids, (), a.hops, a.direction).orderBy("_ord").select("id", "kind", "hops", "via", "via_edge")
        case "show":
            out = c.show(a.id)[1]
        case "history":
            out = c.history(a.id)
        case "docs":
            out = c.documents(not a.all).select("id", "title", "source_uri", "version", "chunk_count", "is_latest")
        case "stats":
            out = c.stats()
        case "export":
            c.export(a.out)
            return 0
        case _:
            c.compact()
            return 0
    if a.json:
        for row in out.toJSON().toLocalIterator():
            print(row)
    else:
        out.show(50, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
