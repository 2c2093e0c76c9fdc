"""Command line: load a directory of files to a store, and read from it; put many small files into an archive.

    python -m arcweave.cli load DIRECTORY STORE
    python -m arcweave.cli rejects DIRECTORY
    python -m arcweave.cli neighbors STORE TYPE KEY
    python -m arcweave.cli sample STORE TYPE KEY 4 4 4
    python -m arcweave.cli generate DIRECTORY
    python -m arcweave.cli pack DIRECTORY ARCHIVE
    python -m arcweave.cli extract ARCHIVE PATH
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from arcweave.operators.archive import Archive, pack_directory
from arcweave.plans.graph import Graph
from arcweave.sources.datagen import generate
from arcweave.sources.delimited import list_files, rejects


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="arcweave")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, more in {"load": ["directory", "store"], "rejects": ["directory"], "pack": ["directory", "archive"], "extract": ["archive", "path"], "neighbors": ["store", "type", "key"], "sample": ["store", "type", "key"], "generate": ["directory"]}.items():
        p = sub.add_parser(name)
        for m in more:
            p.add_argument(m)
        if name == "sample":
            p.add_argument("degrees", nargs="*", type=int)
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("arcweave").getOrCreate()
    if a.command == "generate":
        print(", ".join(generate(spark, a.directory)))
    elif a.command == "load":
        Graph.from_files(spark, a.directory).save(a.store)
    elif a.command == "rejects":
        rejects(spark, list_files(spark, a.directory, "relation_")).groupBy("file", "reason").count().orderBy("file", "reason").show(1000, truncate=False)
    elif a.command == "pack":
        Archive.write(pack_directory(spark, a.directory), a.archive)
    elif a.command == "extract":
        for row in Archive(spark, a.archive).lookup(a.path).toLocalIterator():
            sys.stdout.write(bytes(row["body"] or b"").decode(errors="replace"))
    else:
        g = Graph.open(spark, a.store)
        ident = g.fetch_node_id(a.type, a.key)
        if a.command == "neighbors":
            g.fetch_node_neighbor_edges(ident).show(100, truncate=False)
        else:
            nodes, edges = g.sample_node_with_degree(ident, a.degrees or (4, 4, 4))
            nodes.show(100, truncate=False)
            edges.show(100, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
