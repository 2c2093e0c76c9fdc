"""A graph as tables below one path: the catalog with the layout, one table per node type, the edges with their attributes
by relation, the adjacency. Node tables and adjacency are partitioned by bucket and sorted by key."""

from __future__ import annotations

import json
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.ids import BUCKETS, bucket
from arcweave.operators.adjacency import in_bucket_order, in_node_order
from arcweave.operators.reads import lookup_by_bucket
from arcweave.sources.catalog import Catalog

__all__ = ["BUCKETS", "Stored", "entries_of", "load", "lookup_by_bucket", "read_adjacency", "save", "write_adjacency", "write_nodes", "write_table"]

#: Rows of a file at most; a bucket takes as many files as it needs.
FILE_ROWS = 20_000_000
#: Tables of a graph that are written at the same time.
SAVE_THREADS = 4


@dataclass(frozen=True)
class Stored:
    """The tables of a saved graph. ``buckets`` is None where the node tables of an older graph have none."""

    catalog: Catalog
    nodes: dict[str, DataFrame]
    relations: dict[str, DataFrame]
    adjacency: DataFrame
    buckets: int
    bucketed_nodes: bool


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def _write_bucketed(laid: DataFrame, path: str, mode: str) -> None:
    laid.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").parquet(path)


def write_adjacency(adjacency: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "error") -> None:
    """Rows of a bucket are sorted by node, so that row-group statistics serve as the offset index of a node."""
    _write_bucketed(in_node_order(adjacency, buckets), path, mode)


def write_nodes(nodes: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "error") -> None:
    """As the adjacency: a look-up of an id opens one bucket, and in it the row groups that may hold the id."""
    _write_bucketed(in_bucket_order(nodes, "node_id", ("node_id",), buckets), path, mode)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("src_id long, dst_id long, ts int, bucket int").parquet(path)


def entries_of(stored: DataFrame, ident: int, buckets: int = BUCKETS, key: str = "src_id") -> DataFrame:
    """Rows of one key of a stored table; names the bucket, so that one partition is read."""
    return stored.filter((F.col("bucket") == (ident & (buckets - 1))) & (F.col(key) == ident))


def save(path: str, catalog: Catalog, nodes: dict[str, DataFrame], relations: dict[str, DataFrame], adjacency: DataFrame, buckets: int = BUCKETS) -> None:
    if buckets < 1 or buckets & (buckets - 1):
        raise ValueError("the number of buckets is a power of two")
    spark = adjacency.sparkSession
    writes = [(write_adjacency, adjacency, f"{path}/adjacency", buckets)]
    writes += [(write_nodes, df, f"{path}/nodes/{name}", buckets) for name, df in nodes.items()]
    writes += [(write_table, df, f"{path}/relations/{name}") for name, df in relations.items()]
    with ThreadPoolExecutor(SAVE_THREADS) as pool:  # the tables don't depend on each other
        for done in [pool.submit(*w) for w in writes]:
            done.result()
    catalog.save(spark, path)
    spark.createDataFrame([(json.dumps({"buckets": buckets, "bucketed_nodes": True}),)], "value string").coalesce(1).write.text(f"{path}/layout")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _tables(spark: SparkSession, path: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """The tables below ``path`` that are there."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names if _exists(spark, f"{path}/{name}")}


def load(spark: SparkSession, path: str) -> Stored:
    """No relations in a graph that was saved without them."""
    layout = {"buckets": BUCKETS, "bucketed_nodes": False}
    if _exists(spark, f"{path}/layout"):
        layout = json.loads(spark.read.text(f"{path}/layout").first()["value"])
    catalog = Catalog.load(spark, path)
    nodes, relations = _tables(spark, f"{path}/nodes", catalog.types), _tables(spark, f"{path}/relations", catalog.relations)
    return Stored(catalog, nodes, relations, read_adjacency(spark, f"{path}/adjacency"), **layout)
