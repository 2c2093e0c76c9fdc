"""Adjacency: every edge once in each direction, its degree and offset tables, and keyed last-wins tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave.common import materialize, shuffle_width
from arcweave.functions.ids import BUCKETS, bucket, node_id

ADJACENCY = ("src_id", "dst_id", "ts")


def edges(df: DataFrame, rel: str, from_type: int, from_key: str | Column, to_type: int, to_key: str | Column, ts: str | Column, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Usable relation rows as directed edges (rel, src_id, dst_id, ts, attributes).

    A row is usable if neither key nor ts is null. Repeated rows are parallel edges and stay.
    """
    a, b, t = (F.col(x) if isinstance(x, str) else x for x in (from_key, to_key, ts))
    good = df.filter(a.isNotNull() & b.isNotNull() & t.try_cast("int").isNotNull())
    return good.select(F.lit(rel).alias("rel"), node_id(from_type, a).alias("src_id"), node_id(to_type, b).alias("dst_id"), t.try_cast("int").alias("ts"), *attributes)


def both_directions(directed: DataFrame) -> DataFrame:
    """(src_id, dst_id, ts): each edge for both of its ends; a self-loop gives two entries.

    A union, so that filters on src_id and column pruning reach the scan of either direction.
    """
    return directed.select("src_id", "dst_id", "ts").unionByName(directed.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), "ts"))


def in_bucket_order(rows: DataFrame, key: str, order: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with their ``bucket``, laid out for storage: ranges of (bucket, order) of equal size, each sorted.

    As many ranges as the session has shuffle partitions: a large bucket, or a key with a third of all rows, is written by
    many tasks."""
    by = ["bucket", *order]
    return rows.withColumn("bucket", bucket(F.col(key), buckets)).repartitionByRange(shuffle_width(rows.sparkSession), *by).sortWithinPartitions(*by)


def in_node_order(adjacency: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The adjacency laid out for storage: rows of a bucket by (src_id, ts, dst_id)."""
    return in_bucket_order(adjacency.select(*ADJACENCY), "src_id", ("src_id", "ts", "dst_id"), buckets)


def degree(adjacency: DataFrame) -> DataFrame:
    """(src_id, length); partial aggregation keeps hot nodes from being shuffled."""
    return adjacency.groupBy("src_id").agg(F.count(F.lit(1)).alias("length"))


def bucket_histogram(adjacency: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return adjacency.groupBy(bucket(F.col("src_id"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for b in batches:
        length = b.column(2).to_numpy()
        ends = total + np.cumsum(length)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - length, pa.int64())], names=["pid", "src_id", "length", "inside"])
        if len(ends):
            total = int(ends[-1])


def csr_index(adjacency: DataFrame) -> DataFrame:
    """(src_id, offset, length): where a node's entries begin when all entries are sorted by src_id.

    A distributed prefix sum: running sums inside range partitions, then one offset per partition; only the partition
    sums (one row each) are brought together.
    """
    ranged = degree(adjacency).repartitionByRange(shuffle_width(adjacency.sparkSession), "src_id").sortWithinPartitions("src_id")
    inside = materialize(ranged.select(F.spark_partition_id().alias("pid"), "src_id", "length").mapInArrow(_running, "pid int, src_id long, length long, inside long"), "offsets")
    sums = inside.groupBy("pid").agg(F.sum("length").alias("n"))
    before = sums.select("pid", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    return inside.join(F.broadcast(before), "pid").select("src_id", (F.col("off") + F.col("inside")).alias("offset"), "length")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row with the largest ``order``: an aggregation with partial results before the shuffle. As rows have
    strings, Spark aggregates over sorted rows on either side; a key's rows are never held together."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])
