"""Relation files that keep arriving: usable lines become adjacency rows of a bucketed store, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arcweave.functions.ids import BUCKETS, bucket, node_id
from arcweave.operators.adjacency import both_directions
from arcweave.sources.catalog import Catalog, Relation
from arcweave.sources.delimited import fields_of, reject_reason, ts_of


def stream_edges(spark: SparkSession, directory: str, rel: Relation, header: str, catalog: Catalog) -> DataFrame:
    """Streaming edges (src_id, dst_id, ts) of the files that appear in ``directory``; headers and unusable lines left out."""
    lines = spark.readStream.schema("value string").text(directory).filter(F.col("value") != header)
    f = fields_of(F.col("value"))
    good = lines.filter(reject_reason(f).isNull())
    return good.select(node_id(catalog.ordinal(rel.from_type), F.get(f, F.lit(0))).alias("src_id"), node_id(catalog.ordinal(rel.to_type), F.get(f, F.lit(1))).alias("dst_id"), ts_of(f).alias("ts"))


def append_adjacency(edges: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Appends both directions of streaming edges to the store at ``path``, then stops when all files are read."""
    both = both_directions(edges).withColumn("bucket", bucket(F.col("src_id"), buckets))
    return both.writeStream.format("parquet").partitionBy("bucket").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
