"""Statistics that a load takes: entries per type, word frequencies, heavy hitters, bucket estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Heavy-hitter candidates kept for each node type, and the share above which (strictly) a candidate is one.
TOP_KEEP = 10
TOP_SHARE = 100  # more than one in so many
#: Entries meant for one hash batch.
BATCH_ENTRIES = 5_000_000


def type_words(directed: DataFrame, ends: list[tuple[str, str]]) -> DataFrame:
    """(node_type, key): both end keys of every edge, as words of their types. ``ends``: (key column, node type)."""
    pairs = F.array(*[F.struct(F.lit(t).alias("node_type"), F.col(c).cast("string").alias("key")) for c, t in ends])
    return directed.select(F.explode(pairs).alias("e")).select("e.*")


def sample_words(words: DataFrame, fraction: float, seed: int = 1) -> DataFrame:
    """A random sample of words, for statistics that need not be exact."""
    return words.sample(fraction, seed)


def sample_rows(rows: DataFrame, key: str, one_in: int) -> DataFrame:
    """About one in so many rows, chosen by the md5 of ``key``: the same rows however the table is split, and after a task is
    run again. Rows with a null key are left out, rows with one key stay together."""
    if one_in < 1:
        raise ValueError("one_in must be at least 1")
    number = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    return rows.filter(number % one_in == 0)


def word_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("node_type", "key").agg(F.count(F.lit(1)).alias("cnt"))


def top_words(words: DataFrame, keep: int = TOP_KEEP) -> DataFrame:
    """(node_type, key, cnt): the most frequent keys of each type; ties go to the smaller key."""
    place = F.row_number().over(Window.partitionBy("node_type").orderBy(F.desc("cnt"), "key"))
    return word_counts(words).withColumn("place", place).filter(F.col("place") <= keep).drop("place")


def entry_counts(words: DataFrame) -> DataFrame:
    """(node_type, n_entries): entries of each type, over both ends."""
    return words.groupBy("node_type").agg(F.count(F.lit(1)).alias("n_entries"))


def heavy_hitters(words: DataFrame, keep: int = TOP_KEEP, share: int = TOP_SHARE) -> DataFrame:
    """(node_type, key, cnt, n_entries): top keys with more than 1/``share`` of their type's entries."""
    counts = word_counts(words)
    place = F.row_number().over(Window.partitionBy("node_type").orderBy(F.desc("cnt"), "key"))
    top = counts.withColumn("place", place).filter(F.col("place") <= keep).drop("place")
    totals = counts.groupBy("node_type").agg(F.sum("cnt").alias("n_entries"))
    return top.join(F.broadcast(totals), "node_type").filter(F.col("cnt") * share > F.col("n_entries"))  # one row a type


def line_stats(words: DataFrame, without_frequent: bool = False, batch: int = BATCH_ENTRIES) -> DataFrame:
    """(node_type, n_entries, n_buckets): batches that the entries outside heavy hitters would fill.

    ``without_frequent``: heavy hitters are not told apart."""
    totals = entry_counts(words)
    if without_frequent:
        return totals.withColumn("n_buckets", F.floor(F.col("n_entries") / batch))
    heavy = heavy_hitters(words).groupBy("node_type").agg(F.sum("cnt").alias("heavy"))
    rest = F.col("n_entries") - F.coalesce("heavy", F.lit(0))
    return totals.join(F.broadcast(heavy), "node_type", "left").select("node_type", "n_entries", F.floor(rest / batch).alias("n_buckets"))


def partition_counts(df: DataFrame) -> DataFrame:
    """Rows by input partition."""
    return df.groupBy(F.spark_partition_id().alias("chunk_id")).agg(F.count(F.lit(1)).alias("n_rows"))
