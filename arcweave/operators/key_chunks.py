"""Per-key results when a handful of keys hold most rows: exact offset chunking.

1. The rows are laid out in key order over partitions of equal size (range partitioning on key, order column, tie
   columns and finally the row's own number, so that not even wholly equal rows must share a partition), numbered
   inside each partition, and written once; from here on the numbers are fixed.
2. The rows of each key are counted per partition, and the prefix sum of these counts over the partitions is the
   offset of a key in each of them.
3. Offset + local number is the number of a row within its key; ``number // chunk_rows`` its chunk. A chunk has at
   most ``chunk_rows`` rows, whoever owns it. Without another wish chunks are sized by the number of all rows, to
   ``CHUNKS_PER_TASK`` for each partition, so that a key with a given share of the rows is cut alike at every size.
4. Each chunk is folded to one small state; the states of a key are merged in order, the step from the last row of
   one state to the first of the next included.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.common import by_position, materialize, position, run_starts, shuffle_width

CHUNKS_PER_TASK = 4


def _step(later: Column, earlier: Column, kind: T.DataType) -> Column:
    """``later`` - ``earlier`` in a type that holds the difference of any two values of ``kind``."""
    if isinstance(kind, T.IntegralType):
        wide = T.DecimalType(20, 0) if isinstance(kind, T.LongType) else T.LongType()
        later, earlier = later.cast(wide), earlier.cast(wide)
    return later - earlier


def _number(keys: int):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the row's number within its key in this partition and the order value of the row before it."""
        last, seen, before = None, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            cols = b.columns[1 : keys + 1]
            new = run_starts(cols, last)
            heads = np.flatnonzero(new)
            place = np.arange(b.num_rows)
            start = np.full(b.num_rows, -seen)
            if len(heads):
                start[heads[0] :] = np.repeat(heads, np.diff(np.append(heads, b.num_rows)))
            local = place - start
            order = b.column(keys + 1)
            previous = pa.concat_arrays([pa.array([before], order.type), order[:-1]])
            gone = pa.array(local == 0)
            previous = pa.compute.if_else(gone, pa.scalar(None, order.type), previous)
            last, seen, before = [c[-1].as_py() for c in cols], int(local[-1]) + 1, order[-1].as_py()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *cols, order, pa.array(local, pa.int64()), previous],
                names=["pid", *(f"k{i}" for i in range(keys)), "o", "ln", "prev"],
            )

    return number


def chunk_states(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (), chunk_rows: int | None = None, partitions: int | None = None) -> DataFrame:
    """One row per key and chunk part: k0..., pid, chunk, n, first_o, last_o, gap (largest step inside the part)."""
    if chunk_rows is not None and chunk_rows < 1:
        raise ValueError("chunk_rows must be at least 1")
    plain = by_position(df)
    k = [f"k{i}" for i in range(len(keys))]
    t = [f"t{i}" for i in range(len(ties))]
    src = plain.select(
        *[F.col(f"c{position(df, c)}").alias(n) for c, n in zip(keys, k)],
        F.col(f"c{position(df, order)}").alias("o"),
        *[F.col(f"c{position(df, c)}").alias(n) for c, n in zip(ties, t)],
        F.monotonically_increasing_id().alias("row"),
    )
    by = [*k, "o", *t, "row"]
    width = partitions or shuffle_width(df.sparkSession)
    laid = src.repartitionByRange(width, *by).sortWithinPartitions(*by)
    kind = {f.name: f.dataType.simpleString() for f in src.schema}
    schema = ", ".join(["pid int", *(f"{c} {kind[c]}" for c in k), f"o {kind['o']}", "ln long", f"prev {kind['o']}"])
    rows = materialize(laid.select(F.spark_partition_id().alias("pid"), *k, "o").mapInArrow(_number(len(k)), schema), "numbered")
    if chunk_rows is None:
        chunk_rows = max(1, -(-rows.count() // (CHUNKS_PER_TASK * width)))  # the count is read from file footers
    counts = rows.groupBy("pid", *k).agg((F.max("ln") + 1).alias("n"))
    offset = F.sum("n").over(Window.partitionBy(*k).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    # only the first key of a partition can have begun in an earlier one: at most one row a partition
    begun = counts.withColumn("off", offset).filter(F.col("off") > 0).select(F.col("pid").alias("p"), *[F.col(c).alias(f"b_{c}") for c in k], "off")
    same = F.col("pid") == F.col("p")
    for c in k:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    numbered = rows.join(F.broadcast(begun), same, "left").withColumn("chunk", F.floor((F.coalesce("off", F.lit(0)) + F.col("ln")) / chunk_rows))
    return numbered.groupBy(*k, "chunk", "pid").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("o").alias("first_o"),
        F.max("o").alias("last_o"),
        F.max(_step(F.col("o"), F.col("prev"), src.schema["o"].dataType)).alias("gap"),
    )


def per_key(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (), chunk_rows: int | None = None, partitions: int | None = None) -> DataFrame:
    """Of every key, its rows in order: (keys..., n_rows, first_value, last_value, largest_step, n_chunks).

    ``order`` is a numeric column; first and last are its smallest and largest value, ``largest_step`` the largest
    difference between two rows that follow each other, in a type that holds it (of int: long, of long: decimal).

    Defined cases: nulls of a key column form a key of their own, and so do NaNs; a NaN order value comes after all
    numbers and the step to it is NaN; rows with a null order value count in n_rows and take no part in the rest (null
    where a key has no such value, a step needs two); repeated rows count each time; an empty table gives an empty
    one; further columns are ignored, ``keys`` must not be called like an output column.
    """
    out = ["n_rows", "first_value", "last_value", "largest_step", "n_chunks"]
    if clash := {c.lower() for c in keys} & set(out):
        raise ValueError(f"key columns can't be called {sorted(clash)}")
    states = chunk_states(df, keys, order, ties, chunk_rows, partitions)
    k = [f"k{i}" for i in range(len(keys))]
    in_order = Window.partitionBy(*k).orderBy("chunk", "pid")
    step = _step(F.col("first_o"), F.lag("last_o").over(in_order), states.schema["first_o"].dataType)  # nulls sort first: a part of nulls only is at the front
    merged = states.withColumn("step", step).groupBy(*k).agg(
        F.sum("n").alias("n_rows"),
        F.min("first_o").alias("first_value"),
        F.max("last_o").alias("last_value"),
        F.max(F.greatest("gap", "step")).alias("largest_step"),
        F.count_distinct("chunk").alias("n_chunks"),
    )
    return merged.toDF(*keys, *out)
