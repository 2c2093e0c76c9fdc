"""Most frequent values of columns with any number of distinct values, in bounded memory.

External sort and run-length counting: every input task sorts its values (Spark's sort spills to disk) and shrinks
each run of equal values to one (value, count) pair; the pairs are range-partitioned by value, merged in sorted
order with their counts added up, and each range keeps a heap of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.common import by_position, materialize, position, release, run_starts, shuffle_width

def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (slot, value, cnt) rows with equal (slot, value) combined; holds one batch and one open run."""
    open_run, count = None, 0
    schema = None
    for b in batches:
        if not b.num_rows:
            continue
        schema = b.schema
        slot, value, cnt = b.columns
        new = run_starts([slot, value], open_run)
        heads = np.flatnonzero(new)
        total = np.concatenate([[0], np.cumsum(cnt.to_numpy(zero_copy_only=False))])
        first = heads[0] if len(heads) else b.num_rows
        count += int(total[first])
        if not len(heads):
            continue
        if open_run is not None:
            yield _runs(schema, [open_run[0]], [open_run[1]], [count])
        ends = np.append(heads[1:], b.num_rows)
        sums = total[ends] - total[heads]
        if len(heads) > 1:
            at = pa.array(heads[:-1])
            yield pa.RecordBatch.from_arrays([slot.take(at), value.take(at), pa.array(sums[:-1], pa.int64())], schema=schema)
        open_run, count = [slot[int(heads[-1])].as_py(), value[int(heads[-1])].as_py()], int(sums[-1])
    if open_run is not None:
        yield _runs(schema, [open_run[0]], [open_run[1]], [count])


def _runs(schema: pa.Schema, slots: list, values: list, counts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((slots, values, counts), schema)], schema=schema)


def _bounded_heaps(k: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of merged runs, the ``k`` largest of each slot (ties: the smaller value) and the sum of all counts."""
        heaps: dict[int, list] = {}
        totals: dict[int, int] = {}
        schema = None
        for b in _run_lengths(batches):
            schema = b.schema
            slots, counts = b.column(0).to_numpy(), b.column(2).to_numpy()
            real = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            for s in np.unique(slots).tolist():
                own = np.flatnonzero(slots == s)
                totals[s] = totals.get(s, 0) + int(counts[own].sum())
                own = own[real[own]]
                heap = heaps.setdefault(s, [])
                if len(heap) == k:
                    own = own[counts[own] >= heap[0][0]]
                if len(own) > k:  # values come in ascending order: a stable sort keeps the smaller of equal counts
                    own = own[np.argsort(-counts[own], kind="stable")[:k]]
                picked = zip(counts[own].tolist(), b.column(1).take(pa.array(own)).to_pylist())
                for count, value in picked:
                    item = (count, _Reverse(value))
                    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, item)
        if schema is None:
            return
        out = pa.schema([*schema, pa.field("total", pa.int64())])
        for s, heap in heaps.items():
            rows = sorted(heap, reverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s] * (len(rows) + 1), schema[0].type),
                    pa.array([*(r[1].value for r in rows), None], schema[1].type),
                    pa.array([*(r[0] for r in rows), None], pa.int64()),
                    pa.array([*([None] * len(rows)), totals[s]], pa.int64()),
                ],
                schema=out,
            )

    return keep


class _Reverse:
    """Orders values downwards, so that the heap gives up the larger of two equally frequent values. NaN is the largest."""

    __slots__ = ("key", "value")

    def __init__(self, value):
        self.key, self.value = (value != value, value), value

    def __lt__(self, other):
        return self.key > other.key

    def __eq__(self, other):
        return self.key == other.key


def frequent_values(df: DataFrame, columns: Sequence[str], k: int, ranges: int | None = None) -> DataFrame:
    """The ``k`` most frequent non-null values of each column: (column, value, cnt, n_rows), counts exact.

    All ``columns`` must have one type, with a total order. ``n_rows`` is the number of all rows (null values and
    repeated rows counted), so that shares can be formed. Ties at the k-th place go to the smaller value.

    Memory: a task holds one Arrow batch, one open run and ``k`` heap entries a column, whatever the number of
    distinct values; sorting spills. Skew: a value with a third of all rows reaches its range as one pair from each
    input task. Spark places the range bounds by a bounded sample of the runs; they decide only which task counts a
    value, and all values are counted.

    Defined cases: nulls are counted in ``n_rows`` only; an empty table or a column of nulls gives no rows; empty
    strings are values; NaN is one value, larger than all numbers, and -0.0 is 0.0; further columns of ``df`` are ignored.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark, plain = df.sparkSession, by_position(df)
    at = [position(df, c) for c in columns]
    kinds = {plain.schema[i].dataType.simpleString() for i in at}
    if len(kinds) != 1:
        raise ValueError(f"columns of different types: {sorted(kinds)}")
    kind = kinds.pop()
    ranges = ranges or shuffle_width(spark)
    value = lambda i: F.col(f"c{i}") + F.lit(0).cast(kind) if kind in ("float", "double") else F.col(f"c{i}")  # noqa: E731  no -0.0
    long = plain.select(F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), value(i).alias("value")) for s, i in enumerate(at)])).alias("e")).select("e.slot", "e.value")
    runs = materialize(
        long.select("slot", "value", F.lit(1).cast("long").alias("cnt")).sortWithinPartitions("slot", "value").mapInArrow(_run_lengths, f"slot int, value {kind}, cnt long"),
        "runs",
    )
    merged = runs.repartitionByRange(ranges, "slot", "value").sortWithinPartitions("slot", "value").mapInArrow(_bounded_heaps(k), f"slot int, value {kind}, cnt long, total long")
    each = materialize(merged, "heaps")
    release(runs)
    rows = each.groupBy("slot").agg(F.sum("total").alias("n_rows"))
    best = (
        each.filter(F.col("cnt").isNotNull())
        .withColumn("place", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("cnt"), F.asc("value"))))
        .filter(F.col("place") <= k)
        .join(F.broadcast(rows), "slot")  # one row a column
    )
    names = F.create_map(*[x for s, c in enumerate(columns) for x in (F.lit(s), F.lit(c))])
    return best.select(names[F.col("slot")].alias("column"), "value", "cnt", "n_rows")
