"""References to records that do not exist (or not at the time of the reference)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.common import by_position, materialize, position, run_starts, shuffle_width

MATCHES = ("simple", "partial", "full")


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (begin, end, key...) sorted by (key..., begin): joins the spans of a key that touch or overlap.

    A span begins where no earlier one of the key reaches: the running maximum of the ends within a key. Between
    batches the last span stays open.
    """
    held: pa.RecordBatch | None = None  # the open span, one row
    for b in batches:
        if not b.num_rows:
            continue
        b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        begin, end = (c.cast(pa.int64()).to_numpy() for c in b.columns[:2])  # microseconds
        first = run_starts(b.columns[2:], None)
        ends = pd.Series(end).groupby(np.cumsum(first)).cummax().to_numpy()
        first[1:] |= begin[1:] > ends[:-1]
        heads = np.flatnonzero(first)
        ends = ends[np.append(heads[1:], b.num_rows) - 1]
        joined = b.take(pa.array(heads))
        joined = pa.RecordBatch.from_arrays([joined.column(0), pa.array(ends, pa.int64()).cast(b.schema[1].type), *joined.columns[2:]], schema=b.schema)
        held = joined.slice(joined.num_rows - 1)
        if joined.num_rows > 1:
            yield joined.slice(0, joined.num_rows - 1)
    if held is not None:
        yield held


def _spans(parents: DataFrame, k: list[str]) -> DataFrame:
    """The times at which a key is there, as spans (begin, end); end null: until now.

    Equal begins are combined before the shuffle. Then range partitions of (key, begin) are walked once in order, with
    one open span each: a key with any number of rows is spread over many tasks. Spans of a key can overlap only where
    partitions meet, which an anti-join doesn't mind. Rows without a begin never become visible and are left out.
    """
    far = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    starts = parents.filter(F.col("begin").isNotNull()).groupBy(*k, "begin").agg(F.max(F.coalesce("end", far)).alias("end")).filter("end > begin")
    laid = starts.repartitionByRange(shuffle_width(parents.sparkSession), *k, "begin").sortWithinPartitions(*k, "begin")
    schema = ", ".join(["begin timestamp_ntz", "end timestamp_ntz", *(f"{n} {parents.schema[n].dataType.simpleString()}" for n in k)])
    return laid.select("begin", "end", *k).mapInArrow(_join_up, schema)


def orphan_references(
    refs: DataFrame,
    ref_keys: Sequence[str],
    ref_time: str | None,
    parents: DataFrame,
    parent_keys: Sequence[str],
    parent_begin: str | None,
    parent_end: str | None,
    carry: Sequence[str] = (),
    match: str = "simple",
) -> DataFrame:
    """References without a parent row that is there at ``ref_time``: (carry..., state).

    A parent row is there from ``parent_begin`` on until before ``parent_end`` (null: for good). Tables without times have
    None for all three: a parent row is there at all times. state is
    ``missing``: no parent row has the key at all; ``late``: all of them begin after the reference; ``deleted``: else.

    References are grouped by their null mask (which of the key columns are null), and each group is anti-joined on
    its non-null columns, by ``match``:
    * ``simple``: a reference with any null column refers to nothing and is not checked;
    * ``partial``: the non-null columns must occur together in a parent row; all null is not checked;
    * ``full``: all null is not checked; null in some columns only is an orphan, state ``missing``.

    Scale: parents are reduced to the spans of each key first, so that a key repeated millions of times does not
    multiply; the anti-join streams over the references, whose hot keys adaptive execution splits; no side is broadcast
    by force. What remains is a key that is hot among the references and also came and went very often: each of its
    references is compared with its spans until one holds.

    Defined cases: a null ``ref_time`` can't be compared, so the reference is an orphan, ``deleted`` unless missing;
    parents with a null begin never become visible; null keys of parents match nothing; repeated references come out
    as often as they go in; empty tables are fine; further columns are ignored.
    """
    if match not in MATCHES:
        raise ValueError(f"match is one of {MATCHES}")
    if len(ref_keys) != len(parent_keys) or not ref_keys:
        raise ValueError("as many key columns of the references as of the parents, at least one")
    if "state" in {c.lower() for c in carry}:
        raise ValueError("a carried column can't be called state")
    timed = ref_time is not None
    if timed != (parent_begin is not None) or (parent_end is not None and not timed):
        raise ValueError("either both tables have times or none")
    k = [f"k{i}" for i in range(len(ref_keys))]
    c = [f"x{i}" for i in range(len(carry))]
    at = lambda df, name: F.col(f"c{position(df, name)}")
    time = lambda df, name: (F.lit(None) if name is None else at(df, name)).cast("timestamp_ntz")
    r = by_position(refs).select(*[at(refs, n).alias(i) for n, i in zip(ref_keys, k)], time(refs, ref_time).alias("at"), *[at(refs, n).alias(i) for n, i in zip(carry, c)])
    p = by_position(parents).select(*[at(parents, n).alias(i) for n, i in zip(parent_keys, k)], time(parents, parent_begin).alias("begin"), time(parents, parent_end).alias("end"))
    found = []
    for mask in product((True, False), repeat=len(k)):  # True: the column is not null
        there = [n for n, m in zip(k, mask) if m]
        if not there or (match == "simple" and not all(mask)):
            continue
        group = r
        for n, m in zip(k, mask):
            if refs.schema[position(refs, ref_keys[k.index(n)])].nullable:
                group = group.filter(F.col(n).isNotNull() if m else F.col(n).isNull())
            elif not m:
                group = group.filter(F.lit(False))
        if match == "full" and not all(mask):
            found.append(group.select(*c, F.lit("missing").alias("state")))
            continue
        known = p
        for n in there:
            known = known.filter(F.col(n).isNotNull())
        if not timed:
            found.append(group.join(known.select(*there).distinct(), there, "left_anti").select(*c, F.lit("missing").alias("state")))
            continue
        spans = materialize(_spans(known, there), "spans")  # else each branch of a union of references makes them anew
        first = known.groupBy(*there).agg(F.min("begin").alias("first_begin"), F.lit(True).alias("known"))
        group = group.select(*there, "at", *c)
        spans = spans.select(*[F.col(n).alias(f"p_{n}") for n in there], "begin", "end")
        on = (F.col("begin") <= F.col("at")) & (F.col("end") > F.col("at"))
        for n in there:
            on = on & (F.col(n) == F.col(f"p_{n}"))
        orphan = group.join(spans, on, "left_anti")
        state = F.when(F.col("known").isNull(), "missing").when(F.col("first_begin").isNull() | (F.col("first_begin") > F.col("at")), "late").otherwise("deleted")
        found.append(orphan.join(first, there, "left").select(*c, state.alias("state")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.toDF(*carry, "state")
