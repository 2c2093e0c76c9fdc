import itertools
import random
from datetime import datetime, timedelta

import pytest

from arcweave.operators.orphans import _spans, orphan_references

DAY = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(10)]
REF = "id long, a string, b string, at timestamp_ntz"
PARENT = "a string, b string, born timestamp_ntz, gone timestamp_ntz"


def plain(refs, parents, match):
    out = []
    for rid, a, b, at in refs:
        there = [i for i, v in enumerate((a, b)) if v is not None]
        if not there or (match == "simple" and len(there) < 2):
            continue
        if match == "full" and len(there) < 2:
            out.append((rid, "missing"))
            continue
        known = [p for p in parents if all(p[i] is not None and p[i] == (a, b)[i] for i in there)]
        if any(p[2] is not None and at is not None and p[2] <= at and (p[3] is None or p[3] > at) for p in known):
            continue
        born = [p[2] for p in known if p[2] is not None]
        if not known:
            state = "missing"
        elif not born or (at is not None and min(born) > at):
            state = "late"
        else:
            state = "deleted"
        out.append((rid, state))
    return sorted(out, key=str)


def run(spark, refs, parents, match):
    r, p = spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PARENT)
    return orphan_references(r, ["a", "b"], "at", p, ["a", "b"], "born", "gone", ["id"], match)


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_against_plain(spark, rows, match):
    rng = random.Random(5)
    key = lambda: rng.choice(["x", "y", "z", "", None])
    parents = [(key(), key(), rng.choice([*DAY, None]), rng.choice([*DAY, None, None])) for _ in range(40)]
    refs = [(i, a, b, at) for i, (a, b, at) in enumerate(itertools.product(["x", "y", "z", "", "no", None], ["x", "y", "", "no", None], [*DAY[::2], None]))]
    refs += refs[:20]
    assert rows(run(spark, refs, parents, match)) == plain(refs, parents, match)


def test_spans_that_touch_and_overlap(spark, rows):
    parents = [("k", "k", DAY[1], DAY[3]), ("k", "k", DAY[3], DAY[4]), ("k", "k", DAY[2], DAY[3]), ("k", "k", DAY[6], None), ("k", "k", DAY[8], DAY[8])]
    refs = [(i, "k", "k", d) for i, d in enumerate(DAY)]
    assert rows(run(spark, refs, parents, "simple")) == [(0, "late"), (4, "deleted"), (5, "deleted")]


def test_hot_parent_is_spread(spark, rows):
    """One key with most parent rows; its spans come from all partitions, and still every reference is right."""
    parents = [("hot", "k", DAY[0] + timedelta(minutes=10 * i), DAY[0] + timedelta(minutes=10 * i + (15 if i % 3 else 5))) for i in range(300)]
    refs = [(i, "hot", "k", DAY[0] + timedelta(minutes=i)) for i in range(0, 3100, 7)]
    assert rows(run(spark, refs, parents, "simple")) == plain(refs, parents, "simple")
    p = spark.createDataFrame(parents, PARENT).withColumnsRenamed({"born": "begin", "gone": "end"})
    spans = _spans(p, ["a", "b"]).collect()
    assert 100 <= len(spans) <= 100 + 4


def test_spans_over_batches(spark, rows):
    """The open span goes on from batch to batch, and so does a long one that covers many short ones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(6)
        parents = [(rng.choice("xyz"), "k", (d := rng.choice(DAY)), rng.choice([None, d, d + timedelta(days=rng.randint(0, 9)), d + timedelta(hours=5)])) for _ in range(60)]
        refs = [(i, a, "k", d + timedelta(hours=h)) for i, (a, d, h) in enumerate(itertools.product("xyzq", DAY, (0, 7)))]
        assert rows(run(spark, refs, parents, "simple")) == plain(refs, parents, "simple")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_without_times(spark, rows, match):
    refs = [(i, a, b, None) for i, (a, b) in enumerate(itertools.product(["x", "no", "", None], repeat=2))]
    parents = [("x", "x", DAY[0], None), ("x", None, DAY[0], None), ("", "no", DAY[0], None), (None, None, DAY[0], None)]
    r, p = spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PARENT)
    got = orphan_references(r, ["a", "b"], None, p, ["a", "b"], None, None, ["id"], match)
    always = [(i, a, b, DAY[5]) for i, a, b, _ in refs]
    assert rows(got) == plain(always, parents, match)
    with pytest.raises(ValueError):
        orphan_references(r, ["a"], "at", p, ["a"], None, None)


def test_empty_tables(spark, rows):
    assert rows(run(spark, [], [], "simple")) == []
    assert rows(run(spark, [(1, "x", "y", DAY[0])], [], "simple")) == [(1, "missing")]
    assert rows(run(spark, [], [("x", "y", DAY[0], None)], "partial")) == []


def test_clashing_names(spark, rows):
    r = spark.createDataFrame([("q", DAY[0], 1, 2)], "k0 string, begin timestamp_ntz, x0 long, known long")
    p = spark.createDataFrame([("r", DAY[0], DAY[1], 5)], "k0 string, begin timestamp_ntz, end timestamp_ntz, p_k0 long")
    got = orphan_references(r, ["k0"], "begin", p, ["k0"], "begin", "end", ["known", "x0"])
    assert rows(got) == [(2, 1, "missing")]
    with pytest.raises(ValueError):
        orphan_references(r, ["k0"], "begin", p, ["k0"], "begin", "end", match="exact")
    with pytest.raises(ValueError):
        orphan_references(r.withColumnRenamed("known", "state"), ["k0"], "begin", p, ["k0"], "begin", "end", ["state"])
