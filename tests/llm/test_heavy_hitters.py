from collections import Counter

import pytest

from arcweave.llm.heavy_hitters import frequent_values


def plain(data, columns, k):
    out = []
    for i, c in enumerate(columns):
        counts = Counter(r[i] for r in data if r[i] is not None)
        out += [(c, v, n, len(data)) for v, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return sorted(out, key=str)


def data():
    rows = [("hot" if i % 3 == 0 else f"v{i * i % 701}", f"w{i % 97}") for i in range(3000)]
    return rows + [(None, "w1"), ("", None), ("", "z" * 50_000), (None, None), ("ünï", "w1")] * 5


@pytest.mark.parametrize("k,ranges", [(1, 1), (5, 3), (40, 8), (10_000, 4)])
def test_against_counter(spark, rows, k, ranges):
    df = spark.createDataFrame(data(), "a string, b string").repartition(6)
    assert rows(frequent_values(df, ["a", "b"], k, ranges)) == plain(data(), ["a", "b"], k)


def test_small_batches(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(data()[:900], "a string, b string")
        assert rows(frequent_values(df, ["a", "b"], 12, 3)) == plain(data()[:900], ["a", "b"], 12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_numbers_nulls_and_empty(spark, rows):
    df = spark.createDataFrame([(i % 5, None) for i in range(50)], "slot long, value long")
    assert rows(frequent_values(df, ["slot", "value"], 2)) == [("slot", 0, 10, 50), ("slot", 1, 10, 50)]
    assert frequent_values(df.filter("false"), ["slot"], 2).count() == 0
    both = spark.createDataFrame([("a", 1)], "cnt string, total int")
    assert rows(frequent_values(both, ["cnt"], 1)) == [("cnt", "a", 1, 1)]
    with pytest.raises(ValueError):
        frequent_values(both, ["cnt", "total"], 1)
    with pytest.raises(ValueError):
        frequent_values(both, ["cnt"], 0)


def test_nan_is_one_value(spark):
    nan = float("nan")
    df = spark.createDataFrame([(x,) for x in [nan, nan, nan, 1.0, 1.0, -0.0, 0.0, 2.0, None, float("inf")]], "x double").repartition(4)
    got = [(str(r.value), r.cnt, r.n_rows) for r in frequent_values(df, ["x"], 10, 3).collect()]
    assert sorted(got) == sorted([("nan", 3, 10), ("1.0", 2, 10), ("0.0", 2, 10), ("2.0", 1, 10), ("inf", 1, 10)])
    tied = spark.createDataFrame([(nan,), (5.0,), (7.0,)], "x double")
    assert sorted(r.value for r in frequent_values(tied, ["x"], 2, 1).collect()) == [5.0, 7.0]


def test_hot_value(spark, rows):
    df = spark.createDataFrame([("hot",)] * 5000 + [(f"v{i}",) for i in range(50)], "x string").repartition(8)
    assert rows(frequent_values(df, ["x"], 3, 4).select("value", "cnt")) == [("hot", 5000), ("v0", 1), ("v1", 1)]
