import pytest

from arcweave.llm.top_n import top_n_per_group

SCHEMA = "g long, score int, item long, note string"
ORDER = [("score", "desc"), ("item", "asc")]


def plain(data, n):
    by = {}
    for r in data:
        by.setdefault(r[0], []).append(r)
    key = lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or 0)
    return sorted((r for rs in by.values() for r in sorted(rs, key=key)[: max(0, n)]), key=str)


@pytest.mark.parametrize("n", [-1, 0, 1, 3, 1000])
def test_against_plain(spark, rows, n):
    data = [(i % 7 if i % 3 else 0, i * 37 % 11, i, "x" * (i % 3)) for i in range(600)]
    data += [(None, 1, 1, None), (None, 2, 2, ""), (1, None, 3, "n"), (2, 5, None, "n"), (9, 4, 4, "y" * 100_000)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert rows(top_n_per_group(df, ["g"], ORDER, n)) == plain(data, n)


def test_ties_and_repeated_rows(spark, rows):
    df = spark.createDataFrame([(1, 5, 1, "a")] * 9 + [(1, 5, 1, "b")] * 9, SCHEMA)
    got = rows(top_n_per_group(df, ["g"], ORDER, 4))
    assert len(got) == 4 and {r[:3] for r in got} == {(1, 5, 1)}


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "g int, place int, c0 int, `a b.c` int, rows int")
    got = top_n_per_group(df, ["g"], [("a b.c", "desc"), ("c0", "asc")], 1)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, 2, 3, 4, 5)]
    twice = df.select("g", "place", "place", "c0")
    assert [tuple(r) for r in top_n_per_group(twice, ["g"], [("c0", "asc")], 1).collect()] == [(1, 2, 2, 3)]


def test_empty_and_bad(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_n_per_group(df, ["g"], ORDER, 3).count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(df, ["g"], [("score", "down")], 3)
    with pytest.raises(ValueError):
        top_n_per_group(df, ["h"], ORDER, 3)


def test_plan_has_group_limits(spark):
    df = spark.createDataFrame([(1, 1, 1, "")], SCHEMA)
    plan = top_n_per_group(df, ["g"], ORDER, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
