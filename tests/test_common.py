import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from arcweave.common import checkpoint_dir, materialize, one_machine, pick, position, release, run_starts, scratch_scope

SCRIPT = """
import sys
from pyspark.sql import SparkSession
from arcweave.common import materialize
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
assert materialize(spark.range(5), "x").count() == 5
import os
assert os.listdir(sys.argv[1] + "/arcweave")
spark.stop()
"""


def test_columns_are_found_by_exact_name_first(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, A int, `b.c` int, d int")
    assert [position(df, c) for c in ("a", "A", "b.c", "D")] == [0, 1, 2, 3]
    assert pick(df, x="A", y="b.c").collect() == [(2, 3)]
    with pytest.raises(ValueError):
        position(df, "e")
    twice = df.select("d", "d", "`b.c`")
    assert pick(twice, x="b.c").collect() == [(3,)]


def test_materialized_tables_keep_rows_and_types(spark, rows):
    df = spark.createDataFrame([(1, None, b"x", ["a", None]), (None, 2.5, None, None)], "a int, b double, c binary, d array<string>")
    again = materialize(df, "t")
    assert again.dtypes == df.dtypes and rows(again) == rows(df)
    assert materialize(df.filter("false"), "t").count() == 0


def test_tables_go_to_the_shared_folder_and_vanish(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], check=True, env=os.environ | {"PYTHONPATH": root}, capture_output=True, timeout=200)
    assert not list((tmp_path / "arcweave").iterdir())


def test_run_starts():
    a, b = pa.array(["x", "x", None, None, "y"]), pa.array([1, 1, 1, 2, 2])
    assert run_starts([a, b], None).tolist() == [True, False, True, True, True]
    assert run_starts([a, b], ["x", 1]).tolist() == [False, False, True, True, True]
    assert run_starts([a[:0], b[:0]], None).tolist() == []


def test_nans_are_equal():
    nan = float("nan")
    a = pa.array([1.0, nan, nan, None, None], pa.float64())
    assert run_starts([a], None).tolist() == [True, True, False, True, False]
    assert run_starts([a[1:]], [nan]).tolist() == [False, False, True, False]


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        getConf = Conf  # noqa: N815

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
    assert [one_machine(m) for m in ("local", "local[4]", "local-cluster[2,1,1024]", "yarn", "k8s://x", "spark://local:1")] == [True] * 3 + [False] * 3


def test_scratch_tables_are_dropped(spark):
    path = lambda df: Path(df.inputFiles()[0].removeprefix("file://")).parent
    with scratch_scope(spark):
        a = path(materialize(spark.range(3), "a"))
        with scratch_scope(spark):
            b = path(materialize(spark.range(3), "b"))
        assert a.exists() and not b.exists()
    assert not a.exists()
    kept, gone = materialize(spark.range(3), "c"), materialize(spark.range(3), "d")
    d = path(gone)
    release(gone, spark.range(1))
    assert not d.exists() and kept.count() == 3
