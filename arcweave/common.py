"""Helpers that every operator shares: column picking, pinned intermediate tables, Arrow utilities.

Column contract of the operators: an operator names the columns it needs; ``pick`` binds them by position
to internal names, so further columns of the input (also such that are called like an internal or output
column, or twice the same) can neither be mixed up with them nor break the plan.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def position(df: DataFrame, name: str) -> int:
    """Index of the column called ``name``: the exact spelling first, else a single one that differs only in case."""
    names = df.columns
    if name in names:
        return names.index(name)
    alike = [i for i, n in enumerate(names) if n.lower() == name.lower()]
    if len(alike) != 1:
        raise ValueError(f"no single column {name!r} among {names}")
    return alike[0]


def by_position(df: DataFrame) -> DataFrame:
    """``df`` with the column names c0, c1, ...; whatever the names were, they are now unique and plain."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the keyword names: ``pick(df, key="from_key", at="ts")``."""
    at = {new: position(df, old) for new, old in columns.items()}
    plain = by_position(df)
    return plain.select(*[F.col(f"c{i}").alias(new) for new, i in at.items()])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``). Where none is set, a temporary folder, if all tasks run
    on this machine; else an error, as executors and driver would see different disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not one_machine(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it has to name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='arcweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def one_machine(master: str) -> bool:
    return master == "local" or master.startswith(("local[", "local-cluster["))


#: Scratch tables by the DataFrame that reads them, and the paths made inside each open ``scratch_scope``.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_SCOPES: list[list[str]] = []


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; the application's part of the folder is deleted when it ends."""
    base = f"{checkpoint_dir(spark)}/arcweave/{spark.sparkContext.applicationId}"
    at, files = _hadoop(spark, base)
    files.mkdirs(at)  # only what is there can be marked for deletion
    files.deleteOnExit(at)
    path = f"{base}/{label}-{uuid.uuid4().hex[:12]}"
    for made in _SCOPES:
        made.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once as a table in the shared folder and reads it back.

    Cuts the lineage without keeping blocks on executors: a lost executor costs a re-read, never a recomputation,
    and row numbers given before the cut stay what they are. The table stays until ``release``, the end of a
    ``scratch_scope`` or that of the application.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[made] = path
    return made


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that no plan will read any more."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            at, files = _hadoop(df.sparkSession, path)
            files.delete(at, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all scratch tables that operators wrote inside it; results have to be stored before.

    For sessions that run many queries: without it the tables stay until the application ends.
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            at, files = _hadoop(spark, path)
            files.delete(at, True)


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions for explicit exchanges: what the session uses for its own shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def run_starts(columns: list[pa.Array], before: list | None) -> np.ndarray:
    """Of rows sorted by ``columns``: True where a row's values differ from the row before it (nulls are equal, and so are
    NaNs, as in Spark's own grouping).

    ``before`` holds the values of the row before the first one, or is None where there is none.
    """
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    if not n:
        return new
    new[0] = before is None or not all(a == b or (a != a and b != b) for a, b in zip((c[0].as_py() for c in columns), before))
    for c in columns:
        if n > 1:
            differs = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            nulls = c.is_null().to_numpy(zero_copy_only=False)
            if pa.types.is_floating(c.type):
                nan = pc.fill_null(pc.is_nan(c), False).to_numpy(zero_copy_only=False)
                differs = differs & ~(nan[1:] & nan[:-1])
            new[1:] |= differs | (nulls[1:] != nulls[:-1])
    return new
