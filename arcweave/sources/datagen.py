"""Synthetic node and relation files in the format that ``delimited`` reads; seeded, made by Spark tasks."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from arcweave.sources.delimited import write_lines

NODE_ATTRIBUTES = "attr1:int,attr2:float,attr3:bool,attr4:str"


def _letters(salt: int, seed: int, n: int) -> Column:
    return F.substring(F.sha2(F.concat_ws("/", F.lit(seed), F.lit(salt), F.col("id")), 256), 1, n)


def type_names(count: int) -> list[str]:
    return [f"T{i}" for i in range(count)]


def generate(spark: SparkSession, directory: str, node_types: int = 5, nodes: int = 1000, edges: int = 10_000, seed: int = 1, now: int = 1_700_000_000) -> list[str]:
    """Writes nodes of ``node_types`` types and a relation for each pair of types, one file a task; returns the type names."""
    names = type_names(node_types)
    key = lambda t, i: F.concat(F.substring(F.sha2(F.concat_ws("/", F.lit(seed), F.lit(t), i), 256), 1, 8), F.lit(t))
    truth = lambda salt: F.when(F.rand(seed + salt) < 0.5, "True").otherwise("False")
    for k, t in enumerate(names):
        row = F.concat_ws(",", key(t, F.col("id")), F.lit(now), F.round(F.rand(seed + k) * 100, 4).cast("string"), truth(100 + k), _letters(k, seed, 4))
        write_lines(spark.range(nodes).select(row), f"{t}({t}),{NODE_ATTRIBUTES}", directory, f"node_{t}")
    for i, a in enumerate(names):
        for j, b in enumerate(names[:i]):
            salt = 1000 + 50 * i + j
            end = lambda t, s: key(t, F.floor(F.rand(seed + s) * nodes))
            row = F.concat_ws(",", end(a, salt), end(b, salt + 10_000), F.lit(now % 10_000), F.round(F.rand(seed + salt + 1) * 100, 4).cast("string"), truth(salt + 2), _letters(salt, seed, 4))
            write_lines(spark.range(edges).select(row), f"{a}({a}),{b}({b}),{NODE_ATTRIBUTES}", directory, f"relation_{a}_{b}")
    return names
