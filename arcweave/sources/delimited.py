"""Node and relation files: header-declared schemas, one row per line, no quoting unless asked for.

A directory holds ``node_<type>.csv`` and ``relation_<name>.csv``; either may come in several files, told apart by what
follows a dot (``node_<type>.<part>.csv``), each with the header. Spark's text source splits large files at line
ends, so that every line comes out exactly once; headers are dropped explicitly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.ids import node_id
from arcweave.functions.types import parse_column, type_of
from arcweave.operators.adjacency import last_wins
from arcweave.operators.structural_parse import RecordSpec, read_records, split_records
from arcweave.sources.catalog import Catalog, NodeType, Relation, parse_node_header, parse_relation_header


#: Fields of a relation line at least: from, to and ts.
LEAST_FIELDS = 3


def list_files(spark: SparkSession, directory: str, prefix: str) -> list[str]:
    """Files ``<prefix>*.csv`` of a directory, sorted by name."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{directory.rstrip('/')}/{prefix}*.csv")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(f.getPath().toString() for f in (found or []))


def header_of(spark: SparkSession, file: str) -> str:
    """The first line of a file, read on the driver without a job."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(file)
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at), "UTF-8"))
    first = lines.readLine()
    lines.close()
    if first is None:
        raise ValueError(f"{file} is empty: a header is needed")
    return first


def _stem(file: str, prefix: str) -> str:
    return file.rsplit("/", 1)[-1].removeprefix(prefix).split(".")[0]


def discover(spark: SparkSession, directory: str, known: dict[str, int] | None = None) -> tuple[Catalog, dict[str, list[str]], dict[str, list[str]]]:
    """Catalog of a directory, node files by type, relation files by relation."""
    nodes, node_files = {}, {}
    for f in list_files(spark, directory, "node_"):
        t = parse_node_header(header_of(spark, f))
        if t.name in nodes and nodes[t.name] != t:
            raise ValueError(f"{f} declares other attributes for {t.name!r} than the files before it")
        nodes[t.name] = t
        node_files.setdefault(t.name, []).append(f)
    relations, relation_files = {}, {}
    for f in list_files(spark, directory, "relation_"):
        name = _stem(f, "relation_")
        rel = parse_relation_header(header_of(spark, f), name)
        if name in relations and relations[name] != rel:
            raise ValueError(f"{f} declares other columns for {name!r} than the files before it")
        relations[name] = rel
        relation_files.setdefault(name, []).append(f)
    return Catalog.build(nodes.values(), relations.values(), known), node_files, relation_files


def fields_of(line: Column) -> Column:
    """The fields of a line, split at every comma; empty ones count."""
    return F.split(line, ",", -1)


def line_bytes(line: Column) -> Column:
    """Bytes of a line in its file, with the line feed."""
    return F.octet_length(line).cast("long") + 1


def reject_reason(fields: Column) -> Column:
    """Why a line of a relation can't be used: ``columns``, fewer than three fields; ``ts``, the third is no 32-bit integer.
    Null for a usable line."""
    size = F.coalesce(F.size(fields), F.lit(0))
    return F.when(size < LEAST_FIELDS, "columns").when(ts_of(fields).isNull(), "ts")


def ts_of(fields: Column) -> Column:
    return F.get(fields, F.lit(2)).try_cast("int")


def _fields(spark: SparkSession, files: list[str], quoted: bool, least: int) -> DataFrame:
    """(f: the line's fields, line, file, row, reason): row orders the lines inside a file. Headers are left out.

    ``quoted``: fields may be quoted and hold commas and line breaks; the records come from ``structural_parse`` with its
    reasons. An empty field is null then, if it isn't quoted, and so is a missing one.
    """
    headers = sorted({header_of(spark, f) for f in files})
    if quoted:
        n = max(least, *(len(h.split(",")) for h in headers))
        records = split_records(read_records(spark, files), "line", ["file_name", "record_no"], RecordSpec(n, (), least))
        f = F.array(*(f"f{i}" for i in range(n))).alias("f")
        return records.select(f, "line", F.col("file_name").alias("file"), F.col("record_no").alias("row"), "reason")
    text = spark.read.text(files).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    text = text.filter(~F.col("line").isin(headers)).select(fields_of(F.col("line")).alias("f"), "line", "file", F.monotonically_increasing_id().alias("row"))
    return text.withColumn("reason", F.when(F.size("f") < least, "columns"))


def read_nodes(spark: SparkSession, files: list[str], node: NodeType, ordinal: int, strict: bool = True, quoted: bool = False) -> DataFrame:
    """(node_id, key, <attributes>), the last row of a key (by file name, then line) winning.

    ``strict``: a text that doesn't parse, or a missing attribute other than a ``str``, ends the job; else it is null.
    The same goes for a record with broken quoting; if not ``strict``, it is left out.
    """
    raw = _fields(spark, files, quoted, 1)
    if quoted and strict:
        broken = F.raise_error(F.concat(F.lit("broken quoting in "), "file", F.lit(", record "), "row")).cast("boolean")
        raw = raw.filter(F.when(F.col("reason").isNull(), True).otherwise(broken))
    elif quoted:
        raw = raw.filter("reason IS NULL")
    columns = []
    for i, (name, token) in enumerate(node.attributes, start=1):
        text = F.get("f", F.lit(i))
        value = parse_column(text, token, strict)
        if strict and token != "str":
            value = F.when(F.size("f") <= i, F.raise_error(F.lit(f"a row of {node.name} has no {name}")).cast(type_of(token))).otherwise(value)
        columns.append(value.alias(name))
    rows = raw.select(node_id(ordinal, F.get("f", F.lit(0))).alias("node_id"), F.get("f", F.lit(0)).alias("key"), *columns, F.struct("file", "row").alias("_at"))
    return last_wins(rows, "node_id", "_at").drop("_at")


def relation_lines(spark: SparkSession, files: list[str], quoted: bool = False) -> DataFrame:
    """(f, line, file, row, reason): reason is null for a usable line, see ``reject_reason``; in quoted files also ``quoting``."""
    return _fields(spark, files, quoted, LEAST_FIELDS).withColumn("reason", F.coalesce("reason", reject_reason(F.col("f"))))


def read_relation(spark: SparkSession, files: list[str], rel: Relation, catalog: Catalog, quoted: bool = False) -> DataFrame:
    """Usable lines as edges (rel, src_id, dst_id, ts, <attributes after ts>); the others are dropped, see ``rejects``."""
    taken = {"rel", "src_id", "dst_id", "ts"}
    if clash := [n for n, _ in rel.attributes[1:] if n.lower() in taken]:
        raise ValueError(f"attributes of {rel.name} can't be called {clash}")
    good = relation_lines(spark, files, quoted).filter("reason IS NULL")
    attributes = [parse_column(F.get("f", F.lit(i)), token, strict=False).alias(name) for i, (name, token) in enumerate(rel.attributes[1:], start=3)]
    return good.select(
        F.lit(rel.name).alias("rel"),
        node_id(catalog.ordinal(rel.from_type), F.get("f", F.lit(0))).alias("src_id"),
        node_id(catalog.ordinal(rel.to_type), F.get("f", F.lit(1))).alias("dst_id"),
        ts_of(F.col("f")).alias("ts"),
        *attributes,
    )


def rejects(spark: SparkSession, files: list[str], quoted: bool = False) -> DataFrame:
    """(file, reason, line) of the lines that ``read_relation`` drops."""
    return relation_lines(spark, files, quoted).filter("reason IS NOT NULL").select("file", "reason", "line")


def rejected_lines(spark: SparkSession, files: list[str], quoted: bool = False) -> DataFrame:
    """Number of unusable lines by file."""
    return rejects(spark, files, quoted).groupBy("file").agg(F.count(F.lit(1)).alias("n_rejected"))


def _with_header(header: str):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header])], names=["value"])
        for b in batches:  # under one schema, whether or not the lines can be null
            yield pa.RecordBatch.from_arrays(b.columns, names=["value"])

    return lines


def write_lines(lines: DataFrame, header: str, directory: str, name: str) -> None:
    """Writes the lines (one string column) as ``<name>.<part>.csv`` in the directory: one file a partition, in their order,
    each with the header. Files of that name that were there are replaced."""
    spark = lines.sparkSession
    tmp = f"{directory}/_{name}"
    lines.toDF("value").mapInArrow(_with_header(header), "value string").write.mode("overwrite").text(tmp)
    jvm = spark.sparkContext._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(directory).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for old in fs.globStatus(path(f"{directory}/{name}{{,.*}}.csv")) or []:
        fs.delete(old.getPath(), False)
    for part in fs.globStatus(path(f"{tmp}/part-*")):
        number = part.getPath().getName().split("-")[1]
        fs.rename(part.getPath(), path(f"{directory}/{name}.{number}.csv"))
    fs.delete(path(tmp), True)
