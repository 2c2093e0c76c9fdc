"""Many small files into few large blocks, without loss: indexed archive containers.

A container block is the concatenation of the original bytes of many files, with an index of (path, id, offset,
length, checksum) beside it. Files are looked up by path through the index, or all read back in parallel, block by
block; checksums are verified whenever bytes are taken out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.common import materialize, pick, release, scratch_path
from arcweave.operators.structural_parse import COMMA, CR, LF, Numbers, slices

#: Bytes of a block; a file is never split over blocks, one larger than this gets a block of its own.
BLOCK_BYTES = 32 << 20

#: Blocks up to which a look-up names them in the scan.
NAMED_BLOCKS = 1_000

_BLOCK = "block_id long, n_files int, n_bytes long, data binary, entries array<struct<file_id:long,path:string,offset:long,length:long,crc:long>>"
_ENTRY = pa.list_(pa.struct([("file_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]))


def _pack(block_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, entries, seq, pid = bytearray(), [], 0, 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([(pid << 32) | seq], pa.int64()), pa.array([len(entries)], pa.int32()), pa.array([len(buffer)], pa.int64()), pa.array([bytes(buffer)], pa.binary()), pa.array([entries], _ENTRY)],
                names=["block_id", "n_files", "n_bytes", "data", "entries"],
            )

        for b in batches:
            for part, file_id, path, body in zip(*(c.to_pylist() for c in b.columns)):
                pid = part
                if entries and len(buffer) + len(body or b"") > block_bytes:
                    yield block()
                    buffer, entries, seq = bytearray(), [], seq + 1
                if body is None:
                    entries.append({"file_id": file_id, "path": path, "offset": len(buffer), "length": None, "crc": None})
                else:
                    entries.append({"file_id": file_id, "path": path, "offset": len(buffer), "length": len(body), "crc": zlib.crc32(body)})
                    buffer += body
        if entries:
            yield block()

    return pack


def pack(df: DataFrame, file_id: str, path: str, body: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Container blocks of all files: (block_id, n_files, n_bytes, data, entries).

    Each scan task packs the files that it reads, one open block at a time: the bytes are read once and never
    shuffled. Scan tasks already gather small input files up to ``spark.sql.files.maxPartitionBytes``.

    Defined cases: an empty file is an entry of length 0; a null body is an entry with null length and checksum;
    null ids and paths are kept as they are; repeated rows are kept as often as they occur; an empty table gives no
    blocks; further columns are ignored.
    """
    src = pick(df, fid=file_id, fpath=path, fbody=body)
    rows = src.select(F.spark_partition_id().cast("long").alias("part"), F.col("fid").cast("long"), F.col("fpath").cast("string"), F.col("fbody").cast("binary"))
    return rows.mapInArrow(_pack(block_bytes), _BLOCK)


#: Bytes of files that one task packs, where a directory is read.
TASK_BYTES = 128 << 20


def pack_directory(spark: SparkSession, directory: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Container blocks of all files below a directory; their paths are kept, their ids are null.

    The number of tasks follows the bytes, not the files: Spark reckons a file with 4 MB at least, so that millions of
    tiny ones would make as many tasks with nearly empty blocks. Lengths come from the listing, no file is opened for them.
    Empty files, which Spark's file sources leave out, are added from the listing by name.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    seen = found.agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    files = found.select("path", "content").coalesce(max(1, -(-(seen["bytes"] or 0) // TASK_BYTES)))
    if empty := _empty_files(found, seen["n"]):
        files = files.unionByName(spark.createDataFrame([(p, b"") for p in empty], "path string, content binary").coalesce(1))
    return pack(files.withColumn("file_id", F.lit(None).cast("long")), "file_id", "path", "content", block_bytes)


def _empty_files(found: DataFrame, not_empty: int) -> list[str]:
    """Paths of the files of length 0 in the driver's own listing of a file source, of which ``not_empty`` files have bytes."""
    listed = found._jdf.queryExecution().analyzed().relation().location().allFiles()
    if listed.size() == not_empty:
        return []
    out, each = [], listed.iterator()
    while each.hasNext():
        status = each.next()
        if not status.getLen():
            out.append(status.getPath().toString())
    return out


class Archive:
    """A written archive: ``blocks`` (the bytes) and ``index`` (one row per file) below one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, packed: DataFrame, path: str | None = None) -> Archive:
        """Writes ``packed`` below ``path`` (default: the shared folder of the session)."""
        spark = packed.sparkSession
        path = path or scratch_path(spark, "archive")
        packed.write.option("compression", "zstd").parquet(f"{path}/blocks")
        made = cls(spark, path)
        entries = made.blocks().select("block_id", F.explode("entries").alias("e")).select("block_id", "e.*")
        parts = max(1, made.blocks().count() // 64)
        entries.repartitionByRange(parts, "path").sortWithinPartitions("path").write.parquet(f"{path}/index")
        return made

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(_BLOCK).parquet(f"{self.path}/blocks")

    def index(self) -> DataFrame:
        """(block_id, file_id, path, offset, length, crc), sorted by path, so that a look-up reads few row groups."""
        return self.spark.read.schema("block_id long, file_id long, path string, offset long, length long, crc long").parquet(f"{self.path}/index")

    def lookup(self, path: str) -> DataFrame:
        """The files of one path: (file_id, path, body). The index is asked first, in a small job: up to NAMED_BLOCKS blocks
        are named in the filter of the scan, so that statistics leave out the others; only a path in more is joined."""
        hit = self.index().filter(F.col("path") == path)
        part = self.blocks().select("block_id", "data")
        few = [r[0] for r in hit.select("block_id").distinct().limit(NAMED_BLOCKS + 1).collect()]
        if len(few) <= NAMED_BLOCKS:
            part = part.filter(F.col("block_id").isin(sorted(few)))
        part = part.join(hit, "block_id")
        body = F.when(F.col("length").isNotNull(), F.substring("data", (F.col("offset") + 1).cast("int"), F.col("length").cast("int")))
        crc_ok = F.col("crc").isNull() | (F.crc32("body") == F.col("crc"))
        checked = F.when(crc_ok, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("checksum of "), "path"))).alias("body")
        return part.withColumn("body", body).select("file_id", "path", checked)

    def files(self) -> DataFrame:
        """All files: (file_id, path, body), checked against length and checksum; a damaged block ends the job."""
        return self.blocks().select("data", "entries").mapInArrow(_unpack, "file_id long, path string, body binary")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data, entries in zip(b.column(0), b.column(1).to_pylist()):
            view = memoryview(data.as_buffer())
            ids, paths, bodies, held = [], [], [], 0
            for e in entries:
                body = None if e["length"] is None else bytes(view[e["offset"] : e["offset"] + e["length"]])
                if body is not None and (len(body) != e["length"] or zlib.crc32(body) != e["crc"]):
                    raise ValueError(f"archive is damaged at {e['path']!r}")
                ids.append(e["file_id"]), paths.append(e["path"]), bodies.append(body)
                held += len(body or b"")
                if held > 4 << 20:
                    yield _files(ids, paths, bodies)
                    ids, paths, bodies, held = [], [], [], 0
            if ids:
                yield _files(ids, paths, bodies)


def _files(ids: list, paths: list, bodies: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], names=["file_id", "path", "body"])


#: Bytes of bodies that are searched for records at once.
PARSE_BYTES = 2 << 20

_RECORD = "file_id long, line_no long, pos long, arr_index long, arr_value long, ts int"


def _records_in(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(number of the body, line number in it, [pos, arr_index, arr_value, ts]) of all records in some bodies.

    Line ends and commas are located over the bytes of all bodies at once; a line with three commas whose four fields
    are integers is a record.
    """
    data = np.frombuffer(b"\n".join([*bodies, b""]), dtype=np.uint8)
    feed = data == LF
    after_cr = np.concatenate([[False], data[:-1] == CR])
    ends = np.flatnonzero(feed | np.concatenate([after_cr[1:] & ~feed[1:], [False]]))
    starts = np.concatenate([[0], ends[:-1] + 1])
    commas = np.flatnonzero(data == COMMA)
    of_line = np.searchsorted(ends, commas)
    lines = np.flatnonzero(np.bincount(of_line, minlength=len(ends)) == 3)
    inner = commas[np.isin(of_line, lines)].reshape(len(lines), 3)
    close = ends[lines] - (feed[ends[lines]] & after_cr[ends[lines]])
    bounds = np.concatenate([starts[lines][:, None] - 1, inner, close[:, None]], axis=1)
    numbers, good, values = Numbers(data), np.ones(len(lines), dtype=bool), []
    for k, bits in enumerate((64, 64, 64, 32)):
        ok, value = numbers.parse(bounds[:, k] + 1, bounds[:, k + 1], bits)
        good &= ok
        values.append(value)
    begins = np.cumsum([0, *(len(b) + 1 for b in bodies)])[:-1]
    lines = lines[good]
    body = np.searchsorted(begins, starts[lines], side="right") - 1
    return body, lines - np.searchsorted(starts, begins)[body], [v[good] for v in values]


def _parse_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of (file_id, path, body) batches."""
    for whole in batches:
        for b in slices(whole, 2, PARSE_BYTES):
            there = b.filter(b.column(2).is_valid())
            if not there.num_rows:
                continue
            body, line, values = _records_in(there.column(2).to_pylist())
            columns = [there.column(0).take(pa.array(body)), pa.array(line, pa.int64()), *(pa.array(v, pa.int64()) for v in values[:3]), pa.array(values[3].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["file_id", "line_no", "pos", "arr_index", "arr_value", "ts"])


def adjacency_records(files: DataFrame | Archive) -> DataFrame:
    """The records in the bodies of ``files`` (file_id, path, body) or of an archive: (file_id, line_no, pos, arr_index,
    arr_value, ts).

    A record is a line of four comma-separated integers, each with an optional sign; spaces and zeros in front and
    spaces behind do not matter. Lines end with LF, CR or CRLF; lines that are no record, or whose numbers leave 64
    (ts: 32) bits, are left out. From an archive the bodies go straight from the blocks into the parser.
    """
    if isinstance(files, Archive):
        return files.blocks().select("data", "entries").mapInArrow(lambda batches: _parse_records(_unpack(batches)), _RECORD)
    return files.select("file_id", "path", F.col("body").cast("binary").alias("body")).mapInArrow(_parse_records, _RECORD)


def surplus_copies(records: DataFrame) -> DataFrame:
    """(file_id, pos) of all copies but the one in the smallest file, distinct.

    Copies inside one file are combined before the shuffle; a pos in very many files is reduced to its smallest file
    by partial aggregation, and the join back streams over it. The distinct (file_id, pos) are written once, so that
    the bodies are not parsed again for the join.
    """
    held = materialize(records.select("file_id", "pos").distinct(), "held")
    keep = held.groupBy("pos").agg(F.min("file_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("pos", "kept")
    return held.join(keep, "pos").filter(F.col("file_id") > F.col("kept")).select("file_id", "pos")


def consolidated(records: DataFrame) -> DataFrame:
    """Each record once: of equal pos the one in the smallest file (there: the first line). (pos, arr_index, arr_value, ts)."""
    rest = F.struct("file_id", "line_no", "arr_index", "arr_value", "ts")
    return records.groupBy("pos").agg(F.min(rest).alias("r")).select("pos", "r.arr_index", "r.arr_value", "r.ts")


def write_consolidated(records: DataFrame, path: str, file_bytes: int = 256 << 20, row_bytes: int = 20) -> DataFrame:
    """Writes each record once into files of about ``file_bytes``, sorted by arr_index, and reads them back.

    Range partitioning on (arr_index, ts, pos) gives files of equal size even where one node has a third of the rows.
    ``row_bytes`` is what a record takes when compressed.
    """
    once = materialize(consolidated(records), "once")
    schema = once.schema
    files = max(1, -(-once.count() * row_bytes // file_bytes))
    by = ["arr_index", "ts", "pos"]
    once.repartitionByRange(files, *by).sortWithinPartitions(*by).write.option("compression", "zstd").parquet(path)
    release(once)
    return records.sparkSession.read.schema(schema).parquet(path)


def packed_archive(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> Archive:
    """``chunk_file`` as an archive in the shared folder."""
    return Archive.write(pack(df, "file_id", "file_name", "body", block_bytes))
