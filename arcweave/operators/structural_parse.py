"""Delimited records: split, check, and part valid rows from rejects with a reason.

Structural indexing on the raw bytes of a whole Arrow batch: quote and comma masks, the parity of quotes before each
byte, and from these the positions of all delimiters at once. No record is looked at alone in Python.

With q the number of double quotes before a byte inside its record, a comma is a delimiter where q is even. A record
is well quoted exactly if its number of quotes is even, each opening quote (q even) stands at the record's start or
right after a comma or a closing quote (the latter is a doubled quote), and each closing quote (q odd) is followed by
the record's end, a comma or an opening quote.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweave.common import by_position, materialize, position, shuffle_width
from arcweave.functions.types import bool_column

QUOTE, COMMA, CR, LF, SPACE, PLUS, MINUS, ZERO = 34, 44, 13, 10, 32, 43, 45, 48


#: Bytes of lines that are indexed at once.
INDEX_BYTES = 4 << 20


@dataclass(frozen=True)
class KeyCheck:
    """Field ``at`` must be ``stem`` ASCII letters or digits followed by ``suffix``."""

    name: str
    at: int
    suffix: str
    stem: int = 8


@dataclass(frozen=True)
class IntCheck:
    """Field ``at`` without surrounding spaces must be an optionally signed decimal integer in ``bits`` (64 at most) bits."""

    name: str
    at: int
    bits: int = 32


@dataclass(frozen=True)
class RecordSpec:
    """Number of fields and the checks, in the order in which a reason is chosen after ``quoting`` and ``columns``.

    ``least``: a record may have fewer fields, down to this number (the others are null then, and checks are for fields
    that are always there), or more (which are left out)."""

    fields: int
    checks: tuple[KeyCheck | IntCheck, ...]
    least: int | None = None


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_DIGIT = _table(b"0123456789")
_ALNUM = _table(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


class Numbers:
    """Decimal integers between given positions of a byte array, all at once."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(1, np.uint8)])
        self.solid = np.flatnonzero(self.data != SPACE)  # the last one is the byte behind the data
        self.strange = np.flatnonzero(~_DIGIT[self.data])
        self.significant = np.flatnonzero(self.data != ZERO)

    def parse(self, lo: np.ndarray, hi: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(usable, value) of the fields [lo, hi): without spaces around, an optional sign and digits, in the range of
        ``bits`` (64 at most); the value is 0 where a field isn't usable."""
        data = self.data
        lo = np.minimum(self.solid[np.searchsorted(self.solid, lo)], hi)
        last = self.solid[np.searchsorted(self.solid, hi) - 1]  # -1: nothing solid before, the field is empty then
        hi = np.where(lo < hi, last + 1, hi)
        sign = data[lo]
        negative = (lo < hi) & (sign == MINUS)
        lo = lo + ((lo < hi) & (negative | (sign == PLUS)))
        ok = (hi > lo) & (self.strange[np.searchsorted(self.strange, lo)] >= hi)
        lo = np.where(ok, np.minimum(self.significant[np.searchsorted(self.significant, lo)], hi), hi)
        half = 1 << (bits - 1)
        most = len(str(half))
        ok &= hi - lo <= most
        size = np.zeros(len(lo), dtype=np.uint64)  # 19 digits fit
        for k in range(min(most, int((hi - lo)[ok].max(initial=0))), 0, -1):
            at = hi - k
            size = size * np.uint64(10) + np.where(ok & (at >= lo), data[np.maximum(at, 0)] - ZERO, 0).astype(np.uint64)
        ok &= size <= np.where(negative, np.uint64(half), np.uint64(half - 1))
        value = size.astype(np.int64)  # of -2^63 the bits are right already, and negation keeps them
        return ok, np.where(ok, np.where(negative, -value, value), 0)


class Index:
    """Structural index of a batch of records."""

    def __init__(self, lines: pa.Array, fields: int, least: int | None = None):
        lines = lines.cast(pa.large_binary())
        n = len(lines)
        offs = np.frombuffer(lines.buffers()[1], dtype=np.int64)[lines.offset : lines.offset + n + 1]
        raw = lines.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
        offs = offs - offs[0]
        start, end = offs[:-1], offs[1:].copy()
        if len(data):
            end -= (end > start) & (data[np.maximum(end, 1) - 1] == CR)
        self.data, self.n, self.numbers = data, n, None
        # quotes: rank inside the record, and what must stand beside an opening or closing one
        padded = np.concatenate([data, np.zeros(1, np.uint8)])
        is_quote = data == QUOTE
        before = np.concatenate([[0], np.cumsum(is_quote)])  # quotes before each byte
        qpos = np.flatnonzero(is_quote)
        qrec = np.searchsorted(offs, qpos, side="right") - 1
        opening = (before[qpos] - before[start[qrec]]) % 2 == 0
        left, right = padded[qpos - 1], padded[qpos + 1]
        fine = np.where(opening, (qpos == start[qrec]) | (left == COMMA) | (left == QUOTE), (qpos + 1 == end[qrec]) | (right == COMMA) | (right == QUOTE))
        self.misquoted = (before[end] - before[start]) % 2 == 1
        self.misquoted[qrec[~fine]] = True
        # delimiters: commas at even parity
        cpos = np.flatnonzero(data == COMMA)
        crec = np.searchsorted(offs, cpos, side="right") - 1
        even = (before[cpos] - before[start[crec]]) % 2 == 0
        cpos, crec = cpos[even], crec[even]
        self.arity = np.bincount(crec, minlength=n) + 1
        missing = lines.is_null().to_numpy(zero_copy_only=False)
        self.arity[missing] = 0
        # bounds of every field of the records of the right shape, quotes taken off
        self.fits = self.arity == fields if least is None else self.arity >= least
        self.sound = ~self.misquoted & self.fits
        at = np.flatnonzero(self.sound)
        number = np.cumsum(self.sound) - 1  # of a sound record among these
        mine = self.sound[crec]
        rank = (np.arange(len(cpos)) - np.searchsorted(crec, np.arange(n))[crec])[mine]  # of a comma in its record
        row, comma = number[crec[mine]], cpos[mine]
        self.lo = np.repeat(end[at][:, None], fields, axis=1)  # where a field is absent: empty, at the record's end
        self.hi = self.lo.copy()
        self.lo[:, 0] = start[at]
        self.hi[row[rank < fields], rank[rank < fields]] = comma[rank < fields]
        inner = rank + 1 < fields
        self.lo[row[inner], rank[inner] + 1] = comma[inner] + 1
        self.quoted = (self.hi > self.lo) & (padded[np.minimum(self.lo, len(data))] == QUOTE)
        self.lo, self.hi, self.rows = self.lo + self.quoted, self.hi - self.quoted, at

    def key_ok(self, c: KeyCheck) -> np.ndarray:
        lo, width = self.lo[:, c.at], c.stem + len(c.suffix)
        ok = self.hi[:, c.at] - lo == width
        cells = self.data[lo[ok][:, None] + np.arange(width)]
        ok[ok] = _ALNUM[cells[:, : c.stem]].all(axis=1) & (cells[:, c.stem :] == np.frombuffer(c.suffix.encode(), np.uint8)).all(axis=1)
        return ok

    def integers(self, c: IntCheck) -> tuple[np.ndarray, np.ndarray]:
        """(usable, value) of an integer field; the value is 0 where it isn't usable."""
        self.numbers = self.numbers or Numbers(self.data)
        return self.numbers.parse(self.lo[:, c.at], self.hi[:, c.at], c.bits)

    def texts(self, field: int, which: np.ndarray) -> pa.Array:
        """The field's text in the sound records ``which``; an empty field without quotes is null."""
        lo, hi, quoted = self.lo[which, field], self.hi[which, field], self.quoted[which, field]
        size = hi - lo
        ends = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(lo - ends[:-1], size) + np.arange(ends[-1])
        valid = quoted | (size > 0)
        bits = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
        out = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(self.data[source].tobytes()), bits)
        if quoted.any():
            out = pc.if_else(pa.array(quoted), pc.replace_substring(out, '""', '"'), out)
        return out.cast(pa.string())


def slices(b: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """``b`` in slices whose texts (or bytes) of ``column`` come to about ``size`` bytes; a longer one gets its own slice."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < b.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield b.slice(begin, end - begin)
        begin = end


def _splitter(spec: RecordSpec, key_columns: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, key_columns, INDEX_BYTES)):
            x = Index(b.column(key_columns), spec.fields, spec.least)
            reason = np.full(x.n, None, dtype=object)
            reason[~x.fits] = "columns"
            reason[x.misquoted] = "quoting"
            open_ = np.ones(len(x.rows), dtype=bool)
            for c in spec.checks:
                ok = x.key_ok(c) if isinstance(c, KeyCheck) else x.integers(c)[0]
                reason[x.rows[open_ & ~ok]] = c.name
                open_ &= ok
            back = np.full(x.n, -1)
            back[x.rows[open_]] = np.arange(int(open_.sum()))
            take = pa.array(back, mask=back < 0)
            fields = [x.texts(f, open_).take(take) for f in range(spec.fields)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: key_columns + 1], pa.array(reason, pa.string()), *fields],
                names=[*(f"k{i}" for i in range(key_columns)), "line", "reason", *(f"f{i}" for i in range(spec.fields))],
            )

    return split


def split_records(df: DataFrame, line: str, keys: Sequence[str], spec: RecordSpec) -> DataFrame:
    """One row per input row: the ``keys`` columns, ``line``, ``reason`` (null for a valid record), f0, f1, ... .

    f0... hold the fields of a valid record, unquoted, and are null in a reject. Reasons, first one that applies:
    ``quoting``, ``columns``, then the checks of ``spec``. One carriage return at the very end is not part of the
    record. The operator is a narrow map: no shuffle, no limit on the length of a line. A task indexes about
    ``INDEX_BYTES`` at once, as the index takes some tens of bytes for each byte of input.

    Defined cases: a null line and an empty one have too few fields (``columns``); an empty field without quotes is
    null, ``""`` is the empty string; repeated rows come out as often as they go in; further columns are ignored.
    ``keys`` must not be called line, reason or f<i>.
    """
    out = ["line", "reason", *(f"f{i}" for i in range(spec.fields))]
    if clash := {k.lower() for k in keys} & set(out):
        raise ValueError(f"key columns can't be called {sorted(clash)}")
    plain = by_position(df)
    src = plain.select(*[F.col(f"c{position(df, k)}").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"c{position(df, line)}").cast("string").alias("line"))
    schema = ", ".join([*(f"k{i} {src.schema[i].dataType.simpleString()}" for i in range(len(keys))), *(f"{c} string" for c in out)])
    return src.mapInArrow(_splitter(spec, len(keys)), schema).toDF(*keys, *out)


#: Bytes of a file whose record ends are located at once, and bytes of files that a task reads.
FILE_BLOCK = 8 << 20
FILE_TASK = 128 << 20


def record_ends(data: np.ndarray, quotes_before: int = 0) -> np.ndarray:
    """Positions of the line feeds that end a record: those before which the number of quotes is even."""
    feeds = np.flatnonzero(data == LF)
    quotes = np.concatenate([[0], np.cumsum(data == QUOTE)])
    return feeds[(quotes[feeds] + quotes_before) % 2 == 0]


def _open(path: str):
    """A file to read from: local ones by the operating system, others by pyarrow's file systems."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return open("/" + rest.lstrip("/") if colon else path, "rb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(at)


def _block_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks (path, offset, size): parity of their quotes, and the record ends in them if they begin outside quotes or inside."""
    for b in batches:
        out: list[tuple[int, int, int]] = []
        for path, offset, size in zip(*(c.to_pylist() for c in b.columns)):
            with _open(path) as f:
                f.seek(offset)
                data = np.frombuffer(f.read(size), dtype=np.uint8)
            out.append((int((data == QUOTE).sum()) % 2, len(record_ends(data, 0)), len(record_ends(data, 1))))
        parity, outside, inside = (pa.array(x, pa.int64()) for x in zip(*out)) if out else [pa.array([], pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([*b.columns, parity, outside, inside], names=["path", "offset", "size", "parity", "outside", "inside"])


def _block_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that begin in blocks (path, offset, size, odd, ends): ``odd`` if a quote is open at the block's begin, and
    the number of record ends before it. A record that goes on behind its block is read on to its end."""
    for b in batches:
        for path, offset, size, odd, ends_before in zip(*(c.to_pylist() for c in b.columns)):
            with _open(path) as f:
                f.seek(max(0, offset - 1))
                fresh = offset == 0 or (f.read(1) == b"\n" and not odd)
                data = np.frombuffer(f.read(size), dtype=np.uint8)
                ends = record_ends(data, odd)
                begins = np.concatenate([np.zeros(int(fresh), np.int64), ends[ends + 1 < len(data)] + 1])
                if not len(begins):
                    continue
                number = ends_before + (0 if fresh else 1)
                close = ends if fresh else ends[1:]
                if len(close) < len(begins):  # the last record is still open
                    parts, quotes, at = [data], int((data == QUOTE).sum()) + odd, len(data)
                    while more := f.read(FILE_BLOCK):
                        more = np.frombuffer(more, dtype=np.uint8)
                        later = record_ends(more, quotes)
                        parts.append(more[: later[0]] if len(later) else more)
                        at += len(parts[-1])
                        if len(later):
                            break
                        quotes += int((more == QUOTE).sum())
                    data, close = np.concatenate(parts), np.append(close, at)
            raw = data[begins[0] : close[-1]]
            source = np.ones(len(raw), dtype=bool)
            source[close[:-1] - begins[0]] = False  # a record does not hold the line feed that ends it
            bounds = np.concatenate([[0], np.cumsum(close - begins)])
            text = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(raw[source].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(begins)), pa.array(np.arange(number, number + len(begins))), text.cast(pa.string())], names=["file_name", "record_no", "line"])


def read_records(spark: SparkSession, paths: str | list[str], header: bool = True, block_bytes: int = FILE_BLOCK) -> DataFrame:
    """Records of delimited files whose fields may hold line breaks: (file_name, record_no, line), for split_records.

    Record ends are the line feeds outside quotes. Files are cut into blocks that are read by many tasks: a first pass
    finds the parity of the quotes in each block, the prefix parity of the blocks of a file tells each of them whether
    it begins inside quotes, and a second pass takes from each block the records that begin in it. Only one row a block is
    shuffled. Other than local files are opened by pyarrow's file systems.

    A quote that is never closed takes the rest of its file into one record (2 GB at most), which split_records then
    rejects. Empty files have no records.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "length").filter("length > 0")
    total = files.agg(F.sum("length")).first()[0] or 0  # from the listing
    tasks = max(shuffle_width(spark), -(-total // FILE_TASK))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long"))).alias("offset")
    blocks = files.select("path", at, "length").select("path", "offset", F.least(F.lit(block_bytes), F.col("length") - F.col("offset")).alias("size"))
    states = blocks.repartition(tasks).mapInArrow(_block_states, "path string, offset long, size long, parity long, outside long, inside long")
    before = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    states = states.withColumn("odd", F.pmod(sum_before("parity"), F.lit(2)))
    states = states.withColumn("ends", sum_before(F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside"))))
    placed = materialize(states.select("path", "offset", "size", "odd", "ends"), "blocks")
    records = placed.repartition(tasks).mapInArrow(_block_records, "file_name string, record_no long, line string")
    return records.filter("record_no > 0") if header else records


def rejects(split: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The records that can't be used: ``keys``, reason, line."""
    return split.filter(F.col("reason").isNotNull()).select(*keys, "reason", "line")


def relation_spec(from_type: str, to_type: str) -> RecordSpec:
    """A relation record: from, to, ts and three attributes that may hold anything."""
    return RecordSpec(6, (KeyCheck("from_key", 0, from_type), KeyCheck("to_key", 1, to_type), IntCheck("ts", 2)))


def relation_rows(split: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The valid records as typed relation rows: ``keys``, from_key, to_key, ts, attr2, attr3, attr4.

    attr2 is null where it isn't a number; attr3 follows the boolean rule of the node and relation files (null stays
    null); attr4 is the text as it is.
    """
    good = split.filter(F.col("reason").isNull())
    return good.select(
        *keys,
        F.col("f0").alias("from_key"),
        F.col("f1").alias("to_key"),
        F.trim(F.col("f2")).cast("int").alias("ts"),
        F.col("f3").try_cast("double").alias("attr2"),
        F.when(F.col("f4").isNotNull(), bool_column(F.col("f4"))).alias("attr3"),
        F.col("f5").alias("attr4"),
    )
