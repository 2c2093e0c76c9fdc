"""Texts into containers of a fixed number of tokens: a grouping genetic algorithm on islands.

A chromosome is a packing (a set of bins). Crossover injects well-filled bins of one parent into the other, drops the
bins of the other that hold one of the injected items, and best-fits the items so displaced. Islands evolve the same
items from different starts; between epochs each takes over the best packing of its neighbour.

Scale: items are cut into shards of at most ``shard_items``, in the tasks that count the tokens and without a
shuffle; every (shard, island) is one small row of sizes. What a shard could not fill well goes to a second level,
where the rests of many shards are packed together by the same algorithm.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.common import materialize, pick, release, shuffle_width

#: Vocabulary file of the public tokenizer whose tokens are counted (byte-level BPE, 50,256 ranks).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern by which that tokenizer parts a text before merging bytes.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Islands that one task evolves at most, one after the other.
ROWS_PER_TASK = 64
#: Characters of a text from which its tokens are counted part by part.
LONG_TEXT = 1 << 20
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


@dataclass(frozen=True)
class Evolution:
    """Settings of the search. ``shard_items`` bounds the memory of a task and the size of a chromosome."""

    shard_items: int = 8192
    islands: int = 2
    epochs: int = 2
    population: int = 4
    generations: int = 6
    inject: float = 0.15
    seed: int = 11


# ---- packings


class Packing:
    """Bin of every item, and the load of every bin."""

    __slots__ = ("bin_of", "loads")

    def __init__(self, bin_of: np.ndarray, loads: np.ndarray):
        self.bin_of, self.loads = bin_of, loads

    def fitness(self, capacity: int) -> float:
        """Mean squared fill: rewards full bins beside bins that can still be emptied."""
        return float(np.mean((self.loads / capacity) ** 2)) if len(self.loads) else 1.0

    def rank(self, capacity: int) -> tuple:
        return (-len(self.loads), self.fitness(capacity))


def best_fit(order: list[int], sizes: list[int], bin_of: np.ndarray, loads: list[int], capacity: int) -> list[int]:
    """Puts the items of ``order`` each into the fullest bin that has room, else into a new one.

    The rooms of all bins are kept as the bits of one integer, so the tightest fit is a shift and a lowest set bit.
    """
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for b, load in enumerate(loads):
        room = capacity - load
        by_room.setdefault(room, []).append(b)
        rooms |= 1 << room
    for i in order:
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                rooms ^= 1 << room
        else:
            b, room = len(loads), capacity
            loads.append(0)
        bin_of[i] = b
        loads[b] += size
        left = room - size
        held = by_room.get(left)
        if held:
            held.append(b)
        else:
            by_room[left] = [b]
            rooms |= 1 << left
    return loads


def _compact(bin_of: np.ndarray, sizes: np.ndarray) -> Packing:
    used, inverse = np.unique(bin_of, return_inverse=True)
    return Packing(inverse.astype(np.int32), np.bincount(inverse, weights=sizes, minlength=len(used)).astype(np.int64))


def _noisy_order(items: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, noise: float) -> list[int]:
    """Large items first, more or less."""
    return items[np.argsort(-sizes[items] * (1 + noise * rng.random(len(items))), kind="stable")].tolist()


def first_packing(sizes: np.ndarray, capacity: int, rng: np.random.Generator, noise: float) -> Packing:
    bin_of = np.full(len(sizes), -1, dtype=np.int32)
    best_fit(_noisy_order(np.arange(len(sizes)), sizes, rng, noise), sizes.tolist(), bin_of, [], capacity)
    return _compact(bin_of, sizes)


def crossover(to: Packing, source: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator, inject: float) -> Packing:
    """``to`` with some of the best-filled bins of ``source``; bins of ``to`` that share items with them are dissolved."""
    wanted = max(1, int(inject * len(source.loads)))
    best = np.argsort(-source.loads, kind="stable")[: 3 * wanted]
    injected = rng.choice(best, size=min(wanted, len(best)), replace=False)
    is_in = np.zeros(len(source.loads), dtype=bool)
    is_in[injected] = True
    moved = is_in[source.bin_of]
    gone = np.zeros(len(to.loads), dtype=bool)
    gone[to.bin_of[moved]] = True
    gone[int(np.argmin(to.loads))] = True  # mutation: the emptiest bin gives up its items as well
    kept = ~gone[to.bin_of] & ~moved
    bin_of = np.full(len(sizes), -1, dtype=np.int32)
    new_name = np.cumsum(~gone) - 1
    bin_of[kept] = new_name[to.bin_of[kept]]
    n = int((~gone).sum())
    injected_name = np.zeros(len(source.loads), dtype=np.int64)
    injected_name[injected] = np.arange(n, n + len(injected))
    bin_of[moved] = injected_name[source.bin_of[moved]]
    loads = np.concatenate([to.loads[~gone], source.loads[injected]]).tolist()
    displaced = np.flatnonzero(bin_of < 0)
    best_fit(_noisy_order(displaced, sizes, rng, 0.3 * rng.random()), sizes.tolist(), bin_of, loads, capacity)
    return _compact(bin_of, sizes)


def evolve(sizes: np.ndarray, capacity: int, start: list[Packing], rng: np.random.Generator, how: Evolution) -> list[Packing]:
    """The population after ``generations``, best first; ends early at the least possible number of bins."""
    least = max(1, -(-int(sizes.sum()) // capacity))
    people = list(start)
    while len(people) < how.population:
        people.append(first_packing(sizes, capacity, rng, 0.0 if not people else 0.5 * rng.random()))
        if len(people[-1].loads) <= least:
            break
    key = lambda p: p.rank(capacity)
    people.sort(key=key, reverse=True)
    for _ in range(how.generations):
        if len(people[0].loads) <= least or len(people) < 2:
            break
        children = []
        for _ in range(how.population):
            a, b = sorted(rng.choice(len(people), size=2, replace=False))
            children.append(crossover(people[a], people[b], sizes, capacity, rng, how.inject))
            children.append(crossover(people[b], people[a], sizes, capacity, rng, how.inject))
        people = sorted([*people, *children], key=key, reverse=True)[: how.population]
    return people


# ---- tokens and items


class TokenCounter:
    """Counts the tokens of a text; loads the vocabulary once per Python worker.

    Very long texts are counted in parts, cut before a space between two letters: the tokenizer always parts there, so
    the count is that of the whole text.
    """

    _made: dict = {}

    def __init__(self, path: str = TOKENIZER, shared: Broadcast | None = None):
        """``shared``: the bytes of the vocabulary file, for tasks on machines that don't have it."""
        self.path, self.shared = path, shared

    def _vocabulary(self) -> bytes:
        if self.shared is not None:
            return self.shared.value
        with open(self.path, "rb") as f:
            return f.read()

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        enc = self._made.get(self.path)
        if enc is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self._vocabulary().splitlines())}
            enc = self._made[self.path] = tiktoken.Encoding("arcweave", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        n, done = 0, 0
        while len(text) - done > LONG_TEXT and (cut := _CUT.search(text, done + LONG_TEXT)):
            n += len(enc.encode_ordinary(text[done : cut.start()]))
            done = cut.start()
        return n + len(enc.encode_ordinary(text[done:] if done else text))


def _shards(capacity: int, how: Evolution, counter: TokenCounter | None):
    """Items of a partition's texts (or sizes, where ``counter`` is None) in shards of at most ``shard_items``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seq, where = 0, 0

        def shard(rows: list[tuple], full: bool) -> pa.RecordBatch:
            nonlocal seq
            seq += 1
            ids, starts, sizes = (list(x) for x in zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array([(where << 32) | seq], pa.int64()), pa.array([full]), pa.array([ids], pa.list_(kind)), pa.array([starts], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32()))],
                names=["shard", "whole", "ids", "starts", "sizes"],
            )

        for b in batches:
            kind = b.column(1).type
            if b.num_rows:
                where = b.column(0)[0].as_py()
            if counter is None:
                rows = zip(*(c.to_pylist() for c in b.columns[1:]))
            else:
                rows = ((k, 0, counter(t)) for k, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            over: list[tuple] = []
            for key, start, size in rows:
                while size > capacity:
                    over.append((key, start, capacity))
                    start, size = start + capacity, size - capacity
                    if len(over) == how.shard_items:
                        yield shard(over, True)
                        over = []
                held.append((key, start, size))
                if len(held) == how.shard_items:
                    yield shard(held, False)
                    held = []
            if over:  # pieces that fill a container each
                yield shard(over, True)
        if held:
            yield shard(held, False)

    return cut


_ELITE = "shard long, island int, bins int, fitness double, packing binary"


def _island(capacity: int, how: Evolution, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Evolves each (shard, island) of the batch from the elites that reached it."""
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for shard, island, sizes, elites in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                s = sizes.values.to_numpy().astype(np.int64)
                start = [_compact(np.frombuffer(e, dtype=np.int32), s) for e in sorted(elites.as_py() or [])]
                rng = np.random.default_rng([how.seed, epoch, island, shard & 0xFFFFFFFF, shard >> 32])
                best = evolve(s, capacity, start, rng, how)[0]
                for column, v in zip(out, (shard, island, len(best.loads), best.fitness(capacity), best.bin_of.tobytes())):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.binary())], names=["shard", "island", "bins", "fitness", "packing"])

    return run


def _spread(width: int, islands: int):
    """The task of each (shard, island): one after the other, so that as many tasks work as there are rows."""
    number = F.shiftright("shard", 32) + F.col("shard").bitwiseAND(F.lit(0xFFFFFFFF)) - 1
    return F.pmod(number * islands + F.col("island"), F.lit(width)).cast("int")


def _best_packings(shards: DataFrame, capacity: int, how: Evolution) -> DataFrame:
    """(shard, ids, starts, sizes, packing): the best packing that any island found for each shard.

    Every epoch places its rows by number. A repartition by (shard, island) would be left out as superfluous after the
    join of the elites on the same columns, and the few bytes of the join's partitions would then be put together into
    one task, whatever work they stand for.
    """
    rows = shards.count() * how.islands  # the count is read from file footers
    width = max(shuffle_width(shards.sparkSession), -(-rows // ROWS_PER_TASK))
    elites = None
    for epoch in range(how.epochs):
        seeds = shards.select("shard", "sizes").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(how.islands - 1))))
        before = elites
        if before is None:
            seeds = seeds.withColumn("elites", F.lit(None).cast("array<binary>"))
        else:  # every island keeps its own elite and gets that of the island before it
            reach = before.select("shard", "packing", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(how.islands)))).alias("island"))
            seeds = seeds.join(reach.groupBy("shard", "island").agg(F.collect_set("packing").alias("elites")), ["shard", "island"], "left")
        work = seeds.select("shard", "island", "sizes", "elites").repartitionById(width, _spread(width, how.islands))
        elites = materialize(work.mapInArrow(_island(capacity, how, epoch), _ELITE), f"elites-{epoch}")
        if before is not None:
            release(before)
    best = elites.groupBy("shard").agg(F.min(F.struct("bins", F.negative("fitness").alias("f"), "island", "packing")).alias("b")).select("shard", "b.packing")
    return shards.join(best, "shard")


def _decode(capacity: int, refill: int):
    """Rows (shard, bin, key, start, size, weak) of packed shards; weak: the bin has more than ``refill`` room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, ids, starts, sizes, packing in zip(*b.columns):
                s, where = np.array(sizes.values), np.frombuffer(packing.as_py(), dtype=np.int32)
                weak = (capacity - np.bincount(where, weights=s)) > refill
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s), shard.as_py(), np.int64)), pa.array(where), ids.values, starts.values, sizes.values, pa.array(weak[where])],
                    names=["shard", "bin", "key", "start", "size", "weak"],
                )

    return run


def pack_texts(df: DataFrame, key: str, text: str, capacity: int = 4096, tokenizer: str = TOKENIZER, how: Evolution = Evolution(), refill: float = 0.002) -> DataFrame:
    """Every text in a container: (container_id, <key>, token_start, n_tokens), one row per text or piece of a text.

    A text is split only if it alone exceeds ``capacity``: into pieces of exactly ``capacity`` tokens, each filling a
    container, and a rest that is packed like any text. Containers with more than ``refill`` of their capacity left
    over are dissolved once and packed again together with those of other shards.

    Defined cases: null and empty texts have 0 tokens and take no room in their container; every row of ``df`` comes
    out, repeated rows and null keys too; an empty table gives no rows; further columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    if key.lower() in {"container_id", "token_start", "n_tokens"}:
        raise ValueError(f"the key column can't be called {key}")
    src = pick(df, k=key, t=text)
    kind = src.schema["k"].dataType.simpleString()
    made = f"shard long, whole boolean, ids array<{kind}>, starts array<long>, sizes array<int>"
    rows = f"shard long, bin int, key {kind}, start long, size int, weak boolean"
    with open(tokenizer, "rb") as f:
        vocabulary = f.read()  # a few hundred KB
    counter = TokenCounter(tokenizer, src.sparkSession.sparkContext.broadcast(vocabulary))
    counted = src.select(F.spark_partition_id().cast("long").alias("p"), "k", "t").mapInArrow(_shards(capacity, how, counter), made)
    shards = materialize(counted, "shards")
    room = int(refill * capacity)
    pieces = shards.filter("whole").select("shard", F.posexplode(F.arrays_zip("ids", "starts", "sizes")).alias("bin", "z"))
    level_0 = pieces.select(F.concat_ws(".", F.lit("piece"), "shard", "bin").alias("container_id"), F.col("z.ids").alias("key"), F.col("z.starts").alias("start"), F.col("z.sizes").alias("size"))
    packed = _best_packings(shards.filter("NOT whole").drop("whole"), capacity, how)
    level_1 = materialize(packed.select("shard", "ids", "starts", "sizes", "packing").mapInArrow(_decode(capacity, room), rows), "packed")
    rest = level_1.filter("weak").select("key", "start", "size")
    # about one rest of a few items a shard: put together by as few tasks as hold a shard each
    n = rest.count()
    joined = rest.repartition(max(1, -(-n // how.shard_items))).select(F.spark_partition_id().cast("long").alias("p"), "key", "start", "size")
    again = materialize(joined.mapInArrow(_shards(capacity, how, None), made), "rests")
    level_2 = _best_packings(again.drop("whole"), capacity, how).select("shard", "ids", "starts", "sizes", "packing").mapInArrow(_decode(capacity, room), rows)
    name = lambda level: F.concat_ws(".", F.lit(level), "shard", "bin").alias("container_id")
    out = level_0.unionByName(level_1.filter("NOT weak").select(name("a"), "key", "start", "size")).unionByName(level_2.select(name("b"), "key", "start", "size"))
    return out.select("container_id", F.col("key").alias(key), F.col("start").alias("token_start"), F.col("size").alias("n_tokens"))
