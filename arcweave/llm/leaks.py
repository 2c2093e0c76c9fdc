"""Evaluation passages inside a training corpus: spaced-seed hashing.

Words are the maximal runs of letters and digits of the canonical text in lower case. A seed is a fixed mask over
``min_words`` consecutive words; words at the masked-out places are ignored, so a seed survives substitutions there.
The masks together ignore every choice of ``substitutions`` places, so that any ``min_words`` words with at most so many
exchanged ones make a mask hit, wherever these stand: neither exact nor similar overlaps are missed. The seed hashes of
all test items are joined with those of all corpus positions, and around each hit the two texts are compared word
by word along the hit's diagonal, all hits of a group of texts at once. Words are compared by 64-bit hashes.

Few corpus windows get as far as a seed: a similar window of n words with s exchanged ones has n - 1 - 2 s pairs of
neighbouring words at least in common with an item, so windows with fewer pairs that occur in any item are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.common import materialize, pick, shuffle_width
from arcweave.llm.canonical import Canonical

#: Test seeds and test bytes up to which the test side is sent to all tasks; beyond, the hashes are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000
BROADCAST_BYTES = 32 << 20
#: Bits of the sieves that filter the corpus side of the join: at least and at most.
SIEVE_BITS = (20, 28)
#: Places of diagonals that are compared at once.
CELLS = 1 << 22
#: Characters that are hashed at once; longer texts are hashed in slices cut between words.
GROUP_CHARS = 1 << 20

_WORD = re.compile(r"[^\W_]+")
_B = np.uint64(0x9E3779B97F4A7C15)
_OUT = "doc_id {k}, item_id {i}, exact_words int, similar_words int, substitutions int, doc_word int, item_word int"


def words_of(text: str, form: Canonical) -> list[str]:
    return _WORD.findall(form(text).lower())


def masks(min_words: int, substitutions: int = 2) -> list[list[int]]:
    """Masks of span ``min_words`` of which one at least has none of any ``substitutions`` places.

    The places fall into ``substitutions`` + 2 classes, and each mask ignores another choice of ``substitutions`` of them.
    In fewer words than classes, the first word is the seed: a similar span begins with an equal word.
    """
    classes = substitutions + 2
    if substitutions and min_words < classes:
        return [[0]]
    return [[p for p in range(min_words) if p % classes not in left_out] for left_out in combinations(range(min(classes, min_words)), substitutions)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hasher:
    """Hashes of all words of many texts at once: the texts' code points as one array, with prefix sums.

    Works in slices of about GROUP_CHARS, cut between words, so that a very long text takes no more memory than its
    word hashes.
    """

    def __init__(self):
        self.is_word = np.array([chr(c).isalnum() for c in range(0x10000)])
        self.code = _mix(np.arange(1, 0x10001, dtype=np.uint64) * _B)
        self.inverse = np.uint64(pow(int(_B), -1, 1 << 64))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, number of the text it is in)."""
        joined = "\n".join(texts)
        hashes, begins, done = [], [], 0
        while done < len(joined) or not done:
            upto = min(len(joined), done + GROUP_CHARS)
            while upto < len(joined) and joined[upto].isalnum():
                upto += 1
            h, begin = self._slice(joined[done:upto])
            hashes.append(h), begins.append(begin + done)
            if upto == len(joined):
                break
            done = upto
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return np.concatenate(hashes), np.searchsorted(starts, np.concatenate(begins), side="right") - 1

    def _slice(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first character) of each word: sums of mixed codes times powers, shifted back to the word's start."""
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        high = cps > 0xFFFF
        small = np.where(high, 0, cps)
        word, code = self.is_word[small], self.code[small]
        if high.any():
            at = np.flatnonzero(high)
            word[at] = [chr(c).isalnum() for c in cps[at].tolist()]
            code[at] = _mix(cps[at].astype(np.uint64) * _B)
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        n = len(cps)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(code * _powers(_B, n), out=sums[1:])
        return _mix((sums[end] - sums[begin]) * _powers(self.inverse, n + 1)[begin] + (end - begin).astype(np.uint64)), begin


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _seeds(words: np.ndarray, mask: list[int], at: np.ndarray) -> np.ndarray:
    """Seed hash of the windows that begin at ``at``."""
    h = np.full(len(at), np.uint64(len(mask) + mask[-1]), dtype=np.uint64)
    for p in mask:
        h *= _B
        h += words[at + p]
    return _mix(h)


class _Sieve:
    """A set of hashes by some of their bits: it may say yes to others, but never no to one of its own."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def size(n: int) -> int:
        """Bits for ``n`` hashes: 16 for each, rounded up to a power of two, within SIEVE_BITS."""
        return 1 << min(max((16 * max(n, 1) - 1).bit_length(), SIEVE_BITS[0]), SIEVE_BITS[1])

    @classmethod
    def of(cls, hashes: np.ndarray) -> _Sieve:
        made = cls(np.zeros(cls.size(len(hashes)) // 8, np.uint8))
        at = hashes & made.mask
        np.bitwise_or.at(made.bits, at >> np.uint64(3), (np.uint64(1) << (at & np.uint64(7))).astype(np.uint8))
        return made

    @classmethod
    def collect(cls, hashes: DataFrame, column: str) -> _Sieve:
        """Of a distributed column of longs. What is brought together is of the sieve's size, whatever the column's."""
        size = cls.size(hashes.count())
        at = F.col(column).bitwiseAND(F.lit(size - 1))
        bit = F.expr(f"shiftleft(1L, int({column} & 63))")
        words = hashes.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        made = np.zeros(size // 64, np.int64)
        made[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        return cls(made.view(np.uint8))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class _Windows:
    """Seed hashes of all windows of a list of texts."""

    def __init__(self, min_words: int, form: Canonical, substitutions: int = 2):
        self.span, self.masks, self.form, self.hasher = min_words, masks(min_words, substitutions), form, None
        self.pairs_needed = min_words - 1 - 2 * substitutions

    def __getstate__(self):
        return self.__dict__ | {"hasher": None}

    def groups(self, texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
        """(number of the first text, canonical lower-case texts) in groups of about GROUP_CHARS."""
        first, held, chars = 0, [], 0
        for i, t in enumerate(texts):
            t = self.form(t).lower() if t else ""
            if held and chars + len(t) > GROUP_CHARS:
                yield first, held
                first, held, chars = i, [], 0
            held.append(t)
            chars += len(t) + 1
        if held:
            yield first, held

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, number of the text it is in)."""
        self.hasher = self.hasher or _Hasher()
        return self.hasher(texts)

    def __call__(self, texts: list[str], pairs: _Sieve | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per mask: (mask number, seed hash, number of the text, word number in it) of all whole windows, or of those
        with enough neighbouring words in ``pairs``."""
        return self.seeds(*self.words(texts), len(texts), pairs)

    def seeds(self, words: np.ndarray, of: np.ndarray, texts: int, pairs: _Sieve | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        n = len(words) - self.span + 1
        if n <= 0:
            return
        whole = of[:n] == of[self.span - 1 :]
        if pairs is not None and self.pairs_needed > 0:
            known = np.concatenate([[0], np.cumsum(pairs(word_pairs(words)), dtype=np.int32)])
            whole &= known[self.span - 1 :] - known[:n] >= self.pairs_needed
        whole = np.flatnonzero(whole)
        first = np.searchsorted(of, np.arange(texts))
        for m, mask in enumerate(self.masks):
            yield m, _seeds(words, mask, whole), of[whole], whole - first[of[whole]]


def word_pairs(words: np.ndarray) -> np.ndarray:
    """Hash of each word and the one after it; also over the end of a text, which no whole window reaches."""
    return _mix(words[:-1] * _B + words[1:])


@dataclass
class _Lines:
    """Diagonals to compare along, one a row: the pair that it belongs to, where its texts begin in ``docs`` and ``items``
    and how many words they have, and the diagonal (doc place - item place)."""

    pair: np.ndarray
    doc: np.ndarray
    doc_words: np.ndarray
    item: np.ndarray
    item_words: np.ndarray
    diagonal: np.ndarray

    def part(self, rows: slice) -> _Lines:
        return _Lines(*(x[rows] for x in (self.pair, self.doc, self.doc_words, self.item, self.item_words, self.diagonal)))

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """First item place that lies within the doc, and the number of such places."""
        lo = np.maximum(0, -self.diagonal)
        return lo, np.maximum(0, np.minimum(self.item_words, self.doc_words - self.diagonal) - lo)


def _spans(docs: np.ndarray, items: np.ndarray, lines: _Lines, allowed: int, least: int) -> np.ndarray:
    """Rows (pair, -length, exchanged, in doc, in item, longest run of equal words beside it) of the similar spans of all
    lines that have one of ``least`` words."""
    lo, size = lines.bounds()
    ends = np.cumsum(size + 2)  # with an unequal cell on either side
    begins = ends - size - 2
    row = np.repeat(np.arange(len(size)), size + 2)
    place = np.arange(len(row)) - begins[row] - 1 + lo[row]
    inside = (place >= lo[row]) & (place < (lo + size)[row])
    r, p = row[inside], place[inside]
    equal = np.zeros(len(row), dtype=bool)
    equal[inside] = docs[(lines.doc + lines.diagonal)[r] + p] == items[lines.item[r] + p]
    wrong = np.flatnonzero(~equal)
    last = np.searchsorted(wrong, ends - 1)  # of each row the unequal cell at its end
    k = np.flatnonzero(np.diff(wrong) > 1)  # those with an equal word behind them
    at = row[wrong[k]]
    j = np.minimum(k + 1 + allowed, last[at])
    for _ in range(allowed):  # end with an equal word
        j -= (j > k + 1) & (wrong[j] - wrong[j - 1] == 1)
    length, run = wrong[j] - wrong[k] - 1, wrong[k + 1] - wrong[k] - 1
    longest, exact = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
    np.maximum.at(longest, at, length)
    np.maximum.at(exact, at, run)
    keep = (length >= least) & (length == longest[at])
    k, j, at, length = k[keep], j[keep], at[keep], length[keep]
    in_item = place[wrong[k]] + 1
    return np.stack([lines.pair[at], -length, j - k - 1, lines.diagonal[at] + in_item, in_item, exact[at]], axis=1)


def _best(docs: np.ndarray, items: np.ndarray, lines: _Lines, allowed: int, least: int) -> np.ndarray:
    """Per pair with a similar span of ``least`` words: (pair, exact words, similar words, exchanged, doc word, item word)."""
    cells = np.cumsum(lines.bounds()[1] + 2)
    found, begin = [np.zeros((0, 6), dtype=np.int64)], 0
    while begin < len(cells):
        end = max(begin + 1, int(np.searchsorted(cells, (cells[begin - 1] if begin else 0) + CELLS, side="right")))
        found.append(_spans(docs, items, lines.part(slice(begin, end)), allowed, least))
        begin = end
    spans = np.concatenate(found)
    spans = spans[np.lexsort(spans[:, 4::-1].T)]
    first = np.flatnonzero(np.diff(spans[:, 0], prepend=-1))
    exact = np.maximum.reduceat(spans[:, 5], first) if len(first) else spans[:, 5]
    pair, similar, exchanged, in_doc, in_item = spans[first, :5].T
    return np.stack([pair, exact, -similar, exchanged, in_doc, in_item], axis=1)


def compare(doc: list, item: list, diagonals: set[int], allowed: int, least: int = 0) -> tuple[int, int, int, int, int]:
    """Best overlap along the diagonals (doc place - item place): (exact run, similar span, its substitutions,
    its place in doc, in item). A similar span begins and ends with equal words and has ``allowed`` others at most; of
    equally long ones the one with the fewest substitutions counts, then the first in doc, then in item. Diagonals
    without a similar span of ``least`` words count for nothing."""
    d = np.array(sorted(diagonals), dtype=np.int64)
    same = lambda v: np.full(len(d), v, dtype=np.int64)
    found = _best(np.array(doc, dtype=object), np.array(item, dtype=object), _Lines(same(0), same(0), same(len(doc)), same(0), same(len(item)), d), allowed, least)
    return tuple(int(x) for x in found[0][1:]) if len(found) else (0, 0, 0, 0, 0)


class _Tests:
    """The test side of a join in one process: words, seeds and sieves of some items. Words are compared by their hashes."""

    def __init__(self, texts: list[str], windows: _Windows):
        self.windows = windows
        words, seeds, owner, place = [np.zeros(0, np.uint64)], *([[] for _ in windows.masks] for _ in range(3))
        of_item = [np.zeros(0, np.int64)]
        for first, group in windows.groups(texts):
            own, of = windows.words(group)
            words.append(own), of_item.append(of + first)
            for m, h, of, at in windows.seeds(own, of, len(group)):
                seeds[m].append(h), owner[m].append(of + first), place[m].append(at)
        self.words = np.concatenate(words)
        self.pairs = _Sieve.of(np.concatenate([word_pairs(x) for x in words]))
        bounds = np.searchsorted(np.concatenate(of_item), np.arange(len(texts) + 1))
        self.begin, self.size = bounds[:-1], np.diff(bounds)
        self.masks = []
        for s, o, p in zip(seeds, owner, place):
            s, o, p = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((s, np.uint64), (o, np.int64), (p, np.int64)))
            by = np.lexsort((p, o, s))
            s, o, p = s[by], o[by], p[by]
            # cells: the places of one seed in one item
            new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1])])) if len(s) else np.zeros(0, np.int64)
            self.masks.append((_Sieve.of(s), s[new], o[new], new, np.diff(np.append(new, len(s))), p))

    def _hits(self, words: np.ndarray, of: np.ndarray, texts: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Per mask: (text and item as one number, window, first place of the item's seed in ``places``, their number, places)."""
        for m, h, doc, at in self.windows.seeds(words, of, texts, self.pairs):
            sieve, seed, owner, begin, size, places = self.masks[m]
            near = np.flatnonzero(sieve(h))
            lo, hi = np.searchsorted(seed, h[near], "left"), np.searchsorted(seed, h[near], "right")
            cell = _ranges(lo, hi - lo)
            w = np.repeat(near, hi - lo)
            yield doc[w] * len(self.size) + owner[cell], at[w], begin[cell], size[cell], places

    def overlaps(self, group: list[str], allowed: int, least: int) -> Iterator[tuple]:
        """(number of the text, number of the item, exact words, similar words, substitutions, doc word, item word).

        A pair that has more hits than diagonals is compared along all of these: in repetitive texts hits are counted
        and not listed."""
        words, of = self.windows.words(group)
        hits = list(self._hits(words, of, len(group)))
        if not hits:
            return
        pairs, number = np.unique(np.concatenate([h[0] for h in hits]), return_inverse=True)
        if not len(pairs):
            return
        bounds = np.searchsorted(of, np.arange(len(group) + 1))
        doc, item = np.divmod(pairs, len(self.size))
        doc_words, item_words = np.diff(bounds)[doc], self.size[item]
        listed = np.bincount(number, weights=np.concatenate([h[3] for h in hits]), minlength=len(pairs)) <= doc_words + item_words
        lines, done = [], 0
        for key, at, begin, size, places in hits:
            own = number[done : done + len(key)]
            done += len(key)
            few = listed[own]
            diagonal = np.repeat(at[few], size[few]) - places[_ranges(begin[few], size[few])]
            lines.append(np.stack([np.repeat(own[few], size[few]), diagonal], axis=1))
        every = np.flatnonzero(~listed)
        width = (doc_words + item_words)[every] - 1
        lines.append(np.stack([np.repeat(every, width), _ranges(1 - item_words[every], width)], axis=1))
        pair, diagonal = np.unique(np.concatenate(lines), axis=0).T
        along = _Lines(pair, bounds[doc[pair]], doc_words[pair], self.begin[item[pair]], item_words[pair], diagonal)
        for p, *found in _best(words, self.words, along, allowed, least).tolist():
            yield int(doc[p]), int(item[p]), *found


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] numbers), begin[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def find_leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 12, substitutions: int = 2, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Overlaps of documents and test items, the best one per (row of docs, item): doc_id, item_id, exact_words, similar_words
    (longest span with at most ``substitutions`` words exchanged), substitutions (in that span), doc_word, item_word
    (where it begins). exact_words is the longest run of equal words in line with any similar span of ``min_words``, so
    every run of ``min_words`` or more. Exactly the pairs with a similar span of ``min_words`` or more come out, wherever
    its exchanged words stand.

    All documents and whole texts are read. The seeds of the items are sent to all tasks if they number at most
    ``broadcast_seeds`` and their texts take at most BROADCAST_BYTES; then no document is shuffled at all. Larger test
    sets are joined by seed hash in a shuffle: a sieve of the test seeds (32 MB at most) leaves out nearly all seeds of the
    corpus before that, and only documents with a hit are written and shuffled for the comparison, each text once.

    Defined cases: null and empty texts, and texts of fewer than ``min_words`` words, overlap with nothing; a repeated
    document row gives repeated results, repeated items are compared once per item_id and text; null ids come out as
    null; empty tables give no rows; further columns are ignored.
    """
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    if substitutions < 0:
        raise ValueError("substitutions can't be negative")
    d, t = pick(docs, k=doc_id, t=doc_text), pick(items, i=item_id, t=item_text).filter("t IS NOT NULL").distinct()
    kind = {"k": d.schema["k"].dataType.simpleString(), "i": t.schema["i"].dataType.simpleString()}
    schema = _OUT.format(**kind)
    size = t.agg(F.sum(F.octet_length("t")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    bound = (size["bytes"] or 0) // 2 * len(masks(min_words, substitutions))  # a word and what separates it take two bytes at least
    windows = _Windows(min_words, Canonical(), substitutions)
    if bound <= broadcast_seeds and (size["bytes"] or 0) <= BROADCAST_BYTES:
        rows = t.collect()
        return _leaks_by_broadcast(d, [r["i"] for r in rows], [r["t"] for r in rows], windows, substitutions, schema)
    return _leaks_by_shuffle(d, t, windows, substitutions, schema)


def _leaks_by_broadcast(d: DataFrame, ids: list, texts: list[str], windows: _Windows, allowed: int, schema: str) -> DataFrame:
    tests = _Tests(texts, windows)
    windows.hasher = None
    shared = d.sparkSession.sparkContext.broadcast((tests, ids))
    kinds = [pa.field(f.name, f.type) for f in _arrow_schema(d.sparkSession, schema)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, ids = shared.value
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for first, group in tests.windows.groups(texts):
                for doc, item, *found in tests.overlaps(group, allowed, tests.windows.span):
                    for column, v in zip(out, (keys[first + doc].as_py(), ids[item], *found)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, kinds)], schema=pa.schema(kinds))

    return d.mapInArrow(scan, schema)


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


#: As a mask number: the hash is that of two neighbouring words.
_PAIRS = -1


def _leaks_by_shuffle(d: DataFrame, t: DataFrame, windows: _Windows, allowed: int, schema: str) -> DataFrame:
    """The same for test sets of any size. Texts go by a 128-bit hash, so that copies of a text are compared once."""
    context, span = d.sparkSession.sparkContext, windows.span
    hashed = "m int, h long, r binary"
    docs = d.filter("t IS NOT NULL").select("k", F.unhex(F.md5("t")).alias("r"), "t")
    tests = t.select("i", F.unhex(F.md5("t")).alias("ir"), "t")

    def seed_rows(m: int, h: np.ndarray, r: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), m, np.int32)), pa.array(h.view(np.int64)), r], names=["m", "h", "r"])

    def test_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, group in windows.groups(b.column(1).to_pylist()):
                words, of = windows.words(group)
                pairs = np.unique(word_pairs(words))
                yield seed_rows(_PAIRS, pairs, pa.nulls(len(pairs), pa.binary()))
                for m, h, of, _ in windows.seeds(words, of, len(group)):
                    yield seed_rows(m, h, b.column(0).take(pa.array(of + first)))

    seeds = materialize(tests.select("ir", "t").distinct().mapInArrow(test_seeds, hashed).distinct(), "leak-seeds")
    own = seeds.filter(F.col("m") != _PAIRS).select("m", "h", F.col("r").alias("ir"))
    sieves = context.broadcast((_Sieve.collect(seeds.filter(F.col("m") == _PAIRS).select("h"), "h"), _Sieve.collect(own.select("h").distinct(), "h")))

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, sieve = sieves.value
        for b in batches:
            for first, group in windows.groups(b.column(1).to_pylist()):
                for m, h, of, _ in windows(group, pairs):
                    near = np.flatnonzero(sieve(h))
                    by = near[np.lexsort((of[near], h[near]))]
                    once = by[np.concatenate([[True], (h[by][1:] != h[by][:-1]) | (of[by][1:] != of[by][:-1])])] if len(by) else by
                    yield seed_rows(m, h[once], b.column(0).take(pa.array(of[once] + first)))

    hits = docs.select("r", "t").mapInArrow(doc_seeds, hashed).join(own, ["m", "h"]).select("r", "ir").distinct()
    hits = materialize(hits, "leak-hits")
    sieve = context.broadcast(_Sieve.collect(hits.select(F.xxhash64("r").alias("x")).distinct(), "x"))

    @F.pandas_udf("boolean")
    def may_hit(x: pd.Series) -> pd.Series:
        return pd.Series(sieve.value(x.to_numpy().view(np.uint64)))

    near = materialize(docs.filter(may_hit(F.xxhash64("r"))), "leak-docs")
    # per text: first itself, then the items it has hits with
    one = near.join(hits.select("r").distinct(), "r", "left_semi").groupBy("r").agg(F.first("t").alias("t")).select("r", F.lit(None).cast("binary").alias("ir"), "t")
    other = hits.join(tests.select("ir", "t").distinct(), "ir").select("r", "ir", "t")
    both = one.unionByName(other).repartition(shuffle_width(d.sparkSession), "r").sortWithinPartitions("r", F.asc_nulls_first("ir"))
    numbers = "exact_words int, similar_words int, substitutions int, doc_word int, item_word int"

    columns = ["r", "ir", *(c.split()[0] for c in numbers.split(", "))]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, held = [], [], []  # the present text, and items to be compared with it

        def compared() -> pa.RecordBatch:
            out: list[list] = [[] for _ in columns]
            for _, item, *found in _Tests(held, windows).overlaps(group, allowed, span):
                for column, v in zip(out, (*keys[item], *found)):
                    column.append(v)
            keys.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if c in ("r", "ir") else pa.int32()) for x, c in zip(out, columns)], names=columns)

        chars = 0
        for b in batches:
            for r, ir, text in zip(*(c.to_pylist() for c in b.columns)):
                if held and (ir is None or chars > GROUP_CHARS):
                    yield compared()
                    chars = 0
                if ir is None:
                    group = [windows.form(text).lower()]
                else:
                    keys.append((r, ir)), held.append(text)
                    chars += len(text)
        if held:
            yield compared()

    found = both.mapInArrow(verify, f"r binary, ir binary, {numbers}")
    named = found.join(near.select("k", "r"), "r").join(tests.select("i", "ir"), "ir")
    return named.select(F.col("k").alias("doc_id"), F.col("i").alias("item_id"), *columns[2:])
