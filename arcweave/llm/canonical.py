"""One form for texts that look the same: canonical text by quick check, local repair and splicing.

Nearly all of a text is stable: no character of it changes under normalization, and none can join with the one
before it. ``Canonical`` finds the runs of unstable characters, widens each by the one stable character before it
(a combining mark composes with that), normalizes these segments only, and splices them into the unchanged rest.

The form: NFC, and beyond that
* full-width letters, digits, punctuation and space become the ordinary ones,
* characters that show nothing and take no room are removed, soft hyphens included,
* any space character becomes U+0020 (line breaks and tabs stay), any hyphen character U+002D (dashes stay),
* letters joined in one character are taken apart,
* letters that look like a Latin letter but belong to another script become that Latin letter.
Accents, raised digits, letter case, punctuation and different letters of one script are kept apart.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.common import materialize, pick, release

# Hyphen characters other than U+002D (hyphen, non-breaking, Armenian, Todo soft, small, full-width).
HYPHENS = "‐‑֊᠆﹣－"

# Marks that show nothing, beyond the format characters (grapheme joiner, Khmer inherent vowels,
# Mongolian free variation selectors, variation selectors).
SILENT_MARKS = [(0x034F, 0x034F), (0x17B4, 0x17B5), (0x180B, 0x180D), (0x180F, 0x180F), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF)]

# Format characters that are visible (signs that enclose numbers or annotate).
VISIBLE_FORMAT = [(0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0xFFF9, 0xFFFB), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F)]

# Letters of other scripts and the Latin letters they look like, as in confusables.txt of Unicode Technical
# Standard #39 where that names one ASCII letter. Of the alternatives I, l and i the one that the letter is drawn like is
# taken, and letters that are alike in some typefaces only (such as gamma and y, sigma and o, ghe and r) are left out.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "Х": "X", "Ү": "Y", "Ѵ": "V", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "а": "a", "е": "e", "о": "o", "р": "p",
    "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ѵ": "v", "ү": "y", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϝ": "F", "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "Ϲ": "C", "ϳ": "j",
    "Ϳ": "J",
    # Armenian
    "Լ": "L", "Ս": "U", "Տ": "S", "Օ": "O", "օ": "o", "հ": "h", "յ": "j", "ո": "n", "ս": "u", "ց": "g", "զ": "q",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P",
    "Ꭱ": "R", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Coptic
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    "Ⲍ": "Z", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N",
    "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O",
    "ꓴ": "U",
}


def _within(cp: int, ranges: list[tuple[int, int]]) -> bool:
    return any(a <= cp <= b for a, b in ranges)


@lru_cache(maxsize=1)
def fold_table() -> dict[int, str]:
    """Code point -> replacement, for the foldings beyond NFC; made by rule from the character database."""
    table: dict[int, str] = {ord(c): to for c, to in LOOK_ALIKES.items()} | {ord(c): "-" for c in HYPHENS}
    for cp in range(128, sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cn" or cp in table:
            continue
        made = unicodedata.decomposition(ch)
        if kind == "Zs" and cp != 0x1680:  # the Ogham space mark is a visible stroke
            table[cp] = " "
        elif (kind == "Cf" and not _within(cp, VISIBLE_FORMAT)) or _within(cp, SILENT_MARKS):
            table[cp] = ""
        elif made.startswith("<wide>"):
            table[cp] = chr(int(made.split()[1], 16))
        elif made.startswith("<compat>") and kind[0] == "L":
            parts = [chr(int(x, 16)) for x in made.split()[1:]]
            if len(parts) > 1 and all(unicodedata.category(p)[0] == "L" for p in parts):
                table[cp] = "".join(parts)
    return table


def _repair(segment: str, table: dict[int, str]) -> str:
    """The full normalization, for short segments. Folding comes between taking apart and composing, so that accents
    on look-alikes compose, and twice, as a fold can give a character that folds again."""
    apart = unicodedata.normalize("NFD", segment).translate(table)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", apart).translate(table))


@lru_cache(maxsize=1)
def unstable_pattern() -> str:
    """A character class: all that changes alone, or can act on the character before it. Everything beyond the basic
    plane counts as unstable; it is rare, and its repair is right anyway."""
    table = fold_table()
    members = set(table)
    for cp in range(128, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch) or _repair(ch, table) != ch:
            members.add(cp)
        made = unicodedata.decomposition(ch)
        if made and made[0] != "<" and len(second := made.split()) == 2:
            members.add(int(second[1], 16))
    members |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # jamo that join the syllable before them
    ranges, begin = [], None
    for cp in sorted(x for x in members if x < 0x10000):
        if begin is None:
            begin = last = cp
        elif cp == last + 1:
            last = cp
        else:
            ranges.append((begin, last))
            begin = last = cp
    ranges.append((begin, last))
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "\\U00010000-\\U0010ffff]+"


class Canonical:
    """Brings texts to canonical form. Made on the driver and shipped to tasks: the tables are built once."""

    def __init__(self):
        self.pattern, self.table = unstable_pattern(), fold_table()
        self._find = None

    def __getstate__(self):
        return {"pattern": self.pattern, "table": self.table, "_find": None}

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        if self._find is None:
            self._find = re.compile(self.pattern)
        pieces, done = [], 0
        for run in self._find.finditer(text):
            begin = max(run.start() - 1, done)
            pieces.append(text[done:begin])
            pieces.append(_repair(text[begin : run.end()], self.table))
            done = run.end()
        if not done:
            return text
        pieces.append(text[done:])
        return "".join(pieces)


def canonical_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) with every text in canonical form; a null text stays null, other columns are left out."""
    form = Canonical()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if t is None else form(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["k", "t"])

    src = pick(df, k=key, t=text)
    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, t string").toDF(key, text)


def look_hashes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, look, form) of every row: its key and 128-bit hashes of the canonical and the stored text, null for a null text.

    Texts look the same exactly if ``look`` is equal (up to hash collisions of probability about n^2 / 2^129); no text
    is shuffled, only the hashes are.
    """
    form = Canonical()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            looks, forms = [], []
            for t in b.column(1).to_pylist():
                if t is None:
                    looks.append(None), forms.append(None)
                    continue
                stored = hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                c = form(t)
                looks.append(stored if c is t else hashlib.blake2b(c.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                forms.append(stored)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(looks, pa.binary()), pa.array(forms, pa.binary())], names=["k", "look", "form"])

    src = pick(df, k=key, t=text)
    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, look binary, form binary")


def class_members(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row of ``df`` with a text: (key, class_id, class_rows, class_forms).

    class_id is the smallest key of the texts that look the same; rows and stored forms of the class are counted.
    """
    looks = materialize(look_hashes(df, key, text).filter(F.col("look").isNotNull()), "looks")
    per_form = looks.groupBy("look", "form").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"))
    classes = per_form.groupBy("look").agg(F.min("k").alias("class_id"), F.sum("n").alias("class_rows"), F.count(F.lit(1)).alias("class_forms"))
    return looks.join(classes, "look").select("k", "class_id", "class_rows", "class_forms").toDF(key, "class_id", "class_rows", "class_forms")


def same_look_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """All pairs of rows whose texts differ as stored but look the same: (<key>_a, <key>_b), a < b, distinct.

    First the different stored forms of a class are paired, then each pair of forms is filled with the rows that have
    them. So every row that the joins make is a pair of the result (but for equal keys): exact copies never meet each
    other, and n copies beside one variant cost n, not n^2. The number of rows is that of the result asked for.

    Defined cases: null texts are in no pair; empty texts are equal as stored; equal keys are in no pair.
    """
    looks = materialize(look_hashes(df, key, text).filter(F.col("look").isNotNull()), "looks")
    several = looks.groupBy("look").agg(F.min("form").alias("low"), F.max("form").alias("high")).filter("low <> high").select("look")
    members = materialize(looks.join(several, "look", "left_semi").distinct(), "members")
    release(looks)
    forms = members.select("look", "form").distinct()
    low, high = (forms.select("look", F.col("form").alias(n)) for n in ("low", "high"))
    met = low.join(high, "look").filter("low < high")
    for n, m in (("low", "a"), ("high", "b")):
        met = met.join(members.select("look", F.col("form").alias(n), F.col("k").alias(m)), ["look", n])
    pairs = met.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.toDF(f"{key}_a", f"{key}_b")
