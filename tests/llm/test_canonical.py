import random
import unicodedata

import pytest

from arcweave.llm.canonical import Canonical, canonical_text, class_members, fold_table, same_look_pairs, _repair

FORM = Canonical()

SAME = [
    ("ＡＢＣ　１２，（x）", "ABC 12,(x)"),
    ("été", "été"),
    ("a​́b", "áb"),
    ("ac­count ﻿x⁠y‍‌", "account xy"),
    ("a b c d　e", "a b c d e"),
    ("well‐known‑x－", "well-known-x-"),
    ("oﬃce ﬁrst ﬂag ﬀ Ǆ ĳ", "office first flag ff DŽ ij"),
    ("Τhе сοurt", "The court"),
    ("ё", "ë"),
    ("ё", "ë"),
    ("Å", "Å"),
    ("한", "한"),
    ("a️b", "ab"),
]
OTHER = [("a–b", "a-b"), ("a—b", "a-b"), ("m²", "m2"), ("é", "e"), ("A", "a"), ("l", "I"), ("ı", "i"), ("…", "..."), ("½", "1/2"), ("æ", "ae"), ("a\nb", "a b"), ("a\tb", "a b"), ("a−b", "a-b"), ("д", "d"), ("ß", "ss"), ("𝐀", "A")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert FORM(a) == FORM(b) == b


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert FORM(a) != FORM(b)


def test_splicing_equals_whole_normalization():
    """Repairing only unstable segments gives what normalizing the whole text gives, for any mixture of characters."""
    table = fold_table()
    rng = random.Random(1)
    pool = [chr(c) for c in [*table][:400]] + [chr(c) for c in range(0x20, 0x250)] + [chr(c) for c in range(0x300, 0x345)] + list("абвоеёйїΑΒάόνю한각가각กำൊൊ\U0001d15e\U0001f600\U000e0101")
    for _ in range(4000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        assert FORM(t) == _repair(t, table), [hex(ord(c)) for c in t]
        assert unicodedata.is_normalized("NFC", FORM(t))
        assert FORM(FORM(t)) == FORM(t), [hex(ord(c)) for c in t]


def test_every_character_alone_and_after_a_letter():
    table = fold_table()
    for cp in range(1, 0x30000):
        if not 0xD800 <= cp <= 0xDFFF:
            for t in (chr(cp), "e" + chr(cp)):
                assert FORM(t) == _repair(t, table), hex(cp)


DOCS = [(1, "the case"), (2, "the case"), (3, "thе case"), (4, "the case"), (5, "The case"), (6, None), (7, ""), (8, ""), (9, "​"), (10, None), (2, "the case"), (11, "x" * 300_000 + "é"), (12, "x" * 300_000 + "é")]


def test_pairs(spark, rows):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert rows(same_look_pairs(df, "doc_id", "text")) == sorted([(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (7, 9), (8, 9), (11, 12)], key=str)


def test_copies_are_not_paired_with_each_other(spark):
    """Joins of n copies and a variant make n rows, not n^2."""
    from pyspark.sql import functions as F

    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 17, "thе case").otherwise("the case").alias("text"))
    pairs = same_look_pairs(df, "doc_id", "text")
    assert pairs.count() == 39_999 and pairs.filter("doc_id_a = 17 OR doc_id_b = 17").count() == 39_999
    made = []

    def walk(node):
        name = node.nodeName()
        if name.endswith("Join"):
            made.append(node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    pairs.collect()
    walk(pairs._jdf.queryExecution().executedPlan())
    assert len(made) >= 3 and max(made) == 39_999


def test_sql_twin_knows_the_same_letters(spark):
    """The SQL has lists of its own; both must give one form to every character that either of them changes."""
    duckdb = pytest.importorskip("duckdb")
    from arcweave.llm.canonical import LOOK_ALIKES, fold_table
    from arcweave.llm.queries import SQL_LETTERS, _sql_text

    chars = {chr(c) for c in fold_table() if c < 0x3000 or c > 0xFE00} | set("".join(SQL_LETTERS)) | set(LOOK_ALIKES) | {a for a, _ in SAME} | {a for a, _ in OTHER}
    skipped = {chr(c) for c, to in fold_table().items() if len(to) > 1} - set("ﬀﬁﬂﬃﬄﬅﬆĳĲǄǅǆǇǈǉǊǋǌǱǲǳ")  # rare joined letters
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(c,) for c in sorted(chars - skipped)])
    wrong = [(hex(ord(x[0])), x, got, FORM(x)) for x, got in con.execute(f"SELECT x, {_sql_text('x')} FROM t").fetchall() if got != FORM(x)]
    assert [w for w in wrong if not "\U0001bca0" <= w[1][0] <= "\U0001d17a"] == []  # shorthand and music format characters


@pytest.mark.parametrize("letters", ["ρνιαυ", "ՍՏԼ", "ⲟⲣⲥ", "ꓮꓰ", "ѵԌ"])
def test_look_alikes_of_every_script(letters):
    assert FORM(letters).isascii()


def test_classes(spark, rows):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = rows(class_members(df, "doc_id", "text"))
    assert (4, 1, 5, 3) in got and got.count((2, 1, 5, 3)) == 2 and (5, 5, 1, 1) in got and (9, 7, 3, 2) in got and len(got) == 11


def test_text_column_empty_and_clashing(spark, rows):
    df = spark.createDataFrame([(1, "ﬁ­", "x", "y"), (2, None, "x", "y")], "look long, form string, k string, t string")
    assert rows(canonical_text(df, "look", "form")) == [(1, "fi"), (2, None)]
    assert rows(same_look_pairs(df, "look", "form")) == []
    assert rows(class_members(df.filter("false"), "look", "form")) == []
