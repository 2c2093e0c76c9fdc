import random
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcweave.llm.canonical import Canonical
from arcweave.llm import leaks
from arcweave.llm.leaks import _Hasher, _Sieve, _Windows, compare, find_leaks, masks, words_of

FORM = Canonical()


def longest_run(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def corpus(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "m²", "x1", "строка", "數"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(100 + i, text(rng.choice([5, 12, 13, 30]))) for i in range(12)]
    docs = []
    for d in range(80):
        words = text(rng.randint(0, 60))
        if d % 2:
            src = rng.choice(items)[1]
            n = rng.choice([10, 11, 12, 13, 20])
            at = rng.randint(0, max(0, len(src) - n))
            part = [w for w in src[at : at + n]]
            if d % 3 == 0 and len(part) > 6:
                part[5] = "changed"
            words[rng.randint(0, len(words)) : 0] = part
        docs.append((d, rng.choice([" ", ", ", "\n", " - "]).join(words)))
    return docs, [(i, "; ".join(w).upper()) for i, w in items]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_every_exact_overlap(spark, limit):
    docs, items = corpus()
    d, t = spark.createDataFrame(docs, "id long, body string").repartition(3), spark.createDataFrame(items, "item long, body string")
    got = {(r.doc_id, r.item_id): r.exact_words for r in find_leaks(d, "id", "body", t, "item", "body", 12, broadcast_seeds=limit).collect()}
    want = {}
    for i, text in docs:
        for j, item in items:
            n = longest_run(words_of(text, FORM), words_of(item, FORM))
            if n >= 12:
                want[i, j] = n
    assert want and {k: n for k, n in got.items() if n >= 12} == want


def test_both_ways_agree(spark, rows):
    docs, items = corpus(4)
    d, t = spark.createDataFrame(docs, "id long, body string"), spark.createDataFrame(items, "item long, body string")
    a, b = (rows(find_leaks(d, "id", "body", t, "item", "body", 8, 2, n)) for n in (10**6, 0))
    assert a == b and a


def test_substitutions():
    item = [f"w{i}" for i in range(20)]
    doc = ["a", "b", *item]
    doc[8] = "other"
    assert compare(doc, item, {2}, 2) == (13, 20, 1, 2, 0)
    assert compare(doc, item, {2}, 0) == (13, 13, 0, 9, 7)
    assert compare(doc, item, {0}, 2)[0] == 0
    assert compare([], item, {0}, 2) == (0, 0, 0, 0, 0)


def test_substituted_passage_is_found(spark):
    item = " ".join(f"word{i}" for i in range(30))
    words = item.split()
    words[9], words[20] = "x", "y"
    d = spark.createDataFrame([(1, "intro " + " ".join(words) + " end")], "id long, t string")
    r = find_leaks(d, "id", "t", spark.createDataFrame([(5, item)], "i long, t string"), "i", "t").first()
    assert (r.exact_words, r.similar_words, r.substitutions, r.doc_word, r.item_word) == (10, 30, 2, 1, 0)


def test_masks():
    for n in (1, 3, 4, 12, 13):
        assert all(m and 0 <= min(m) and max(m) < n for m in masks(n))


@pytest.mark.parametrize("substitutions", [0, 1, 2, 3])
def test_masks_cover_every_placement(substitutions):
    for n in range(1, 18):
        for length in (n, n + 1, n + 5):
            for wrong in combinations(range(1, length - 1), min(substitutions, max(0, length - 2))):
                assert any(not any(at + p in wrong for p in m) for m in masks(n, substitutions) for at in range(length - n + 1)), (n, length, wrong)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_every_placement_of_exchanged_words(spark, limit):
    docs, items, want = [], [], set()
    for n in (12, 13, 16):
        for wrong in [*((p,) for p in range(1, n - 1)), *combinations(range(1, n - 1), 2)]:
            k = len(docs)
            item = [f"k{k}p{p}" for p in range(n)]
            docs.append((k, "before " + " ".join("other" if p in wrong else w for p, w in enumerate(item)) + " after"))
            items.append((k, " ".join(item)))
            want.add((k, k, n, len(wrong)))
    d, t = spark.createDataFrame(docs, "id long, t string").repartition(2), spark.createDataFrame(items, "i long, t string")
    found = find_leaks(d, "id", "t", t, "i", "t", 12, 2, broadcast_seeds=limit)
    assert {(r.doc_id, r.item_id, r.similar_words, r.substitutions) for r in found.collect() if r.similar_words >= 12} == want


@pytest.mark.parametrize(("min_words", "substitutions"), [(3, 2), (5, 1), (8, 2), (8, 3), (12, 2)])
def test_every_similar_overlap(spark, min_words, substitutions):
    docs, items = corpus(6)
    d, t = spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(items, "i long, t string")
    got = {(r.doc_id, r.item_id): (r.similar_words, r.substitutions, r.doc_word, r.item_word) for r in find_leaks(d, "id", "t", t, "i", "t", min_words, substitutions).collect()}
    want = {}
    for i, text in docs:
        for j, item in items:
            a, b = words_of(text, FORM), words_of(item, FORM)
            best = compare(a, b, set(range(-len(b) + 1, len(a))), substitutions)[1:]
            if best[0] >= min_words:
                want[i, j] = best
    assert want and {k: v for k, v in got.items() if v[0] >= min_words} == want


def test_hashes_follow_words():
    texts = ["ab cd", "", "cd_ab", "日本 ab\U00010400x", "½ ²x"]
    hashes, of = _Hasher()(texts)
    words = [w for t in texts for w in __import__("re").findall(r"[^\W_]+", t)]
    assert len(hashes) == len(words)
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    assert of.tolist() == [i for i, t in enumerate(texts) for _ in __import__("re").findall(r"[^\W_]+", t)]


def test_slices_do_not_change_hashes(monkeypatch):
    texts = ["ab cd" * 9, "", "x" * 40, "é日本 z\U00010400y " * 7]
    want = [x.tolist() for x in _Hasher()(texts)]
    for n in (1, 2, 7, 33):
        monkeypatch.setattr("arcweave.llm.leaks.GROUP_CHARS", n)
        assert [x.tolist() for x in _Hasher()(texts)] == want


def test_windows_stay_inside_texts():
    w = _Windows(3, FORM)
    found = [(m, int(t), int(p)) for m, _, of, at in w(["a b", "c d e f", "g h i"]) for t, p in zip(of, at)]
    assert found == [(0, 1, 0), (0, 1, 1), (0, 2, 0)]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_odd_inputs(spark, rows, limit):
    schema_d, schema_i = "id long, t string, doc_id long, k long", "i long, t string, item_id long, h long"
    passage = " ".join(f"p{i}" for i in range(15))
    docs = [(1, None, 0, 0), (2, "", 0, 0), (3, "short text", 0, 0), (4, passage, 0, 0), (4, passage, 0, 0), (5, "z " * 100_000 + passage, 0, 0), (None, passage.upper(), 0, 0)]
    items = [(7, passage, 0, 0), (7, passage, 1, 1), (8, None, 0, 0), (9, "", 0, 0), (10, "p1 p2", 0, 0)]
    d, t = spark.createDataFrame(docs, schema_d), spark.createDataFrame(items, schema_i)
    got = [(r.doc_id, r.item_id, r.exact_words) for r in find_leaks(d, "id", "t", t, "i", "t", broadcast_seeds=limit).collect()]
    assert sorted(got, key=str) == sorted([(4, 7, 15), (4, 7, 15), (5, 7, 15), (None, 7, 15)], key=str)
    assert find_leaks(d, "id", "t", t.filter("false"), "i", "t", broadcast_seeds=limit).count() == 0
    assert find_leaks(d.filter("false"), "id", "t", t, "i", "t", broadcast_seeds=limit).count() == 0
    with pytest.raises(ValueError):
        find_leaks(d, "id", "t", t, "i", "t", 0)


def plain_compare(doc, item, allowed, least):
    """All diagonals, span by span."""
    best, exact = (0, 0, 0, 0), 0
    for d in range(1 - len(item), len(doc)):
        equal = [0 <= d + i < len(doc) and doc[d + i] == item[i] for i in range(len(item))]
        spans = [(j + 1 - i, -sum(not e for e in equal[i : j + 1]), -(d + i), -i) for i in range(len(item)) if equal[i] for j in range(i, len(item)) if equal[j]]
        spans = [s for s in spans if -s[1] <= allowed]
        if spans and max(spans)[0] >= least:
            best = max(best, max(spans))
            exact = max(exact, max(s[0] for s in spans if not s[1]))
    return exact, best[0], *(-x for x in best[1:])


def test_comparison_against_a_plain_one(monkeypatch):
    rng = random.Random(9)
    for cells in (1, 50, 1 << 22):
        monkeypatch.setattr(leaks, "CELLS", cells)
        for _ in range(150):
            doc, item = ([rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(2))
            allowed, least = rng.randint(0, 3), rng.randint(0, 6)
            diagonals = set(range(1 - len(item), len(doc)))
            assert compare(doc, item, diagonals, allowed, least) == plain_compare(doc, item, allowed, least), (doc, item)


@pytest.mark.parametrize("length", [12, 14, 18, 24])
@pytest.mark.parametrize("limit", [10**6, 0])
def test_recall_of_exchanged_words(spark, length, limit):
    """Every placement of up to two exchanged words inside a passage, found or not."""
    wanted = [w for n in (0, 1, 2) for w in combinations(range(1, length - 1), n)]
    items = [(k, " ".join(f"k{k}p{p}" for p in range(length))) for k in range(len(wanted))]
    docs = [(k, "before " + " ".join("other" if p in w else f"k{k}p{p}" for p in range(length)) + " after") for k, w in enumerate(wanted)]
    d, t = spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(items, "i long, t string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(d, "id", "t", t, "i", "t", broadcast_seeds=limit).collect()}
    assert found == {(k, k) for k in range(len(wanted))}


@pytest.mark.parametrize("words", ["la", "la lo", "la lo li"])
def test_repetitive_text(words):
    windows = _Windows(12, FORM)
    tests = leaks._Tests([" ".join([words] * (100 // len(words.split())))], windows)
    doc = " ".join([words] * (32_000 // len(words.split())))
    tests.windows.words([doc])  # tables that are made once
    began = time.process_time()
    found = list(tests.overlaps([doc], 2, 12))
    assert time.process_time() - began < 2
    n = len(words.split()) * (100 // len(words.split()))
    assert found == [(0, 0, n, n, 0, 0, 0)]


def test_sieve(spark):
    rng = np.random.default_rng(1)
    inside, other = (rng.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    made = _Sieve.of(inside)
    assert made(inside).all() and made(other).mean() < 0.02
    df = spark.createDataFrame([(int(x),) for x in inside.view(np.int64)], "x long")
    assert (_Sieve.collect(df, "x").bits == made.bits).all()
    assert not _Sieve.collect(df.filter("false"), "x")(inside).any() and not _Sieve.of(inside[:0])(inside).any()
    assert _Sieve.size(10**12) == 1 << leaks.SIEVE_BITS[1]


def test_only_seeds_and_texts_with_a_hit_are_shuffled(spark, monkeypatch):
    """Beyond the broadcast bound: 3,000 texts, of which 3 hold the passage, two of these as copies."""
    passage = " ".join(f"p{i}" for i in range(20))
    d = spark.range(3000).select("id", F.when(F.col("id").isin(5, 6), passage).when(F.col("id") == 7, F.concat(F.lit("more "), F.lit(passage))).otherwise(F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), "id") for i in range(40)])).alias("t"))
    t = spark.createDataFrame([(1, passage)], "i long, t string")
    kept, tables = leaks.materialize, {}

    def materialize(df, label):
        tables[label] = kept(df, label)
        return tables[label]

    monkeypatch.setattr(leaks, "materialize", materialize)
    assert sorted(r.doc_id for r in find_leaks(d, "id", "t", t, "i", "t", broadcast_seeds=0).collect()) == [5, 6, 7]
    assert sorted(r.k for r in tables["leak-docs"].collect()) == [5, 6, 7] and tables["leak-hits"].count() == 2
    plan = tables["leak-docs"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    # the corpus side of the seed join: none of the other texts' windows
    windows = _Windows(12, FORM)
    pairs = leaks._Tests([passage], windows).pairs
    assert all(len(h) == 0 for _, h, _, _ in windows([" ".join(f"w{i}x9" for i in range(40))], pairs))
