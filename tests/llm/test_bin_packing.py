import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcweave.llm.bin_packing import Evolution, Packing, TokenCounter, best_fit, crossover, evolve, first_packing, pack_texts

COUNT = TokenCounter()
SMALL = Evolution(shard_items=60, population=4, generations=4)


def random_sizes(n, capacity, seed=0):
    return np.random.default_rng(seed).integers(0, capacity // 2, n)


def valid(p: Packing, sizes, capacity):
    assert len(p.bin_of) == len(sizes) and (p.bin_of >= 0).all()
    assert (np.bincount(p.bin_of, weights=sizes, minlength=len(p.loads)) == p.loads).all()
    assert (p.loads <= capacity).all() and set(p.bin_of.tolist()) == set(range(len(p.loads)))


def test_best_fit_against_plain_search():
    rng = random.Random(1)
    for _ in range(50):
        capacity = rng.randint(1, 60)
        sizes = [rng.randint(0, capacity) for _ in range(rng.randint(0, 40))]
        got = best_fit(list(range(len(sizes))), sizes, np.full(len(sizes), -1, np.int32), [], capacity)
        plain: list[int] = []
        for s in sizes:
            fits = [x for x in plain if x + s <= capacity]
            if fits:
                plain.remove(max(fits))
                plain.append(max(fits) + s)
            else:
                plain.append(s)
        assert sorted(got) == sorted(plain)


def test_crossover_keeps_every_item():
    for seed in range(20):
        rng, sizes = np.random.default_rng(seed), random_sizes(200, 100, seed)
        a, b = (first_packing(sizes, 100, rng, 0.5) for _ in range(2))
        child = crossover(a, b, sizes, 100, rng, 0.2)
        valid(a, sizes, 100), valid(b, sizes, 100), valid(child, sizes, 100)


def test_evolution_improves_on_its_start():
    better = 0
    for seed in range(8):
        sizes = np.random.default_rng(seed).integers(20, 51, 90)
        rng = np.random.default_rng(seed)
        start = first_packing(sizes, 100, rng, 0.0)
        best = evolve(sizes, 100, [start], rng, Evolution(population=8, generations=30))[0]
        valid(best, sizes, 100)
        assert best.rank(100) >= start.rank(100)
        better += best.rank(100) > start.rank(100)
    assert better >= 4


def test_least_number_of_bins_ends_early():
    sizes = np.array([50] * 40)
    assert len(evolve(sizes, 100, [], np.random.default_rng(0), Evolution())[0].loads) == 20


def test_long_texts_are_counted_whole(monkeypatch):
    rng = random.Random(4)
    parts = ["word", " ", "  ", "it's", "\n", " été", " 12", "²", "...", " a", " b", "\t", "x" * 30]
    texts = ["".join(rng.choice(parts) for _ in range(400)) for _ in range(40)]
    whole_counts = [COUNT(t) for t in texts]
    monkeypatch.setattr("arcweave.llm.bin_packing.LONG_TEXT", 50)
    assert [COUNT(t) for t in texts] == whole_counts


def run(spark, texts, capacity, how=SMALL, schema="doc_id long, text string"):
    df = spark.createDataFrame(texts, schema).repartition(3)
    return [tuple(r) for r in pack_texts(df, "doc_id", "text", capacity, how=how).collect()]


def whole(texts, capacity):
    """Pieces that fill a container, and the sizes of what is left to pack."""
    full, sizes = 0, []
    for _, text in texts:
        n = COUNT(text)
        pieces = max(0, -(-n // capacity) - 1)
        full += pieces
        sizes.append(n - pieces * capacity)
    return full, np.array(sizes)


@pytest.mark.parametrize("how", [SMALL, Evolution()])
def test_whole_texts(spark, how):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["the", "court", "held", "xyzzy"]) for _ in range(rng.randint(0, 90)))) for i in range(400)]
    texts += [(1000, None), (1001, ""), (None, "one two"), (7, texts[7][1]), (1002, "word " * 5000), (1003, "a"), (1003, "a")]
    got = run(spark, texts, 128, how)
    loads = defaultdict(int)
    for container, _, _, n in got:
        loads[container] += n
    assert max(loads.values()) <= 128
    want = Counter()
    for doc, text in texts:
        n = COUNT(text)
        want.update([(doc, s, min(128, n - s)) for s in range(0, max(n, 1), 128)])
    assert Counter((d, s, n) for _, d, s, n in got) == want
    full, sizes = whole(texts, 128)
    plain = full + len(first_packing(sizes, 128, np.random.default_rng(0), 0).loads)  # best fit, all items at once
    # three partitions are three shards at least; shards of 60 items have few choices
    assert len(loads) <= plain * (1.05 if how is SMALL else 1.01)


def test_exact_capacity_empty_and_one(spark):
    n = COUNT("word " * 64)
    assert run(spark, [(1, "word " * 64)], n) and len(run(spark, [(1, "word " * 64)], n)) == 1
    assert run(spark, [], 10) == []
    assert [r[1:] for r in run(spark, [(3, "")], 10)] == [(3, 0, 0)]
    with pytest.raises(ValueError):
        run(spark, [(1, "x")], 0)


def test_every_epoch_runs_in_many_tasks(spark, monkeypatch):
    """Also behind the join of the elites, whose partitions are put together where they are small."""
    from pathlib import Path

    from arcweave.llm import bin_packing

    written = {}
    kept = bin_packing.materialize

    def materialize(df, label):
        made = kept(df, label)
        written.setdefault(label, []).append(len([f for f in made.inputFiles() if Path(f.removeprefix("file://")).stat().st_size]))
        return made

    monkeypatch.setattr(bin_packing, "materialize", materialize)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = spark.range(480).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") * 37 % 50).cast("int")).alias("text")).repartition(8)
        pack_texts(df, "doc_id", "text", 128, how=Evolution(shard_items=60, islands=2, epochs=3)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [written[f"elites-{e}"][0] for e in range(3)] == [4, 4, 4]  # as many as the session's shuffle partitions


def test_the_vocabulary_is_read_on_the_driver_only(spark, tmp_path):
    import shutil

    from arcweave.llm.bin_packing import TOKENIZER

    at = tmp_path / "ranks.tiktoken"
    shutil.copy(TOKENIZER, at)
    packed = pack_texts(spark.createDataFrame([(1, "one two three")], "doc_id long, text string"), "doc_id", "text", 16, tokenizer=str(at), how=SMALL)
    at.unlink()
    assert packed.select("n_tokens").first()[0] == COUNT("one two three")


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 5, "k")], "doc_id long, text string, shard long, container_id string")
    assert pack_texts(df, "doc_id", "text", 16, how=SMALL).select("doc_id", "n_tokens").first()[:] == (1, 2)
    with pytest.raises(ValueError):
        pack_texts(df, "container_id", "text")
