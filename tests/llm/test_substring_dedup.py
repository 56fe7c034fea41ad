import random

import pytest
from pyspark.sql import functions as F

from tabwright.llm import substring_dedup as sd

from tests.llm import samples


def brute(rows, window):
    """(id, words, removed, kept) of each row, by the definition."""
    first, docs = {}, []
    for i, t in rows:
        w = (t or "").encode().split()
        docs.append((i, w))
        for a in range(len(w) - window + 1):
            key, place = tuple(w[a : a + window]), (sd.LAST_ID if i is None else i, a)
            first[key] = min(place, first.get(key, place))
    out = []
    for i, w in docs:
        gone = {p for a in range(len(w) - window + 1) if first[tuple(w[a : a + window])] < (sd.LAST_ID if i is None else i, a) for p in range(a, a + window)}
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "vocabulary", "seed"), [(4, 3, 1), (6, 2, 2), (20, 1, 3), (2, 6, 4)])
def test_small_vocabularies(spark, window, vocabulary, seed):
    rng = random.Random(seed)
    rows = [(k, " ".join(samples.words(rng, rng.randrange(45), vocabulary))) for k in rng.sample(range(1000), 60)]
    got = sd.dedup(samples.corpus(spark, rows).repartition(4), window=window).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, window)


def test_passages_copies_and_edges(spark):
    rng = random.Random(9)
    passages = [samples.words(rng, n) for n in (19, 20, 21, 35, 60, 200)]
    rows = []
    for k in range(80):
        text = samples.words(rng, rng.randrange(80))
        for p in rng.sample(passages, rng.randrange(4)):
            a, cut = rng.randrange(len(text) + 1), rng.randrange(6)
            text[a:a] = p[cut : len(p) - rng.randrange(6)]
        rows.append((rng.randrange(10**6), " \n".join(text)))
    rows += [(5, rows[3][1]), (10**7, rows[3][1]), (10**7 + 1, rows[4][1])]
    got = sd.dedup(samples.corpus(spark, rows).repartition(6)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 20)


def test_odd_rows_and_empty_tables(spark):
    rows = [(r[0], r[1]) for r in samples.odd_rows()]
    assert sorted(map(tuple, sd.dedup(samples.odd(spark)).collect()), key=str) == brute(rows, 20)
    assert sd.dedup(samples.empty(spark)).count() == 0


def test_texts_that_share_an_id_are_told_apart(spark):
    rng = random.Random(5)
    a, b = samples.words(rng, 60), samples.words(rng, 60)
    rows = [(1, " ".join(a)), (2, " ".join(b)), (2, " ".join(b[:5] + a[10:50]))]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in sd.dedup(samples.corpus(spark, rows)).collect())
    assert got == [(1, 60, 0), (2, 45, 40), (2, 60, 0)]


def test_a_window_hash_is_that_of_its_words():
    words = [f"{k % 7}".encode() for k in range(50)]
    for size in (1, 2, 3, 5, 10, 20):
        h = sd.hashes(words, size)
        assert len(h) == 51 - size
        assert all((h[i] == h[j]) == (words[i : i + size] == words[j : j + size]) for i in range(len(h)) for j in range(len(h)))


def test_odd_windows_are_refused(spark):
    with pytest.raises(ValueError, match="even"):
        sd.dedup(samples.empty(spark), window=5)


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_without_an_id_and_shared_ids(spark, seed):
    """Runs of texts that share an id, or have none, tie at their places, and other documents hold parts of the same runs."""
    rng = random.Random(seed)
    passages = [samples.words(rng, n) for n in (9, 12, 30)]
    rows = []
    for _ in range(150):
        head = rng.choice(passages)
        cut = rng.randrange(3)
        text = head[cut:] + samples.words(rng, rng.randrange(12)) + rng.choice(passages)[: rng.randrange(4, 30)]
        rows.append((rng.choice([None, None, 1, 2, 3, rng.randrange(100)]), " ".join(text)))
    rows += rows[:30]
    got = sd.dedup(samples.corpus(spark, rows).repartition(5), window=6).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 6)


def test_equal_32_bit_hashes_are_no_mix_up(spark):
    """Many texts without an id: the old key of 32 bits met twice among them, as texts of unequal length show."""
    rows = [(None, " ".join(f"{k}x{j}" for j in range(8 + k % 5))) for k in range(100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert df.groupBy(F.hash("text")).count().filter("count > 1").count() > 0
    assert sd.dedup(df, window=4).agg(F.sum("n_removed")).first()[0] == 0
