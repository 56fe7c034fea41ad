import random

import pytest

from tabwright.llm import components, minhash

from tests.llm import samples


def sets_of(rows, size):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())))
    return out


def brute(rows, size=2, percent=80):
    """(id, shingles, component, kept) of each row, by all pairs."""
    docs = sets_of(rows, size)
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (_, s) in enumerate(docs):
        for b in range(a):
            t = docs[b][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                up[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        smallest[r] = min((x for x in (smallest.get(r), i) if x is not None), default=None)
    return sorted(((i, len(s), smallest[find(k)], i == smallest[find(k)]) for k, (i, s) in enumerate(docs)), key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def edited(rng, text, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text]


def corpus(rng, groups, copies):
    """Groups of copies with few to many edits, and chains of edits whose ends are far apart."""
    out = []
    for _ in range(groups):
        base = samples.words(rng, rng.randrange(3, 150))
        out += [edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05, 0.08, 0.12])) for _ in range(rng.randrange(1, copies))]
        step = base
        for _ in range(rng.randrange(4)):
            step = edited(rng, step, 0.04)
            out.append(step)
    return [(i, " ".join(w)) for i, w in zip(rng.sample(range(10**6), len(out)), out, strict=True)]


@pytest.mark.parametrize(("size", "percent", "hot", "block", "seed"), [(2, 80, 64, 512, 1), (2, 80, 2, 4, 2), (3, 60, 3, 5, 3), (5, 90, 64, 512, 4)])
def test_like_brute_force(spark, size, percent, hot, block, seed):
    docs = corpus(random.Random(seed), 25, 12)
    got = minhash.near_duplicates(samples.corpus(spark, docs).repartition(4), shingle=size, percent=percent, hot=hot, block=block)
    assert rows(got) == brute(docs, size, percent)


def test_a_crowd_without_a_middle(spark):
    """Every copy has edits of its own, so that most are linked through few; buckets are large and hold several components."""
    rng = random.Random(7)
    base = samples.words(rng, 120)
    docs = [(k, " ".join(edited(rng, base, rng.choice([0.02, 0.05, 0.1])))) for k in range(300)]
    docs += [(1000 + k, docs[k % 7][1].upper()) for k in range(50)]
    got = minhash.near_duplicates(samples.corpus(spark, docs).repartition(4), shingle=2, hot=16, block=50)
    assert rows(got) == brute(docs)


def test_odd_rows_and_empty_tables(spark):
    docs = [(r[0], r[1]) for r in samples.odd_rows()]
    assert rows(minhash.near_duplicates(samples.odd(spark), shingle=2)) == brute(docs)
    assert minhash.near_duplicates(samples.empty(spark)).count() == 0


def test_chances_are_bounded():
    for percent in (50, 60, 80, 90):
        bands, rows_ = minhash.layout(percent)
        assert (1 - (percent / 100) ** rows_) ** bands <= minhash.MISS
        assert 0 < minhash.least_matches(bands * rows_, percent) < bands * rows_ * percent / 100
    assert minhash.layout(80) == (48, 5)


def test_signatures_estimate_the_similarity():
    rng = random.Random(3)
    for share in (0.3, 0.6, 0.9):
        common = samples.words(rng, 2000, 10**9)
        n = int(2000 * (1 - share) / share / 2)
        a, b = (minhash.shingles(" ".join(common + samples.words(rng, n, 10**9)), 1) for _ in range(2))
        x, y = (minhash.signature(s, 240, 1) for s in (a, b))
        assert abs((x == y).mean() - share) < 0.12


def test_a_member_of_many_buckets_is_held_against_one_class_first(spark, monkeypatch):
    rng = random.Random(9)
    base = samples.words(rng, 150)
    docs = [(k, " ".join(edited(rng, base, 0.01))) for k in range(200)]
    counts, alike = [], minhash.alike

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(minhash, "alike", counted)
    assert rows(minhash.near_duplicates(samples.corpus(spark, docs).repartition(4), shingle=2)) == brute(docs)
    assert counts[0] < 200 and sum(counts[1:]) < 200


def test_pairs_of_small_buckets_are_not_joined(spark, monkeypatch):
    """Classes that share buckets without being similar enough meet where their buckets lie."""
    rng = random.Random(11)
    base = samples.words(rng, 150)
    docs = [(k, " ".join(edited(rng, base, 0.09))) for k in range(40)] + [(100 + k, " ".join(edited(rng, base, 0.02))) for k in range(6)]
    counts, alike = [], minhash.alike

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(minhash, "alike", counted)
    assert rows(minhash.near_duplicates(samples.corpus(spark, docs).repartition(4), shingle=2)) == brute(docs)
    assert len(counts) == 2


def test_a_pair_is_left_to_its_first_band():
    words = [f"w{k}" for k in range(300)]
    sets = [minhash.shingles(" ".join(words[k : k + 270]), 2) for k in (0, 1, 2, 3)]
    bands, width = minhash.layout()
    sigs = [minhash.signature(s, bands, width) for s in sets]
    found = []
    for band in range(bands):
        for bucket in {int(s[band]) for s in sigs}:
            mine = [k for k, s in enumerate(sigs) if s[band] == bucket]
            table = minhash.pa.table({"node": mine, "root": mine, "n": [len(sets[k]) for k in mine], "sig": [sigs[k].tolist() for k in mine], "band": [band] * len(mine), "bucket": [bucket] * len(mine)})
            found += [(p["u"], p["v"]) for p in minhash._mates(80, 1, width, table).to_pylist()]
    assert len(found) == len(set(found)) and (2, 3) in found


def test_stars_take_no_round(spark, monkeypatch):
    kept, keep = [], components._Tables.keep
    monkeypatch.setattr(components._Tables, "keep", lambda self, df: kept.append(1) or keep(self, df))
    edges = spark.createDataFrame([(5, 1), (6, 1), (1, 7), (9, 8), (9, 9)], "u long, v long")
    assert sorted(map(tuple, components.components(edges).collect())) == [(1, 1), (5, 1), (6, 1), (7, 1), (8, 8), (9, 8)]
    assert len(kept) == 1
    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long")
    assert sorted(map(tuple, components.components(path).collect())) == [(k, 0) for k in range(41)]
