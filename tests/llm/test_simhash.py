import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tabwright.llm import simhash as sh
from tabwright.llm.components import components

from tests.llm import samples

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, distance=4):
    """Smallest member for each fingerprint."""
    left, out = set(prints), {}
    while left:
        todo = [left.pop()]
        group = list(todo)
        while todo:
            x = todo.pop()
            near = [y for y in left if (x ^ y).bit_count() <= distance]
            left.difference_update(near)
            todo += near
            group += near
        out |= dict.fromkeys(group, min(group))
    return out


def brute(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    root = brute_components({p for _, p in prints})
    first = {}
    for i, p in prints:
        if i is not None:
            first[root[p]] = min(i, first.get(root[p], i))
    return sorted(((i, f"{p:016x}", first.get(root[p])) for i, p in prints), key=str)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aAbÉé \t\n\x0b  日", max_size=60))
def test_fingerprint(text):
    assert sh.fingerprint(text) % (1 << 64) == brute_print(text)


def test_long_text_counts_every_shingle():
    text = " ".join(samples.words(random.Random(1), 3 * sh.STEP))
    assert sh.fingerprint(text) % (1 << 64) == brute_print(text)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    text = "ünïcode four word shingle"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


def test_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(r[0], r[1]) for r in samples.odd_rows()]
    for k in range(60):
        base = samples.words(rng, 200)
        rows.append((100 + 10 * k, " ".join(base)))
        for c in range(rng.randrange(4)):
            copy = list(base)
            copy[rng.randrange(200)] = "changed"
            rows.append((101 + 10 * k + c, " ".join(copy)))
    got = sh.near_duplicates(samples.corpus(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize(("hot", "block"), [(128, 2048), (2, 3), (1, 1)])
def test_links_find_all_components(spark, hot, block):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(150)}
    centre = rng.getrandbits(64)
    prints |= {centre} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(40)}
    chain = rng.getrandbits(64)
    for _ in range(12):
        for b in rng.sample(range(64), 4):
            chain ^= 1 << b
        prints.add(chain)
    classes = spark.createDataFrame([(sh.signed(p),) for p in prints], "fp long")
    found = {u % (1 << 64): r for u, r in components(sh.links(classes, 4, hot, block)).collect()}
    want = brute_components(prints)
    sets = lambda d: {frozenset(x for x in d if d[x] == r) for r in set(d.values())}
    assert sets({p: found.get(p, sh.signed(p)) for p in prints}) == sets(want)


def test_thresholds_lose_nothing():
    """Any four changed bits are caught by some group of any allocation."""
    rng = np.random.default_rng(2)
    both = rng.random((64, 64)) * 100
    both = both + both.T
    np.fill_diagonal(both, 400)
    for m in range(1, 6):
        groups = sh.group_bits(1000, both, m)
        assert sorted(b for g in groups for b in g) == list(range(64)) and max(map(len, groups)) - min(map(len, groups)) <= 1
        work = [{-1: 0.0} | {t: float(rng.random() * 10 ** t) for t in range(5)} for _ in groups]
        cost, chosen = sh.allocate(work, 5 - m)
        assert sum(chosen) == 5 - m and abs(cost - sum(w[t] for w, t in zip(work, chosen, strict=True))) < 1e-9
        for _ in range(300):
            changed = set(rng.choice(64, 4, replace=False).tolist())
            assert any(t >= 0 and len(changed & set(g)) <= t for g, t in zip(groups, chosen, strict=True))


def test_correlated_bits_share_a_group():
    n = 1000
    both = np.full((64, 64), n / 4)
    np.fill_diagonal(both, n / 2)
    for b in range(0, 64, 2):
        both[b, b + 1] = both[b + 1, b] = n / 2
    groups = sh.group_bits(n, both, 4)
    assert all((b ^ 1) in g for g in groups for b in g)


def test_keep_first(spark):
    docs = samples.odd(spark)
    kept = sh.keep_first(docs)
    assert kept.columns == docs.columns
    want = {}
    for i, p, c in brute([(r[0], r[1]) for r in samples.odd_rows()]):
        want.setdefault(c, []).append(i)
    rows = kept.collect()
    # One document for each component; the two rows of document 5 are one.
    found = {(r.doc_id, r.text) for r in rows}
    assert len(rows) == len(found)
    prints = {brute_print(t) for _, t in found}
    root = brute_components({brute_print(r[1]) for r in samples.odd_rows()})
    assert {root[p] for p in prints} == set(root.values()) and len(rows) == len(set(root.values()))
    assert (5, samples.odd_rows()[4][1]) in found and (6, samples.odd_rows()[4][1]) not in found


def test_empty(spark):
    assert sh.near_duplicates(samples.empty(spark)).count() == 0
    assert sh.keep_first(samples.empty(spark)).count() == 0


def test_components_of_long_paths_and_stars(spark):
    path = [(k, k + 1) for k in range(0, 60)]
    star = [(1000, 1000 + k) for k in range(1, 200)] + [(1150, 1150), (1001, 1000)]
    ring = [(5000 + k, 5000 + (k + 7) % 31) for k in range(31)]
    edges = spark.createDataFrame(path + star + ring, "u long, v long")
    got = dict(components(edges).collect())
    assert got == {k: 0 for k in range(61)} | {1000 + k: 1000 for k in range(200)} | {5000 + k: 5000 for k in range(31)}


def test_a_small_hot_value_beside_a_huge_one_is_cut_by_all_its_members(spark, monkeypatch):
    """With a threshold of 1 the classes of the huge value probe its neighbour, which stores hardly more than HOT."""
    rng = random.Random(9)
    groups = [list(range(16 * k, 16 * k + 16)) for k in range(4)]
    plan = [(sh.signed(sh.mask_of(g)), sh.flips(g, t)) for g, t in zip(groups, (1, 0, 0, 0), strict=True)]
    huge = {rng.getrandbits(48) for _ in range(3000)}
    small = {(1 << 48) | rng.getrandbits(48) for _ in range(25)}
    pair = (1 << 48) ^ min(huge)
    classes = spark.createDataFrame([(sh.signed(p),) for p in huge | small | {pair}], "fp long")
    seen, count = [], sh.meetings
    monkeypatch.setattr(sh, "plan_groups", lambda *_: plan)
    monkeypatch.setattr(sh, "meetings", lambda *a: seen.append(count(*a)) or seen[-1])
    found = {(u % (1 << 64), v % (1 << 64)) for u, v in sh.links(classes, 4, 20, 100).collect()}
    assert (min(huge), pair) in found or (pair, min(huge)) in found
    sizes = seen[0].groupBy("part", "key", "at").count().collect()
    neighbour = [r["count"] for r in sizes if r.part == 0 and r.key == 1 << 48]
    # Two blocks of about 100 of the more than 3,000 members meet at a time; one group held them all.
    assert len(neighbour) > 100 and max(r["count"] for r in sizes) < 300
