import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabwright.llm import spelling

from tests.llm import samples

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts):
    form, near = {}, {}
    for w, n in counts.items():
        others = [o for o in counts if one_edit(w, o)]
        near[w] = len(others)
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near[w], counts.get(form[w])))
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.collect()))


def vocabulary(rng, n, letters="abé", most=11):
    out = {}
    while len(out) < n:
        out["".join(rng.choice(letters) for _ in range(rng.randrange(7, most)))] = int(2 + 10 ** (4 * rng.random()))
    return out


@pytest.mark.parametrize(("hot", "chunk", "unit", "seed"), [(2048, 512, 16_384, 1), (5, 512, 16_384, 2), (40, 8, 50, 3)])
def test_like_brute_force(spark, monkeypatch, hot, chunk, unit, seed):
    rng = random.Random(seed)
    counts = vocabulary(rng, 400)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    expected = brute(counts)
    got = {r.word: (r.n_near, r.form, r.form_n) for r in spelling.near_words(words, hot=hot, unit=unit).collect()}
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    assert got == {w: (len(o), f := min(o, key=lambda x: (-counts[x], x)), counts[f]) for w, o in near.items() if o}
    assert rows(spelling.variants(words)) == expected


def test_pairs_of_one_group():
    rng = random.Random(5)
    monotone = ["".join(rng.choice("ab") for _ in range(rng.choice([8, 9]))) for _ in range(200)]
    words = sorted(set(monotone))
    group = np.array([k % 2 for k in range(len(words))])
    i, j = spelling.near_pairs(words, group, 8)
    expected = {(a, b) for a, x in enumerate(words) for b, y in enumerate(words) if group[a] == group[b] and one_edit(x, y) and min(len(x), len(y)) == 8}
    assert len(i) == len(expected) and set(zip(i.tolist(), j.tolist(), strict=True)) == expected


def test_chains_end_at_the_last_form(spark):
    counts = {"aaaaaaa" + "b" * k: 10**k * 2 for k in range(9)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows(spelling.variants(words))
    assert got == brute(counts)
    assert {r[2] for r in got} == {"aaaaaaa" + "b" * 8}


def test_words_of_texts(spark):
    rng = random.Random(6)
    stems = ["colourés", "THOUGHT", "marvellous", "Élèvesque", "xyzzyxy"] + ["".join(rng.choice("abcdefghÿ×") for _ in range(9)) for _ in range(30)]
    docs = [(rng.randrange(10**9) - 10**8, " ".join(rng.choice(stems) for _ in range(rng.randrange(60)))) for _ in range(400)]
    docs += [(None, "thought thought Thoughts_thought9thought"), (None, None), (7, ""), (8, "z" * 5000), (9, "z" * 5000 + " " + "z" * 5001), (10, "z" * 5001), *docs[:20]]
    counts = brute_words(docs)
    corpus = samples.corpus(spark, docs).repartition(5)
    assert {r.word: r.n for r in spelling.vocabulary(corpus).collect()} == counts
    assert rows(spelling.group_variants(corpus)) == brute(counts)


def test_odd_rows_and_empty_tables(spark):
    docs = [(r[0], r[1]) for r in samples.odd_rows()]
    assert rows(spelling.group_variants(samples.odd(spark))) == brute(brute_words(docs))
    assert rows(spelling.group_variants(samples.empty(spark))) == []
