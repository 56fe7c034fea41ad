import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tabwright.llm import lexical_search as ls

from tests.llm import samples

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    """(item, rank, document, score) by the definition; each item and each document is a row of its own."""
    bags = [(i, Counter(w.translate(LOWER) for w in TERM.findall(t or ""))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    N, L = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 8 * m)) for w in (x.translate(LOWER) for x in TERM.findall(text or "")) if w in b)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        found.sort(key=lambda f: f[:3])
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(found[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def skewed(rng, n):
    """Words of very unequal frequency."""
    return " ".join(f"w{int(400 * rng.random() ** 4)}" for _ in range(n))


@pytest.mark.parametrize(("postings", "block", "span", "parts"), [(2_000_000, 128, 1024, 1), (1500, 4, 16, 3), (300, 1, 7, 5)])
def test_like_brute_force_for_any_layout(spark, monkeypatch, postings, block, span, parts):
    rng = random.Random(3)
    docs = [(k, skewed(rng, rng.randrange(1, 120))) for k in rng.sample(range(10**6), 300)]
    docs += [(10**7 + k, docs[5][1]) for k in range(40)] + [(docs[9][0], docs[9][1])]
    items = [(k, skewed(rng, rng.randrange(1, 30))) for k in range(25)] + [(99, docs[5][1]), (99, "W3, w5! W5")]
    for name, value in (("POSTINGS", postings), ("BLOCK", block), ("SPAN", span)):
        monkeypatch.setattr(ls, name, value)
    number = iter(range(10**6))
    lists, n_docs, n_terms = [], None, None

    def segments(rows):
        out, seg = [], ls._Segment()
        for i, t in rows:
            if w := ls.terms_of(t):
                seg.add(i, w)
                if seg.full():
                    out, seg = [*out, seg], ls._Segment()
        return [*out, seg] if seg.ids else out

    bags = [len(ls.terms_of(t)) for _, t in docs]
    n_docs, n_terms = sum(b > 0 for b in bags), sum(bags)
    for p in range(parts):
        lists += [s.rows(next(number), n_docs, n_terms) for s in segments(docs[p::parts])]
    found = {}
    tables = [ls.pa.Table.from_batches([b]) for b in lists]
    df = Counter()
    for t in tables:
        for term, n in zip(t["term"].to_pylist(), t["n"].to_pylist(), strict=True):
            if term is not None:
                df[term] += n
    for q, (_, text) in enumerate(items):
        for t in tables:
            use = Counter(ls.terms_of(text))
            weight = {w: c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) for w, c in use.items() if df[w]}
            keep = [x is None or weight.get(x, 0) > 0 for x in t["term"].to_pylist()]
            part = t.filter(ls.pa.array(keep))
            uses = [[] if x is None else [{"query": q, "weight": weight[x]}] for x in part["term"].to_pylist()]
            if part.num_rows > 1:
                got = ls._rank(10, part.append_column("uses", ls.pa.array(uses, ls.pa.list_(ls.pa.struct([("query", ls.pa.int64()), ("weight", ls.pa.int64())])))))
                found.setdefault(q, []).extend(zip(got["score"].to_pylist(), got["doc_id"].to_pylist(), strict=True))
    got = [(items[q][0], r + 1, d, s) for q, f in found.items() for r, (s, d) in enumerate(sorted(f, key=lambda x: (-x[0], x[1]))[:10])]
    assert sorted(got, key=str) == brute(docs, items)


def test_through_spark_on_several_segments(spark):
    rng = random.Random(8)
    docs = [(k, skewed(rng, rng.randrange(1, 200))) for k in range(400)]
    items = [(k, skewed(rng, 20)) for k in range(600)]
    index = ls.build(samples.corpus(spark, docs).repartition(5))
    queries = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    assert rows(ls.search(index, queries)) == brute(docs, items)
    assert rows(ls.search(index, queries, k=3)) == brute(docs, items, 3)


def test_odd_rows(spark):
    docs = [(r[0], r[1]) for r in samples.odd_rows()]
    items = [(1, None), (2, ""), (3, "the QUICK brown fox"), (None, "日本 é"), (3, "the QUICK brown fox"), (5, "... --"), (6, "nowhere")]
    index = ls.build(samples.odd(spark))
    queries = spark.createDataFrame([(*i, "x", "y") for i in items], "item_id long, text string, query string, term string")
    assert rows(ls.search(index, queries)) == brute(docs, items)


def test_empty_tables(spark):
    queries = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ls.search(ls.build(samples.empty(spark)), queries).count() == 0
    assert ls.search(ls.build(samples.odd(spark)), queries.limit(0)).count() == 0


def test_numbers_survive_packing():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**21, 2**31 - 1, 5], np.int64)
    data, starts = ls.pack(values)
    assert ls.unpack(data).tolist() == values.tolist() and starts[-1] == len(data)


def test_blocks_that_cannot_matter_stay_packed():
    rng = np.random.default_rng(2)
    seg = ls._Segment()
    for d in range(20_000):
        seg.add(d, [b"common"] * (1 + int(rng.integers(2))) + [b"x"] * int(rng.integers(30)) + ([b"rare"] if d % 997 == 0 else []))
    t = ls.pa.Table.from_batches([seg.rows(0, 20_000, 200_000)])
    m = np.frombuffer(t["data"][0].as_py(), np.int64, 20_000, 160_000)
    lists = {}
    for term, n, last, at, top, data in zip(*(t[c].to_pylist() for c in ("term", "n", "last", "at", "top", "data")), strict=True):
        if term:
            lists[term] = ls.Postings(n, np.array(last), np.array(at), np.array(top), data, m)
    scores, _ = ls.best([(5, lists[b"common"]), (9000, lists[b"rare"])], 20_000, 10)
    assert len(scores) == 10
    assert lists[b"common"].packed.mean() > 0.8
