import random

import numpy as np
import pytest

from tabwright.llm import decontamination as dc

from tests.llm import samples


def textbook(a, b):
    """Smith-Waterman, cell by cell."""
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = max(0, t[i, j] + (dc.MATCH if a[i] == b[j] else dc.MISMATCH), t[i, j + 1] + dc.GAP, t[i + 1, j] + dc.GAP)
    return int(t.max())


def test_alignment_equals_the_textbook():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(-1, 4, rng.integers(1, 25))
        found = dc.align(a, b)
        assert (found[0] if found else 0) == textbook(a, b)
        if found:
            score, matched, columns, first, last, item_first, item_last = found
            assert 0 <= first <= last < len(b) and 0 <= item_first <= item_last < len(a)
            assert textbook(a[item_first : item_last + 1], b[first : last + 1]) == score and matched <= columns


def planted(rng):
    items = [(k, " ".join(samples.words(rng, rng.randrange(15, 55), 900))) for k in range(25)]
    docs, leaks = [], set()
    for k in range(120):
        text = samples.words(rng, rng.randrange(20, 300), 900)
        if k % 3 == 0:
            item_id, item = items[rng.randrange(25)]
            words, kind = item.split(), k % 4
            if kind == 1:
                for p in range(3, len(words), 6):
                    words[p] = "edited"
            elif kind == 2:
                words = [w for p, w in enumerate(words) if p % 9 != 8]
            elif kind == 3:
                words = [x for p, w in enumerate(words) for x in ((w, "really") if p % 7 == 6 else (w,))]
            place = rng.randrange(len(text))
            text[place:place] = [w.upper() if kind == 0 else w for w in words]
            leaks.add((k, item_id))
        docs.append((k, " ".join(text)))
    return items, docs, leaks


def brute(items, docs):
    """Every item against every whole document."""
    out = set()
    for d, t in docs:
        words = dc.words_of(t)
        for i, x in items:
            own = dc.words_of(x)
            if len(own) < dc.NGRAM:
                continue
            ids = {w: k for k, w in enumerate(own)}
            found = dc.align(np.array([ids[w] for w in own]), np.array([ids.get(w, -1) for w in words], int))
            if found and (found[0] >= dc.SCORE * dc.MATCH * len(own) or (found[1] >= dc.RUN and found[1] >= dc.RUN_IDENTITY * found[2])):
                out.add((d, i))
    return out


@pytest.mark.parametrize("block_bytes", [dc.BLOCK_BYTES, 700])
def test_copies_and_edits_are_found_and_clean_texts_left(spark, block_bytes):
    items, docs, leaks = planted(random.Random(4))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.find_leaks(samples.corpus(spark, docs).repartition(3), bench, block_bytes=block_bytes).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert found == brute(items, docs) and leaks == found
    whole = dict(docs)
    for r in rows:
        part = dc.words_of(whole[r.doc_id])[r.first_word : r.last_word + 1]
        assert r.n_matched <= len(part) and 0 < r.score <= 1
    kept = dc.drop_leaks(samples.corpus(spark, docs), bench, block_bytes=block_bytes)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in leaks}


def test_every_stretch_of_words_holds_a_seed():
    items, _, _ = planted(random.Random(6))
    block = dc.Items(items)
    block.choose_seeds(np.append(np.random.default_rng(1).integers(0, 50, len(block.vocabulary)), 100), rare=1e-300)
    for words in block.words:
        size = min(dc.SPAN + dc.NGRAM - 1, len(words))
        for a in range(len(words) - size + 1):
            _, codes = dc.codes_of(words[a : a + size], dc.NGRAM)
            assert len(block.among(codes, block.seeds)[0])


def test_counts_cover_all_documents(spark):
    rows = ((1, "one two three four"),)
    docs = samples.corpus(spark, [(k, "One, two; three! x one two three") for k in range(50)]).repartition(7)
    assert dc.count_words(docs, rows, 3).tolist() == [100, 100, 100, 0, 350]


def test_odd_rows(spark):
    plain = samples.odd_rows()[4][1]
    bench = spark.createDataFrame([(1, plain), (1, plain), (None, plain), (2, None), (3, ""), (4, "a b"), (5, "nowhere to be found at all")], "item_id long, text string")
    rows = dc.find_leaks(samples.odd(spark), bench).collect()
    # Rows with the text: ids 5 (twice), 6, 10 (twice) and null; items with it: 1 (twice) and null.
    assert sorted(((r.doc_id, r.item_id) for r in rows), key=str) == sorted([(d, i) for d in (5, 5, 6, 10, 10, None) for i in (1, 1, None)], key=str)
    docs = samples.odd(spark)
    kept = dc.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in samples.odd_rows() if plain not in (r[1] or "").lower())
    assert dc.find_leaks(samples.empty(spark), bench).count() == 0
    assert dc.find_leaks(docs, bench.limit(0)).count() == 0 and dc.drop_leaks(docs, bench.limit(0)).count() == len(samples.odd_rows())


def has_run(item, passage):
    """Cell by cell: most matches of any stretch that ends here, for each number of words that differ, without a bound on them."""
    most = len(item) // 4 + 1
    t = np.full((most + 1, len(item) + 1, len(passage) + 1), 0)
    for i in range(len(item) + 1):
        for j in range(len(passage) + 1):
            for e in range(most + 1):
                ways = [0]
                if i and j and item[i - 1] == passage[j - 1]:
                    ways.append(t[e, i - 1, j - 1] + 1)
                if e:
                    ways += [t[e - 1, i, j], t[e - 1, i - 1, j - 1] if i and j else 0, t[e - 1, i - 1, j] if i else 0, t[e - 1, i, j - 1] if j else 0]
                t[e, i, j] = max(ways)
    return any(t[e].max() >= max(dc.RUN, 4 * e) for e in range(most + 1))


def block_of(item):
    block = dc.Items([(1, " ".join(item))])
    block.choose_seeds(np.append(np.full(len(block.vocabulary), 5), 100_000))
    return block


def test_a_literal_run_leaks_whatever_stands_beside_it():
    item = [f"i{k}" for k in range(120)]
    fill = [f"f{k}" for k in range(400)]
    every_second = [w if k % 2 else f"x{k}" for k, w in enumerate(item)]
    alone = fill[:50] + item[:30] + fill[50:90]
    looser = fill[:50] + item[:30] + every_second[30:60] + fill[50:90]
    third = [w if k % 3 else f"x{k}" for k, w in enumerate(item[:70])]
    elsewhere = fill[:50] + item[90:118] + fill[60:360] + third + fill[360:]
    joined = third + item[90:118]
    for text in (alone, looser, elsewhere, joined):
        (leak,) = block_of(item).leaks(" ".join(text))
        _, score, matched, identity, first, last, item_first, item_last = leak
        assert matched >= dc.RUN and identity >= dc.RUN_IDENTITY and score < dc.SCORE
        assert {text[first], text[last]} <= set(item) and text[first] == item[item_first] and text[last] == item[item_last]
    assert block_of(item).leaks(" ".join(fill + item[:24] + fill + third[:40] + fill)) == []
    found = dc.align(np.arange(120), np.array([int(w[1:]) if w[0] == "i" else -1 for w in looser]))
    assert found[1] / found[2] < dc.RUN_IDENTITY and found[0] < dc.SCORE * dc.MATCH * 120


def test_literal_runs_equal_a_search_without_bounds():
    rng, seen = np.random.default_rng(5), [0, 0]
    for _ in range(24):
        item = rng.integers(0, 60, int(rng.integers(30, 60)))
        passage = item.copy()
        passage[rng.random(len(item)) < rng.uniform(0.1, 0.4)] = -1
        passage = np.concatenate([rng.integers(-1, 60, 6), np.delete(passage, rng.integers(0, len(passage), 2)), rng.integers(-1, 60, 5)])
        run = dc.literal_run(item, passage)
        assert (run is not None) == has_run(item, passage)
        if run:
            score, matched, columns, first, last, item_first, item_last = run
            assert textbook(item[item_first : item_last + 1], passage[first : last + 1]) >= score >= dc.RUN_SCORE and matched >= 0.8 * columns
            assert item[item_first] == passage[first] and item[item_last] == passage[last]
        seen[run is not None] += 1
    assert min(seen) >= 3
    far = np.concatenate([np.full(dc.PIECE - 20, -1), np.arange(40), np.full(3 * dc.PIECE, -1)])
    assert dc.literal_run(np.arange(40), far)[1:5] == (40, 40, dc.PIECE - 20, dc.PIECE + 19)


def test_find_and_drop_agree_on_runs(spark):
    item = [f"i{k}" for k in range(120)]
    text = [f"f{k}" for k in range(60)] + item[:30] + [w if k % 2 else f"x{k}" for k, w in enumerate(item)][30:60]
    docs = samples.corpus(spark, [(1, " ".join(text)), (2, " ".join(text[:60]))] + [(k, " ".join(f"c{k}x{n}" for n in range(3000))) for k in range(3, 6)])
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()] == [(1, 7)]
    assert sorted(r.doc_id for r in dc.drop_leaks(docs, bench).collect()) == [2, 3, 4, 5]


def edited(rng, words, share, kind, evenly):
    """A copy with a share of its words replaced, left out or followed by another one."""
    n = len(words)
    at = set(np.linspace(0, n - 1, max(1, round(share * n))).astype(int).tolist()) if evenly else set(rng.sample(range(n), max(1, round(share * n))))
    out = []
    for k, w in enumerate(words):
        how = rng.choice(["replace", "drop", "insert"]) if kind == "mixed" else kind
        if k not in at:
            out.append(w)
        elif how == "replace":
            out.append(f"edit{rng.randrange(500)}")
        elif how == "insert":
            out += [w, f"edit{rng.randrange(500)}"]
    return out


def test_every_third_word_replaced_is_a_leak():
    item = [f"i{k}" for k in range(60)]
    text = [f"f{k}" for k in range(90)] + [f"x{k}" if k % 3 == 2 else w for k, w in enumerate(item)] + [f"g{k}" for k in range(90)]
    (leak,) = block_of(item).leaks(" ".join(text))
    assert leak[1] >= dc.SCORE and leak[2] == 40
    twice = [x for w in item for x in (w, "also")]
    assert block_of(item).leaks(" ".join(twice))[0][2] == 60


@pytest.mark.parametrize("evenly", [True, False])
def test_edited_copies_equal_brute_force(evenly):
    rng = random.Random(31 + evenly)
    # Words as uneven as in real texts, so that common pairs are left out of the seeds.
    pool, weights = [f"w{k}" for k in range(3000)], [1 / (k + 1) for k in range(3000)]
    items = [(k, " ".join(rng.choices(pool, weights, k=rng.randrange(dc.GAPPED, 130)))) for k in range(16)]
    docs, planted_at = [], {}
    for k in range(60):
        text = rng.choices(pool, weights, k=rng.randrange(50, 500))
        if k % 5:
            item_id, item = rng.choice(items)
            share, at = rng.choice([0.1, 0.2, 0.3, 0.4]), rng.randrange(len(text))
            text[at:at] = edited(rng, item.split(), share, rng.choice(["replace", "drop", "insert", "mixed"]), evenly)
            planted_at[k] = (item_id, share)
        docs.append((k, " ".join(text)))
    block = dc.Items(items)
    every = block.known(" ".join(t for _, t in docs))
    block.choose_seeds(np.append(np.bincount(every[every >= 0], minlength=len(block.vocabulary)), len(every)))
    found = {(d, leak[0]) for d, t in docs for leak in block.leaks(t)}
    runs = {(d, i) for d, t in docs for i, words in zip(block.ids, block.words, strict=True) if dc.literal_run(words, block.known(t))}
    assert found == brute(items, docs) | runs
    # With 40 % of its words replaced or left out a copy scores less than a leak must.
    seen = [(d, i) in found for d, (i, share) in planted_at.items() if share < 0.4]
    assert len(seen) > 25 and sum(seen) >= 0.9 * len(seen)


def test_runs_of_even_edits_in_long_items():
    rng = random.Random(8)
    for _ in range(40):
        item = [f"i{k}" for k in range(150)]
        a = rng.randrange(100)
        part = item[a : a + dc.RUN_COLUMNS]
        # Six words differ, as evenly as they can.
        for k in range(3, dc.RUN_COLUMNS - 1, 5):
            part[k] = f"x{k}"
        text = [f"f{k}" for k in range(200)] + part + [f"g{k}" for k in range(rng.randrange(200))]
        (leak,) = block_of(item).leaks(" ".join(text))
        assert leak[2] >= dc.RUN and leak[3] >= dc.RUN_IDENTITY


def test_long_texts_are_aligned_in_pieces(monkeypatch):
    rng, widest = random.Random(3), []
    align = dc.align
    monkeypatch.setattr(dc, "align", lambda item, passage: widest.append(len(passage)) or align(item, passage))
    item = [f"i{k}" for k in range(100)]
    text = [w for _ in range(100) for w in edited(rng, item, 0.3, "replace", True)] + item + [w for _ in range(30) for w in edited(rng, item, 0.2, "drop", False)]
    found = block_of(item).leaks(" ".join(text))
    assert found[0][1] == 1.0 and found[0][4] == 10_000 and found[0][5] == 10_099
    assert max(widest) <= 4 * len(item) and sum(widest) > len(text)


def test_items_of_few_words_leak_alone(spark):
    bench = spark.createDataFrame([(1, "Yes, indeed"), (2, "no")], "item_id long, text string")
    docs = samples.corpus(spark, [(1, "yes indeed!"), (2, "Yes indeed it is"), (3, "no"), (4, "no no"), (5, None), (6, "")])
    assert sorted((r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()) == [(1, 1), (3, 2)]
    assert sorted(r.doc_id for r in dc.drop_leaks(docs, bench).collect()) == [2, 4, 5, 6]
