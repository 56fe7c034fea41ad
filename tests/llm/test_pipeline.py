import random
import shutil

import public_tokenizers

import corpus_pipeline as cp
from tabwright.llm import decontamination as dc
from tabwright.llm.queries import ORACLE, QUERIES

from tests.llm import samples
from tests.llm.test_byte_bpe import RANKS, reference
from tests.llm.test_quality_rules import brute as quality
from tests.llm.test_secret_scan import brute as secret_rows
from tests.llm.test_simhash import brute as near
from tests.llm.test_simhash import brute_print, brute_components


def fixture(rng):
    item = " ".join(samples.words(rng, 40))
    rows = []
    for k in range(90):
        text = samples.words(rng, rng.randrange(25, 200))
        if k % 9 == 0:
            text[5:5] = item.split()
        if k % 7 == 0:
            text[3:3] = ["token", "=", f'"{rng.randbytes(20).hex()}"']
        rows.append((k, " ".join(text)))
        if k % 5 == 0:
            text[-1] = "changed"
            rows.append((1000 + k, " ".join(text)))
    rows += [(2000, "too short"), (2001, None), (2002, ""), (2003, "# $ % & " * 30), (3, rows[3][1]), (None, " ".join(samples.words(rng, 30)))]
    return rows, [(1, item), (2, None), (3, "never seen words in any of these documents here")]


def brute(rows, items):
    """The stages one after the other, by the definitions."""
    rows = [(i, t) for i, t in rows if quality(t)["kept"]]
    root = brute_components({brute_print(t) for _, t in rows})
    kept = {}
    for i, t in rows:
        rank = (i is None, i or 0)
        r = root[brute_print(t)]
        if r not in kept or rank < (kept[r][0] is None, kept[r][0] or 0):
            kept[r] = (i, t)
    block = dc.Items(items)
    block.choose_seeds(__import__("numpy").ones(len(block.vocabulary) + 1, int), rare=1.0)
    rows = [(i, t) for i, t in kept.values() if not block.leaks(t)]
    out, coder = [], reference(RANKS[0])
    spans = {r[0]: r[5] for r in secret_rows(rows)}
    for i, t in rows:
        found, at, text = [tuple(map(int, s.split(":")[1:])) for s in spans[i].split(",") if s], 0, ""
        for a, b in sorted(found):
            if a >= at:
                text += t[at:a] + "[SECRET]"
            at = max(at, b)
        text += t[at:]
        out.append((i, len(coder.encode_ordinary(text)), text))
    return sorted(out, key=str)


def test_against_brute_force(spark, tmp_path):
    rows, items = fixture(random.Random(6))
    samples.corpus(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute(rows, items)
    got = cp.run(spark, str(tmp_path)).collect()
    import hashlib

    assert sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got), key=str) == sorted(((i, n, hashlib.sha256(t.encode()).hexdigest()) for i, n, t in want), key=str)
    assert near(rows) and 0 < len(got) < len(rows)
    shutil.rmtree(tmp_path / "documents.parquet")


def test_stages_keep_the_columns_and_take_odd_rows(spark, tmp_path):
    _, items = fixture(random.Random(6))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (_, stage) in enumerate(cp.STAGES):
        for docs in (samples.odd(spark), samples.empty(spark)):
            out = stage(spark, docs, str(tmp_path))
            if k < len(cp.STAGES) - 1:
                assert out.columns == docs.columns
            assert out.count() <= docs.count()
    assert public_tokenizers.path(cp.RANKS)


def test_registration():
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None and "pipeline" not in ORACLE
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14)) and "pipeline" in QUERIES
