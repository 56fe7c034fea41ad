import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tabwright.llm import byte_bpe as bpe

from tests.llm import samples

RANKS = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


def raw(name):
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def reference(name):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw(name).splitlines())}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", RANKS)
def test_equals_the_merges_and_round_trips(name):
    coder, want, rng = bpe.ByteBpe(raw(name), public_tokenizers.PATTERN), reference(name), random.Random(1)
    texts = ["", " ", "<|endoftext|>", "a" * 3000, "ab" * 2000, " " * 2000, "日本" * 900, "\x00\x01\x7f", "🙂" * 50]
    texts += ["".join(rng.choice("abcdehilnorstu  ,.'ABCéüñ日本\n\t🙂12") for _ in range(rng.randrange(200))) for _ in range(800)]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 0x250), rng.randrange(0x4E00, 0x9000), rng.randrange(0x1F300, 0x1F600)))) for _ in range(60)) for _ in range(300)]
    for text in texts:
        ids = coder.encode(text)
        assert ids == want.encode_ordinary(text), text
        assert coder.decode(ids) == text.encode()


def test_merges_of_a_small_table():
    """Backtracking against the merges themselves, on a table where longest matches mislead."""
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"cd", b"bcd", b"aa", b"aab", b"abcd", b"dd", b"cdd"]
    ranks = b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens))
    coder, order = bpe.ByteBpe(ranks, r"[a-z]+"), {t: k for k, t in enumerate(tokens)}

    def merged(text):
        parts = [bytes([b]) for b in text]
        while True:
            pairs = [(order[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in order]
            if not pairs:
                return [order[p] for p in parts]
            _, k = min(pairs)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14)))
        if text.encode() not in order:
            assert coder.encode(text) == merged(text.encode()), text


def test_memo_bounds_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    coder, want = bpe.ByteBpe(raw(RANKS[0]), public_tokenizers.PATTERN), reference(RANKS[0])
    text = " ".join(samples.words(random.Random(3), 500, 40)) + " einstlichschenkeit " * 3
    for _ in range(3):
        assert coder.encode(text) == want.encode_ordinary(text)
    assert len(coder.memo) <= 3 and len(coder.older) <= 3


def test_documents(spark):
    want = reference(RANKS[0])
    args = (public_tokenizers.path(RANKS[0]), public_tokenizers.PATTERN)
    docs = samples.odd(spark)
    rows = bpe.round_trip(docs, *args).collect()

    def digests(text):
        ids = want.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in rows) == sorted(str((r[0], *digests(r[1]))) for r in samples.odd_rows())
    ids = bpe.encode_documents(docs, *args)  # replaces the column of that name
    shared = bpe.share_ranks(docs, *args)
    for r in ids.withColumn("back", bpe.decoded(ids["ids"], shared)).collect():
        assert bytes(r.back) == (r.text or "").encode() and r.ids == want.encode_ordinary(r.text or "")
    assert bpe.round_trip(samples.empty(spark), *args).count() == 0


def test_ranks_must_hold_all_bytes():
    with pytest.raises(ValueError, match="256"):
        bpe.ByteBpe(base64.b64encode(b"a") + b" 0", r".+")
