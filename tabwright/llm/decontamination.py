"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

An n-gram of a test item is rare if chance seldom makes it: the product of its words' shares of all words in the corpus, counted over
all documents. (Its own count would not do: a passage that has leaked a thousand times is frequent, and an n-gram that an edited copy
has lost is rare.) All n-grams below ``RARE`` are seeds, and so is the rarest of every ``SPAN`` consecutive ones, so a stretch of
``SPAN + NGRAM - 1`` unedited words always holds a seed. A seed found in a document lays the item over it; the words around are
aligned with the item by Smith-Waterman on words, which scores edited and paraphrased copies too. An item leaks if its best alignment
in the document scores high enough, or if any passage holds a stretch of it that is copied almost word for word, whether that
stretch is in the best alignment or not.

Edits spread evenly leave no n-gram whole, so items of ``GAPPED`` words or more are looked for by gapped pairs too: two words that stand
one or two places apart in both texts. A leak by score has ``m`` matches and ``e`` words that differ with ``2m - e >= n``. Matches that
follow each other with at most one such word between them are a gapped pair, at most ``e / 2`` places hold more, and ``m - 1 - e / 2``
is ``n / 2 - 1`` at least. So if the commonest ``c`` places of the item are left out, ``n / 2 - 1 - c`` pairs of the others stand within
``2n`` words of the document, and no leak by score is lost. The same holds for a stretch of ``RUN`` matches at ``RUN_IDENTITY``.
Items of fewer words need a whole n-gram, as chance brings half their words together.

The items are a stated query set. They reach the tasks in blocks of bounded size, and each block is held against all documents
where they lie: texts never move.

Passages are aligned in overlapping pieces of four item lengths, and a leak spans two at most; so memory follows the square of the
item's length, never the document's.

Defined results: null and empty texts hold no leak. Items of fewer than ``NGRAM`` words leak in documents of just these words alone,
as chance finds them anywhere in longer ones. Null ids and repeated rows or items are reported as they come. Other columns of :func:`drop_leaks` pass whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import quoted, whole

NGRAM = 3
SPAN = 6
#: Chance of an n-gram at a place, up to which it is a seed wherever it stands.
RARE = 1e-6
#: Bytes of item text that one block sends to the tasks.
BLOCK_BYTES = 16_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the highest possible score that makes a leak.
SCORE = 0.5
#: A long item is leaked too if so many of its words are copied almost word for word.
RUN, RUN_IDENTITY = 25, 0.8
#: A stretch of twice as many matches holds one of half of them that is as good, so a search for shorter ones misses no leak: up to this
#: many words that differ, and no more words of the passage.
RUN_ERRORS = 12
RUN_WIDTH = 2 * RUN + RUN_ERRORS
#: The score that any alignment of such a stretch has at least: 25 matches and 6 words that differ.
RUN_SCORE = MATCH * RUN - 6
#: Words of a passage that are searched at once.
PIECE = 2048
#: Words beside the place where an item is laid, for insertions.
MARGIN = 8
#: Words from which an item is looked for by gapped pairs.
GAPPED = 16
#: Columns of the shortest stretch that :data:`RUN` asks for, gapped pairs in it, and places left out of as many item words.
RUN_COLUMNS = int(RUN / RUN_IDENTITY)
RUN_PAIRS = RUN - 1 - (RUN_COLUMNS - RUN) // 2
RUN_COMMON = RUN_PAIRS // 3
#: Item lengths under this count as this when passages are cut.
CUT = 64

FOUND = "item_id long, score double, n_matched long, identity double, first_word long, last_word long, item_first long, item_last long"
_BREAKS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and anything beyond ASCII."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_BREAKS).split()


def codes_of(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and codes of the n-grams whose words are all known."""
    if len(ids) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = ids >= 0
    good = known[: len(ids) - n + 1].copy()
    for k in range(1, n):
        good &= known[k : len(ids) - n + 1 + k]
    at = np.flatnonzero(good)
    code = np.zeros(len(at), np.uint64)
    for k in range(n):
        code = code * _STEP + ids[at + k].astype(np.uint64)
    return at, code


class Items:
    """A block of test items, ready to be looked for."""

    def __init__(self, rows: list[tuple[int | None, str]], n: int = NGRAM):
        self.n = n
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.words = [], []
        self.short: dict[tuple[bytes, ...], list[int | None]] = {}
        for item_id, text in rows:
            words = words_of(text)
            if 0 < len(words) < n:
                self.short.setdefault(tuple(words), []).append(item_id)
            if len(words) >= n:
                self.ids.append(item_id)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64))
        self.grams = [codes_of(w, n)[1] for w in self.words]
        self.seeds = np.empty(0, np.uint64)
        self.places: dict[int, list[tuple[int, int]]] = {}
        self.pairs = self.owners = np.empty(0, np.int64)
        self.first_owner = np.zeros(1, np.int64)
        self.needed = np.zeros(len(self.words), np.int64)

    def known(self, text: str | None) -> np.ndarray:
        return self.numbers(words_of(text))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def among(self, codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which codes are wanted, and their places in ``wanted`` (sorted)."""
        if not len(wanted) or not len(codes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)
        hit = np.flatnonzero(wanted[at] == codes)
        return hit, at[hit]

    def choose_seeds(self, counts: np.ndarray, span: int = SPAN, rare: float = RARE) -> None:
        """``counts``: how often each word of the vocabulary stands in the corpus, and last the number of all its words."""
        share = np.log(np.maximum(counts[:-1], 1) / max(counts[-1], 1))
        chosen: set[int] = set()
        for words, grams in zip(self.words, self.grams, strict=True):
            chance = np.lib.stride_tricks.sliding_window_view(share[words], self.n).sum(axis=1)
            rank = np.empty(len(grams), np.int64)
            rank[np.lexsort((grams, chance))] = np.arange(len(grams))
            width = min(span, len(grams))
            best = np.lib.stride_tricks.sliding_window_view(rank, width).argmin(axis=1) + np.arange(len(grams) - width + 1)
            chosen.update(grams[best].tolist(), grams[chance <= np.log(rare)].tolist())
        self.seeds = np.array(sorted(chosen), np.uint64)
        self.places = {}
        for item, grams in enumerate(self.grams):
            hit, _ = self.among(grams, self.seeds)
            for at in hit.tolist():
                self.places.setdefault(int(grams[at]), []).append((item, at))
        self.choose_pairs(share)

    def pair_codes(self, ids: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and codes of the pairs of known words that stand so far apart."""
        first, second = ids[:-apart], ids[apart:]
        at = np.flatnonzero((first >= 0) & (second >= 0))
        return at, first[at] * len(self.vocabulary) + second[at]

    def choose_pairs(self, share: np.ndarray) -> None:
        """The gapped pairs to look for, who owns them, and how many of them a leak keeps at least."""
        codes, owners = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for item, words in enumerate(self.words):
            if (size := len(words)) < GAPPED:
                continue
            # A place is as common as its commonest pair, which ends there.
            chance = np.full(size, -np.inf)
            chance[1:] = share[words[:-1]] + share[words[1:]]
            chance[2:] = np.maximum(chance[2:], share[words[:-2]] + share[words[2:]])
            left_out = np.zeros(size, bool)
            for a in range(0, size, RUN_COLUMNS):
                part = chance[a : a + RUN_COLUMNS]
                many = len(part) * RUN_COMMON // RUN_COLUMNS
                left_out[a + np.argsort(-part, kind="stable")[:many]] = True
            self.needed[item] = -(-size // 2) - 1 - int(left_out.sum())
            for apart in (1, 2):
                at, found = self.pair_codes(words, apart)
                own = np.unique(found[~left_out[at + apart]])
                codes.append(own)
                owners.append(np.full(len(own), item))
        both = np.unique(np.stack([np.concatenate(codes), np.concatenate(owners)], axis=1), axis=0)
        self.pairs, start = np.unique(both[:, 0], return_index=True)
        self.owners, self.first_owner = both[:, 1], np.append(start, len(both))

    def crowded(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Items, and the stretches of the document that hold as many of their gapped pairs as a leak must."""
        places, owners = [], []
        for apart in (1, 2):
            if len(ids) > apart and len(self.pairs):
                at, codes = self.pair_codes(ids, apart)
                hit, pair = self.among(codes, self.pairs)
                many = self.first_owner[pair + 1] - self.first_owner[pair]
                within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                places.append(np.repeat(at[hit], many))
                owners.append(self.owners[np.repeat(self.first_owner[pair], many) + within])
        if not places:
            return
        # One number for item and place; a place counts once for an item.
        both = np.unique(np.concatenate(owners) * len(ids) + np.concatenate(places))
        owner, place = both // len(ids), both % len(ids)
        sizes = np.array([len(w) for w in self.words], np.int64)
        runs = np.full(len(both), RUN_PAIRS - 2 * RUN_COMMON)
        for least, wide in ((self.needed[owner], 2 * sizes[owner]), (runs, np.full(len(both), RUN_COLUMNS))):
            last = np.arange(len(both)) + least - 1
            inside = last < len(both)
            last = np.minimum(last, len(both) - 1)
            for k in np.flatnonzero(inside & (owner[last] == owner) & (place[last] - place < wide)).tolist():
                yield int(owner[k]), max(0, int(place[last[k]] - wide[k])), min(len(ids), int(place[k] + wide[k]) + 1)

    def passages(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each item the stretches of the document that a seed lays it over or that crowd its pairs, joined where they overlap
        and cut into pieces that overlap by more than a leak is long."""
        at, codes = codes_of(ids, self.n)
        hit, _ = self.among(codes, self.seeds)
        laid: dict[int, set[tuple[int, int]]] = {}
        for place, code in zip(at[hit].tolist(), codes[hit].tolist(), strict=True):
            for item, inside in self.places[code]:
                start = place - inside
                laid.setdefault(item, set()).add((max(0, start - MARGIN), min(len(ids), start + len(self.words[item]) + MARGIN)))
        for item, a, b in self.crowded(ids):
            laid.setdefault(item, set()).add((a, b))
        out: dict[int, list[tuple[int, int]]] = {}
        for item, stretches in laid.items():
            half, spans = 2 * max(len(self.words[item]), CUT), []
            for a, b in sorted(stretches):
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
            out[item] = [(c, min(c + 2 * half, b)) for a, b in spans for c in range(a, max(b - half, a + 1), half)]
        return out

    def leaks(self, text: str | None) -> list[tuple]:
        """The items that the text leaks, each with its best alignment or, if that is no leak, its best almost literal stretch."""
        words = words_of(text)
        ids, out = self.numbers(words), []
        if len(words) < self.n:
            out = [(item_id, 1.0, len(words), 1.0, 0, len(words) - 1, 0, len(words) - 1) for item_id in self.short.get(tuple(words), [])]
        for item, spans in sorted(self.passages(ids).items()):
            words, best, near = self.words[item], None, []
            for a, b in spans:
                # No alignment scores more than its matches; each item word matches once at most.
                most = int(np.isin(words, ids[a:b]).sum())
                if most < min(SCORE * len(words), RUN):
                    continue
                found = align(words, ids[a:b])
                if found and found[0] >= RUN_SCORE:
                    near.append((a, b))
                if found and (best is None or found[0] > best[0]):
                    best = (found[0], found[1], found[2], a + found[3], a + found[4], found[5], found[6])
            if best and not self.leaked(item, best):
                runs = [(a, r) for a, b in near if (r := literal_run(words, ids[a:b]))]
                best = max(((r[0], r[1], r[2], a + r[3], a + r[4], r[5], r[6]) for a, r in runs), key=lambda r: (r[1], r[0]), default=None)
            if best:
                score, matched, columns, first, last, item_first, item_last = best
                out.append((self.ids[item], score / (MATCH * len(words)), matched, matched / columns, first, last, item_first, item_last))
        return out

    def leaked(self, item: int, found: tuple) -> bool:
        score, matched, columns = found[:3]
        return score / (MATCH * len(self.words[item])) >= SCORE or (matched >= RUN and matched / columns >= RUN_IDENTITY)


def literal_run(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int, int, int, int] | None:
    """A stretch of at least ``RUN`` matches at ``RUN_IDENTITY``, if there is one, as :func:`align` gives it: the one of most matches
    among those with up to ``RUN_ERRORS`` words that differ.

    For each number of such words and each pair of places that a stretch may end at, its most matches and where it starts, in one number:
    matches, place in the item, place in the passage.
    """
    one, best = 1 << 44, None
    for at in range(0, max(len(passage) - RUN_WIDTH, 1), PIECE):
        piece = passage[at : at + PIECE + RUN_WIDTH]
        places = np.arange(len(piece) + 1, dtype=np.int64)
        rows = np.repeat(places[None, :], RUN_ERRORS + 1, axis=0)
        for i in range(1, len(item) + 1):
            fresh = np.repeat(((i << 24) + places)[None, :], RUN_ERRORS + 1, axis=0)
            fresh[:, 1:] = np.where(piece == item[i - 1], np.maximum(rows[:, :-1] + one, fresh[:, 1:]), fresh[:, 1:])
            # One more word differs: in both, in the item alone, in the passage alone.
            fresh[1:] = np.maximum(fresh[1:], rows[:-1])
            fresh[1:, 1:] = np.maximum(fresh[1:, 1:], rows[:-1, :-1])
            for e in range(1, RUN_ERRORS + 1):
                fresh[e] = np.maximum(fresh[e], fresh[e - 1])
                fresh[e, 1:] = np.maximum(fresh[e, 1:], fresh[e - 1, :-1])
            rows = fresh
            matches = rows >> 44
            if matches.max() < RUN:
                continue
            for e in range(RUN_ERRORS + 1):
                j = int(matches[e].argmax())
                many = int(matches[e, j])
                if many >= RUN and many >= RUN_IDENTITY * (many + e) and (best is None or (many, -e) > best[0]):
                    start = int(rows[e, j])
                    best = ((many, -e), (MATCH * many - e, many, many + e, at + (start & 0xFFFFFF), at + j - 1, (start >> 24) & 0xFFFFF, i - 1))
    return best[1] if best else None


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int, int, int, int] | None:
    """Best local alignment: score, matches, columns, and first and last place in the passage and in the item."""
    n, m = len(item), len(passage)
    steps = np.arange(m + 1, dtype=np.int64)
    table = np.zeros((n + 1, m + 1), np.int32)
    for i in range(1, n + 1):
        row = np.zeros(m + 1, np.int64)
        row[1:] = np.maximum(table[i - 1, :-1] + np.where(passage == item[i - 1], MATCH, MISMATCH), table[i - 1, 1:] + GAP)
        # A gap in the item costs one a word: the best of all starts to the left.
        table[i] = np.maximum(np.maximum.accumulate(row - GAP * steps) + GAP * steps, 0)
    end = int(table.argmax())
    i, j = divmod(end, m + 1)
    score, last, item_last = int(table[i, j]), j - 1, i - 1
    if score <= 0:
        return None
    matched = columns = 0
    while i and j and table[i, j] > 0:
        same = passage[j - 1] == item[i - 1]
        columns += 1
        if table[i, j] == table[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matched += int(same)
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, matched, columns, j, last, i, item_last


@lru_cache(maxsize=2)
def _unpacked(rows: tuple, n: int, counts: bytes) -> Items:
    items = Items(list(rows), n)
    items.choose_seeds(np.frombuffer(counts, np.int64))
    return items


def _items(shared: Broadcast) -> Items:
    return _unpacked(*shared.value)


def blocks_of(benchmark: DataFrame, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[tuple]:
    """The items in blocks of about ``block_bytes`` (or one item, if that is longer), one after the other."""
    named = benchmark.select(F.col(quoted(key)).cast("long").alias("id"), whole(F.col(quoted(text))).alias("t")).filter("t <> ''")
    size = named.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-int(size) // block_bytes)
    for k in range(blocks):
        rows = named.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).collect()
        yield tuple(sorted(((r.id, r.t) for r in rows), key=lambda r: (r[1], r[0] is None, r[0] or 0)))


def count_words(docs: DataFrame, rows: tuple, n: int, text: str = "text") -> np.ndarray:
    """How often each word of the items stands in all documents, and last the number of all words."""
    shared = docs.sparkSession.sparkContext.broadcast((rows, n))
    size = len(Items(list(rows), n).vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(list(shared.value[0]), n)
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ids = items.known(t)
                total[:-1] += np.bincount(ids[ids >= 0], minlength=size)
                total[-1] += len(ids)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], names=["word", "n"])

    found = docs.select(F.col(quoted(text))).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size + 1, np.int64)
    for word, many in found:
        counts[word] = many
    return counts


def prepared(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", n: int = NGRAM, block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """One broadcast for each block of items, with the counts of its words."""
    return [
        docs.sparkSession.sparkContext.broadcast((rows, n, count_words(docs, rows, n, text).tobytes()))
        for rows in blocks_of(benchmark, item_key, block_bytes=block_bytes)
    ]


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", n: int = NGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item that it leaks, with the best alignment; word places count from 0, ends included."""
    own = docs.select(F.col(quoted(key)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"))
    schema = f"doc_id long, {FOUND}"
    names = [x.split()[0] for x in schema.split(", ")]
    out = docs.sparkSession.createDataFrame([], schema)

    def search(shared: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _items(shared)
            for batch in batches:
                rows = [(d, *leak) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for leak in items.leaks(t)]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                kinds = [pa.float64() if x in ("score", "identity") else pa.int64() for x in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        return run

    for k, shared in enumerate(prepared(own, benchmark, "text", item_key, n, block_bytes)):
        found = own.mapInArrow(search(shared), schema)
        out = found if k == 0 else out.union(found)
    return out


def has_leak(text: Column, shared: Broadcast) -> Column:
    @F.pandas_udf("boolean")
    def leaks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = _items(shared)
        for part in texts:
            yield pd.Series([bool(items.leaks(t)) for t in part], dtype=bool)

    return leaks(whole(text))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", n: int = NGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that leak no item, with their own columns."""
    for shared in prepared(docs, benchmark, text, item_key, n, block_bytes):
        docs = docs.filter(~has_leak(F.col(quoted(text)), shared))
    return docs
