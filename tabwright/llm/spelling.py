"""Spelling variants: words one edit apart, grouped under the far more frequent one, by a bit-sliced position index.

The vocabulary is what stands in the texts often enough. Words one edit apart agree in the first half of the shorter one or in the rest of
it, so each word goes to the groups of its halves: once as the shorter word of a pair or one of equal length, once as the longer.
Only members of a group can be near each other in it.

Within a group, every letter at every position is a bit set over the group's words. The sets of words that agree with a query
so far without an error, with one letter replaced, and with one letter more (whose positions are shifted by one) follow from those of
the letter before by a few word-wide operations, for all queries of the group at once. Small groups share the machine words; a group of
more than ``HOT`` members is dealt in blocks, and each two blocks meet in a task of their own. What leaves a task is one row per
word, its number of near words and the best of them, never a pair.

Defined results: null and empty texts have no words. A null id counts as an empty one in the hash that spoils words. Rows that repeat an
id and a text count twice, like any two rows. Of near words with equal counts the first in code-point order is the form. Empty tables give
no rows. A word may be as long as its text; it is a word like any other.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import quoted, whole
from tabwright.session import settle

LETTERS = "A-Za-zÀ-ÿ"
#: Code points of a word, and its occurrences, at least.
LENGTH, TIMES = 7, 2
#: One in so many runs of a document loses a letter.
SPOIL = 31
#: How many times as frequent the form must be.
FACTOR = 10
#: Members of a group, beyond which it is compared in blocks of so many.
HOT = 2048
#: Members that a task of small groups gets, and that are compared at once.
UNIT, CHUNK = 16_384, 512
#: Words that a task counts before it hands them on.
COUNTED = 300_000


def _count(batches: Iterator[pa.RecordBatch], spoil: int, length: int) -> Iterator[pa.RecordBatch]:
    run = re.compile(f"[{LETTERS}]{{{length},}}")
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            start = zlib.crc32(f"{'' if i is None else i}:".encode())
            lowered = text.as_py().encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            for word, n in Counter(run.findall(lowered)).items():
                if spoil and (h := zlib.crc32(word.encode(), start)) % spoil == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < length:
                        continue
                counts[word] += n
            if len(counts) >= COUNTED:
                yield out()
                counts.clear()
    yield out()


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", spoil: int = SPOIL, length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """``word``, ``n``: the distinct words of at least ``length`` code points and their occurrences, ``times`` or more."""
    own = docs.select(F.col(quoted(key)).cast("long").alias("id"), whole(F.col(quoted(text))).alias("text"))
    counted = own.mapInArrow(partial(_count, spoil=spoil, length=length), "word string, n long")
    return settle(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times))


# ---- one group ----------------------------------------------------------------------------------------------------------------


def _bits(rows: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(rows, axis=1, bitorder="little")
    spare = -packed.shape[1] % 8
    return np.pad(packed, ((0, 0), (0, spare))).view(np.uint64)


def _places(bits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little", count=n))


def near_pairs(words: list[str], group: np.ndarray, short: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) in ``words`` of words of one group that are one edit apart, in both directions. ``words`` have ``short`` code
    points or one more; two of the longer ones aren't compared."""
    n = len(words)
    length = np.fromiter(map(len, words), np.int64, n)
    letters = np.frombuffer("".join(w.ljust(short + 1, "\0") for w in words).encode("latin-1"), np.uint8).reshape(n, short + 1)
    asked = np.flatnonzero(length == short)
    even, longer = _bits((length == short)[None, :]), _bits((length == short + 1)[None, :])

    def slice_at(p: int) -> np.ndarray:
        """For each letter, the words that hold it at position ``p``."""
        held = np.zeros((256, n), bool)
        held[letters[:, p], np.arange(n)] = True
        return _bits(held)

    none = _bits(group[asked][:, None] == group[None, :])
    replaced, extra = np.zeros_like(none), np.zeros_like(none)
    here = slice_at(0)
    for p in range(short):
        ahead = slice_at(p + 1)
        query = letters[asked, p]
        same, shifted = here[query], ahead[query]
        extra = (extra | none) & shifted
        replaced = (replaced & same) | (none & ~same)
        none &= same
        here = ahead
    a, b = _places(replaced & even, n)
    c, d = _places((extra | none) & longer, n)
    return np.concatenate([asked[a], asked[c], d]), np.concatenate([b, d, asked[c]])


def _chunks(group: np.ndarray) -> Iterator[slice]:
    """Whole groups of sorted ``group``, some ``CHUNK`` members at a time."""
    edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
    a = 0
    for k in range(1, len(edges)):
        if k == len(edges) - 1 or edges[k + 1] - a > CHUNK:
            yield slice(a, edges[k])
            a = edges[k]


def _near(table: pa.Table) -> pa.Table:
    """For each word with near words in these groups: how many, and the best."""
    rows = table.to_pandas().sort_values(["short", "key", "word"], kind="stable", ignore_index=True)
    out: dict[str, list] = {"word": [], "n_near": [], "form": [], "form_n": []}
    for (short, side), part in rows.groupby(["short", "side"], sort=False):
        words, n, mine = part["word"].to_numpy(object), part["n"].to_numpy(np.int64), part["mine"].to_numpy(np.int64)
        group = pd.factorize(part["key"])[0]
        cross = part["x"].to_numpy() != part["y"].to_numpy()
        for s in _chunks(group):
            if s.stop - s.start < 2:
                continue
            some = words[s].tolist()
            i, j = near_pairs(some, group[s], short)
            keep = np.ones(len(i), bool)
            if side:  # pairs that agree in the first half too are counted there
                first = pd.factorize(np.array([w[: short // 2] for w in some], object))[0]
                keep &= first[i] != first[j]
            if cross[s.start]:
                keep &= mine[s][i] != mine[s][j]
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            rank = np.empty(len(some), np.int64)
            rank[sorted(range(len(some)), key=some.__getitem__)] = np.arange(len(some))
            order = np.lexsort((rank[j], -n[s][j], i))
            i, j = i[order], j[order]
            at = np.flatnonzero(np.diff(i, prepend=-1))
            out["word"] += words[s][i[at]].tolist()
            out["n_near"] += np.diff(np.append(at, len(i))).tolist()
            out["form"] += words[s][j[at]].tolist()
            out["form_n"] += n[s][j[at]].tolist()
    return pa.table({c: pa.array(v, pa.string() if c in ("word", "form") else pa.int64()) for c, v in out.items()})


# ---- all groups ---------------------------------------------------------------------------------------------------------------


def near_words(words: DataFrame, hot: int = HOT, unit: int = UNIT) -> DataFrame:
    """``word``, ``n_near``, ``form``, ``form_n`` of the words (``word``, ``n``) that have near ones: the most frequent of them."""
    size = F.length("word")

    def keys(short):
        half = F.floor(short / 2).cast("int")
        return [F.struct(short.alias("short"), F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("key")), F.struct(short.alias("short"), F.lit(1).alias("side"), F.right("word", short - half).alias("key"))]

    keyed = words.select("word", "n", F.explode(F.array(*keys(size), *keys(size - 1))).alias("k")).select("word", "n", "k.*")
    group = ["short", "side", "key"]
    sizes = settle(keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("g")).filter("g > 1"))
    total = sizes.agg(F.coalesce(F.sum("g"), F.lit(0))).first()[0]
    units = max(1, -(-total // unit))
    met = keyed.join(sizes, group)
    few = met.filter(F.col("g") <= hot).withColumns({"at": F.pmod(F.xxhash64(*group), F.lit(units)), "x": F.lit(0), "y": F.lit(0), "mine": F.lit(0)})
    many = met.filter(F.col("g") > hot).withColumn("nb", F.ceil(F.col("g") / hot).cast("int"))
    many = many.withColumns({"at": F.xxhash64(*group), "mine": F.pmod(F.xxhash64("word"), F.col("nb")).cast("int")})
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    many = many.withColumn("o", other).withColumns({"x": F.least("mine", "o"), "y": F.greatest("mine", "o")})
    columns = ["at", "x", "y", "mine", *group, "word", "n"]
    # Hashes of large groups may meet the numbers of small ones; blocks and single groups are kept apart by ``big``.
    rows = few.select(F.lit(False).alias("big"), *columns).union(many.select(F.lit(True).alias("big"), *columns))
    found = rows.groupBy("big", "at", "x", "y").applyInArrow(_near, "word string, n_near long, form string, form_n long")
    # The smallest of (-n, word) is the most frequent, then the first in order.
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.n")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """``word``, ``root``: the end of the chain of forms that starts at each ``word`` of ``links`` (``word``, ``form``). Forms are ``FACTOR``
    times as frequent, so chains are short; each round doubles the steps."""
    now = settle(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = settle(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            return now
        now = step.drop("moved")


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every one of ``words`` (``word``, ``n``)."""
    found = settle(words.join(near_words(words), "word", "left"))
    rare = F.col("form_n") >= factor * F.col("n")
    named = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(rare, F.col("form")).alias("form"), F.when(rare, F.col("form_n")).alias("form_n"))
    ends = roots(named.filter("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The variants among the words of whole texts."""
    return variants(vocabulary(docs, key, text))
