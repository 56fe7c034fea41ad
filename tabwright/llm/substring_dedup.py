"""Removal of word windows that start earlier elsewhere, by level-wise doubling.

Level one looks at windows of half the length. Of the half windows inside a whole window the one with the smallest hash stands for
it; equal whole windows have the same one. So only these are counted over the corpus, about one in six places, and only
those found twice are extended to twice their length. Longer repeats are unions of whole windows, so nothing is left to extend.

Neighbouring whole windows with the same half window form a run. Runs are compared as wholes first: a run whose words start
earlier elsewhere is covered throughout. Only the first run of each kind goes on, and only if its half window stands in runs of another
kind too, as at the two ends of a copied passage; their windows are compared one by one. No pair of places is ever made: each
comparison is a smallest place per hash and a join of the places with it.

Windows are equal if a 64-bit hash of the half window and a 64-bit hash of the whole agree, 128 bits together.

Defined results: a null or empty text has no words. A null id counts as greater than any other. Places are (id, start): texts that share
an id are ranked by start alone, and windows that stand at the same place of theirs cover neither of them. Rows that repeat an id and a
text have one answer. Rows are told apart by their id and 64 bits of their text, so that a mix-up needs two texts of one id, or of
none, with equal hashes: one chance in three billion among 100,000 rows without an id.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import quoted, whole
from tabwright.session import settle

WINDOW = 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S, _T = np.uint64(29), np.uint64(32)
LAST_ID = (1 << 63) - 1


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + b
    x = (x ^ (x >> _S)) * _B
    return x ^ (x >> _T)


def hashes(words: list[bytes], size: int) -> np.ndarray:
    """A hash of each window of ``size`` words, from those of windows of 1, 2, 4, ... words."""
    level = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out, done, length = None, 0, 1
    n = len(words) - size + 1
    while True:
        if size & length:
            part = level[done : done + n]
            out, done = (part, length) if out is None else (mix(out, part), done + length)
        if done == size:
            return out
        level, length = mix(level[:-length], level[length:]), 2 * length


def runs(words: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """For each run: hash of its half window, hash of the whole run, first start, number of further starts. And all window hashes."""
    half = window // 2
    small = hashes(words, half)
    large = mix(small[:-half], small[half:])
    at = np.lib.stride_tricks.sliding_window_view(small, window - half + 1).argmin(axis=1) + np.arange(len(large))
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    more = np.diff(np.append(first, len(large))) - 1
    return small[at[first]], mix(large[first], large[first + more]) + more.astype(np.uint64), first, more, large


def _batch(schema: dict[str, pa.DataType], parts: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] or [np.empty(0, np.int64)] * len(schema)
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c).cast(t) for c, t in zip(columns, schema.values(), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=list(schema))


def _seeds(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Half windows that stand for a run, with their number in this batch."""
    for batch in batches:
        found = [runs(w, window)[0] for t in batch.column(0).to_pylist() if len(w := words_of(t)) >= window]
        if found:
            values, counts = np.unique(np.concatenate(found), return_counts=True)
            yield _batch({"m": pa.int64(), "n": pa.int64()}, [(values, counts)])


def _runs(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``m``, ``r``, ``id``, ``tag``, ``a``, ``more`` of every run."""
    schema = {"m": pa.int64(), "r": pa.int64(), "id": pa.int64(), "tag": pa.int64(), "a": pa.int32(), "more": pa.int32()}
    for batch in batches:
        parts = []
        for i, tag, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(words := words_of(t)) >= window:
                m, r, first, more, _ = runs(words, window)
                parts.append((m, r, np.full(len(m), i, np.int64), np.full(len(m), tag, np.int64), first, more))
        yield _batch(schema, parts)


def _windows(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``m``, ``w``, ``id``, ``tag``, ``a`` of every window of the runs that start at the places in ``firsts``."""
    schema = {"m": pa.int64(), "w": pa.int64(), "id": pa.int64(), "tag": pa.int64(), "a": pa.int32()}
    for batch in batches:
        parts = []
        for i, tag, t, firsts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            m, _, first, more, large = runs(words_of(t), window)
            wanted = np.flatnonzero(np.isin(first, firsts))
            size = more[wanted] + 1
            a = np.repeat(first[wanted] - np.cumsum(size) + size, size) + np.arange(size.sum())
            parts.append((np.repeat(m[wanted], size), large[a], np.full(len(a), i, np.int64), np.full(len(a), tag, np.int64), a))
        yield _batch(schema, parts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, removed words and what is left, joined by one space."""
    for batch in batches:
        ids, texts, starts, ends = (c.to_pylist() for c in batch.columns)
        counts, removed, kept = [], [], []
        for t, a, b in zip(texts, starts, ends, strict=True):
            words = words_of(t)
            keep = np.ones(len(words), bool)
            if a:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, a, 1)
                np.add.at(edge, b, -1)
                keep = np.cumsum(edge)[:-1] == 0
            counts.append(len(words))
            removed.append(int(len(words) - keep.sum()))
            left = words if not removed[-1] else [words[k] for k in np.flatnonzero(keep).tolist()]
            kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def release(spark: SparkSession) -> None:
    """Have shuffle files of finished steps deleted now and not when the driver next collects its garbage.

    Plans, what hangs on them and its cleaning are found unused one after the other, in a round each. Files are deleted beside the caller.
    """
    for _ in range(4):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def later(places: DataFrame, *same: str) -> DataFrame:
    """Of the places (``id``, ``a``) that agree in ``same`` all but the first. A hot value is met as one row."""
    place = F.struct("id", "a")
    firsts = settle(places.groupBy(*same).agg(F.min(place).alias("first")))
    return places.join(firsts, list(same)).filter(place != F.col("first"))


def repeated_runs(docs: DataFrame, window: int) -> DataFrame:
    """Level one: the runs whose half window stands for two runs or more, anywhere."""
    halves = docs.select("text").mapInArrow(partial(_seeds, window), "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))
    repeated = settle(halves.filter("n > 1").select("m"))
    places = docs.select("id", "tag", "text").mapInArrow(partial(_runs, window), "m long, r long, id long, tag long, a int, more int")
    return settle(places.join(repeated, "m"))


def first_runs(found: DataFrame) -> DataFrame:
    """Level two, runs as wholes: the first place of each kind."""
    return settle(found.groupBy("m", "r").agg(F.min(F.struct("id", "a")).alias("first")))


def edge_windows(docs: DataFrame, firsts: DataFrame, kinds: DataFrame, window: int) -> DataFrame:
    """Level two, window by window: the windows of first runs (``m``, ``id``, ``tag``, ``a``) whose half window has runs of several kinds."""
    mixed = settle(kinds.groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("m"))
    edges = settle(firsts.join(mixed, "m").groupBy("id", "tag").agg(F.collect_set("a").alias("firsts")))
    texts = docs.join(edges, ["id", "tag"]).select("id", "tag", "text", "firsts")
    return settle(texts.mapInArrow(partial(_windows, window), "m long, w long, id long, tag long, a int"))


def covered(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``id``, ``tag``, ``starts``, ``ends``: word ranges that windows which start earlier elsewhere cover. ``docs``: ``id``, ``tag``, ``text``."""
    if window < 2 or window % 2:
        raise ValueError("the window must be of an even number of words")
    spark = docs.sparkSession
    found = repeated_runs(docs, window)
    release(spark)
    kinds = first_runs(found)
    placed = found.join(kinds, ["m", "r"]).withColumn("again", F.struct("id", "a") != F.col("first"))
    placed = settle(placed.select("m", "id", "tag", "a", "more", "again"))
    ranges = placed.filter("again").select("id", "tag", "a", (F.col("a") + F.col("more") + window).alias("b"))
    # Texts that share an id can hold a run at the same place: all of them are first.
    singles = edge_windows(docs, placed.filter("not again"), kinds, window)
    del found, kinds
    release(spark)
    ranges = ranges.union(later(singles, "m", "w").select("id", "tag", "a", (F.col("a") + window).alias("b")))
    out = ranges.groupBy("id", "tag").agg(F.collect_set(F.struct("a", "b")).alias("x"))
    out = settle(out.select("id", "tag", F.col("x.a").alias("starts"), F.col("x.b").alias("ends")))
    del ranges, singles, placed
    release(spark)
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept``: the text without the words that earlier windows cover."""
    t = whole(F.col(quoted(text)))
    own = docs.select(F.col(quoted(key)).cast("long").alias("doc_id"), t.alias("text"))
    own = own.withColumns({"id": F.coalesce("doc_id", F.lit(LAST_ID)), "tag": F.xxhash64("text")})
    cut = covered(own, window)
    rows = own.join(cut, ["id", "tag"], "left").select("doc_id", "text", "starts", "ends")
    return rows.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")
