"""Ranked lexical search by Block-Max MaxScore over an index of segments.

:func:`build` cuts the documents into segments, one task's run of rows each, and writes for every term of a segment its list of
documents: blocks of ``BLOCK`` postings, packed as variable-length numbers, each with its last document and its highest impact.
No row is shuffled. All rows and all terms are indexed.

:func:`search` reads the lists of the terms asked for and ranks each segment by itself. The lists of a query are ordered by their
greatest possible share of a score. Those at the low end that together can't lift a document above the tenth best so far are not
essential: only documents of essential lists are candidates. What the blocks of the other lists can add at most to a candidate
rejects it before those blocks are unpacked. The best of each segment meet in a last ranking, of which Spark's group limit keeps
``k`` rows per query and task before the shuffle.

An impact is ``(1000000000 * tf) div (1000 * tf + 8 * m)`` with ``m = 25 + (75 * n * N) div L``, a score the sum of impacts times term
weights, all in whole numbers, so that scores don't depend on segments or on the order of adding.

Defined results: a null or empty text has no terms, is no document in N and is found by no query; the same holds for queries. Rows that
repeat an id are documents of their own. A null id comes after all others among equal scores. Queries that repeat an id or a
text are answered one by one. Empty tables give no rows. A very long text is one document like any other: a segment ends behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import quoted, whole
from tabwright.session import fresh_path, settle

#: Postings in a block.
BLOCK = 128
#: A segment ends when it holds so many postings or documents. Layout only.
POSTINGS, DOCS = 2_000_000, 1 << 16
#: Documents scored together.
SPAN = 1024
#: Queries that a task answers together: a power of two.
QUERIES = 256
TOP = 10
#: Most partitions of a search.
PARTITIONS = 20_000
#: Uses of terms by queries (some 20 bytes each), up to which they are sent to the index and not the index to them.
SENT = 1_000_000
LAST_ID = (1 << 63) - 1

_KEPT = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_FOLD = bytes(b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))

INDEX = "segment long, term binary, n int, last array<int>, at array<int>, top array<int>, data binary"
_LISTS = {"last": pa.list_(pa.int32()), "at": pa.list_(pa.int32()), "top": pa.list_(pa.int32())}


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and everything beyond ASCII; only A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


# ---- packed numbers ---------------------------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first, and where each value starts (and all end)."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << (7 * k)
    starts = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(starts[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[starts[:-1][has] + k] = (values[has] >> (7 * k) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, starts


def unpack(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    if len(ends) == len(data):
        return data.astype(np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


# ---- the index ----------------------------------------------------------------------------------------------------------------


class Index(NamedTuple):
    """The lists of all segments; documents with a term (N); their terms, with repeats (L)."""

    lists: DataFrame
    n_docs: int
    n_terms: int


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Segment:
    """Documents of one task until they are written as lists."""

    def __init__(self):
        self.numbers, self.ids, self.sizes, self.terms, self.tfs, self.postings = _Numbers(), [], [], [], [], 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        codes = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        terms, tfs = np.unique(codes, return_counts=True)
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.terms.append(terms)
        self.tfs.append(tfs)
        self.postings += len(terms)

    def full(self) -> bool:
        return self.postings >= POSTINGS or len(self.ids) >= DOCS

    def rows(self, number: int, n_docs: int, n_terms: int) -> pa.RecordBatch:
        """One row of documents (term null: ids, which are null, m) and one row per term. Documents are numbered by id, so that of
        equal scores the first one met is the one to keep."""
        null = np.array([i is None for i in self.ids])
        ids = np.array([LAST_ID if i is None else i for i in self.ids], np.int64)
        order = np.lexsort((ids, null))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        m = np.array([25 + 75 * n * n_docs // n_terms for n in self.sizes], np.int64)[order]
        doc = np.repeat(place, [len(t) for t in self.terms])
        term, tf = np.concatenate(self.terms), np.concatenate(self.tfs)
        by = np.lexsort((doc, term))
        doc, term, tf = doc[by], term[by], tf[by]
        first = np.flatnonzero(np.diff(term, prepend=-1))  # of each list
        size = np.diff(np.append(first, len(term)))
        within = np.arange(len(term)) - np.repeat(first, size)
        start = np.flatnonzero(within % BLOCK == 0)  # of each block
        length = np.diff(np.append(start, len(term)))
        gaps = np.diff(doc, prepend=0)
        gaps[start] = doc[start]
        back = np.repeat(start, length)
        values = np.empty(2 * len(term), np.int64)
        values[back + np.arange(len(term))] = gaps
        values[back + np.repeat(length, length) + np.arange(len(term))] = tf
        data, starts = pack(values)
        per_list = (size + BLOCK - 1) // BLOCK
        blocks = np.concatenate([[0], np.cumsum(per_list)])
        edges = np.append(starts[2 * first], len(data))
        lists = {
            "last": doc[start + length - 1],
            "at": starts[2 * start] - np.repeat(edges[:-1], per_list),
            "top": np.maximum.reduceat(impact(tf, m[doc]), start),
        }
        documents = b"".join([ids[order].tobytes(), m.tobytes(), null[order].astype(np.uint8).tobytes()])
        bytes_ = [pa.py_buffer(np.concatenate([[0], edges + len(documents)]).astype(np.int32)), pa.py_buffer(documents + data.tobytes())]
        columns = [
            pa.array(np.full(len(first) + 1, number, np.int64)),
            pa.array([None, *self.numbers], pa.binary()),
            pa.array(np.concatenate([[len(ids)], size]).astype(np.int32)),
            *[pa.ListArray.from_arrays(pa.array(np.concatenate([[0], blocks]).astype(np.int32)), pa.array(v.astype(np.int32))) for v in lists.values()],
            pa.Array.from_buffers(pa.binary(), len(first) + 1, [None, *bytes_]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["segment", "term", "n", *lists, "data"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = length = 0
    for batch in batches:
        for text in batch.column(0):
            if words := len(terms_of(text.as_py())):
                n, length = n + 1, length + words
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([length])], names=["n", "l"])


def _segments(n_docs: int, n_terms: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, segment = TaskContext.get().partitionId() << 32, _Segment()
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            if words := terms_of(text.as_py()):
                segment.add(doc_id.as_py(), words)
                if segment.full():
                    yield segment.rows(number, n_docs, n_terms)
                    number, segment = number + 1, _Segment()
    if segment.ids:
        yield segment.rows(number, n_docs, n_terms)


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> Index:
    """Index every row of ``docs`` into Parquet files at ``path`` (by default a new folder of the shared one)."""
    spark = docs.sparkSession
    own = docs.select(F.col(quoted(key)).cast("long").alias("id"), whole(F.col(quoted(text))).alias("text"))
    n_docs, n_terms = own.select("text").mapInArrow(_sizes, "n long, l long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    path = path or fresh_path(spark, "lexical-index")
    own.mapInArrow(partial(_segments, n_docs, n_terms), INDEX).write.parquet(path)
    return Index(spark.read.schema(INDEX).parquet(path), n_docs, n_terms)


# ---- search -------------------------------------------------------------------------------------------------------------------


class Postings:
    """One list of a segment. Blocks stay packed until a query needs them, and then stay unpacked for the segment's other queries."""

    def __init__(self, n: int, last: np.ndarray, at: np.ndarray, top: np.ndarray, data: bytes, m: np.ndarray):
        self.n, self.last, self.top, self.m = n, last, top.astype(np.int64), m
        self.edges, self.data = np.append(at, len(data)), np.frombuffer(data, np.uint8)
        self.packed = np.ones(len(last), bool)
        # What is packed is filled with the block's last document, so that the whole can be searched.
        self.docs = np.repeat(last, BLOCK)[:n].astype(np.int64) if len(last) > 1 else np.full(n, last[0], np.int64)
        self.impacts = np.zeros(n, np.int64)
        spans = (len(m) + SPAN - 1) // SPAN
        edges = np.arange(spans + 1) * SPAN
        a, b = np.searchsorted(last, edges[:-1]), np.minimum(np.searchsorted(last, edges[1:] - 1), len(last) - 1)
        self.span_top = np.array([self.top[i : j + 1].max(initial=0) for i, j in zip(a, b, strict=True)], np.int64)

    def open(self, blocks: np.ndarray) -> None:
        for b in blocks[self.packed[blocks]].tolist():
            values = unpack(self.data[self.edges[b] : self.edges[b + 1]])
            size, a = len(values) // 2, b * BLOCK
            docs = np.cumsum(values[:size])
            self.docs[a : a + size] = docs
            self.impacts[a : a + size] = impact(values[size:], self.m[docs])
            self.packed[b] = False

    def between(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``lo`` up to ``hi`` and their impacts."""
        first, last = np.searchsorted(self.last, (lo, hi - 1))
        self.open(np.arange(first, min(last + 1, len(self.last))))
        i, j = np.searchsorted(self.docs, (lo, hi))
        return self.docs[i:j], self.impacts[i:j]

    def bound(self, docs: np.ndarray) -> np.ndarray:
        """The highest impact in the block where each document would stand."""
        block = np.searchsorted(self.last, docs)
        return np.where(block < len(self.last), self.top[np.minimum(block, len(self.last) - 1)], 0)

    def of(self, docs: np.ndarray) -> np.ndarray:
        """The impact of each document, 0 where the term is not in it."""
        block = np.searchsorted(self.last, docs)
        self.open(np.unique(block[block < len(self.last)]))
        place = np.minimum(np.searchsorted(self.docs, docs), self.n - 1)
        return np.where(self.docs[place] == docs, self.impacts[place], 0)


def best(lists: list[tuple[int, Postings]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores above 0 and their documents, smaller ones first among equals. ``lists``: weight and postings."""
    lists = sorted(lists, key=lambda x: x[0] * int(x[1].top.max()))
    reach = np.cumsum([w * int(p.top.max()) for w, p in lists])
    span_reach = np.sum([w * p.span_top for w, p in lists], axis=0)
    scores, found, least = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for s in range(len(span_reach)):
        if span_reach[s] <= least:
            continue
        split = int(np.searchsorted(reach, least, "right"))  # lists before it can't lift a document above ``least``
        if split == len(lists):
            break
        lo, hi = s * SPAN, min((s + 1) * SPAN, n_docs)
        total = np.zeros(hi - lo, np.int64)
        for w, p in lists[split:]:
            docs, impacts = p.between(lo, hi)
            total[docs - lo] += w * impacts
        docs = np.flatnonzero(total)
        docs = docs[total[docs] + (reach[split - 1] if split else 0) > least]
        if split and len(docs):
            score, docs = total[docs], docs + lo
            bounds = np.array([w * p.bound(docs) for w, p in lists[:split]])
            rest = bounds.sum(axis=0)
            for j in range(split - 1, -1, -1):
                stay = score + rest > least
                docs, score, rest, bounds = docs[stay], score[stay], rest[stay], bounds[:, stay]
                if not len(docs):
                    break
                w, p = lists[j]
                score = score + w * p.of(docs)
                rest = rest - bounds[j]
        else:
            score, docs = total[docs], docs + lo
        better = score > least
        if better.any():
            scores, found = np.append(scores, score[better]), np.append(found, docs[better])
            order = np.lexsort((found, -scores))[:k]
            scores, found = scores[order], found[order]
            if len(scores) == k:
                least = int(scores[-1])
    return scores, found


def _rank(k: int, rows: pa.Table) -> pa.Table:
    """The best documents of one segment for each query of one block."""
    queries: dict[int, list[tuple[int, Postings]]] = {}
    head = rows.filter(pc.is_null(rows["term"]))
    size, data = head["n"][0].as_py(), head["data"][0].as_py()
    ids, m = np.frombuffer(data, np.int64, size), np.frombuffer(data, np.int64, size, 8 * size)
    null = np.frombuffer(data, np.uint8, size, 16 * size).astype(bool)
    for row in rows.filter(pc.is_valid(rows["term"])).select(["n", "last", "at", "top", "data", "uses"]).to_batches():
        for n, last, at, top, data, uses in zip(*(row.column(c) for c in range(6)), strict=True):
            last, at, top = (np.asarray(x.values) for x in (last, at, top))
            postings = Postings(n.as_py(), last, at, top, data.as_py(), m)
            for use in uses.as_py():
                queries.setdefault(use["query"], []).append((use["weight"], postings))
    out = {"query": [], "score": [], "doc_id": []}
    for query, lists in queries.items():
        scores, docs = best(lists, size, k)
        out["query"] += [query] * len(docs)
        out["score"] += scores.tolist()
        out["doc_id"] += [None if null[d] else int(ids[d]) for d in docs]
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def search(index: Index, queries: DataFrame, key: str = "item_id", text: str = "text", k: int = TOP) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` documents of highest score above 0 for each row of ``queries``."""
    found = "item_id long, rank int, doc_id long, score long"
    spark = queries.sparkSession
    if not index.n_docs:
        return spark.createDataFrame([], found)

    @F.udf("array<binary>")
    def words(x: str) -> list[bytes]:
        return terms_of(x)

    asked = settle(queries.select(F.monotonically_increasing_id().alias("query"), F.col(quoted(key)).cast("long").alias("item_id"), whole(F.col(quoted(text))).alias("text")))
    used = settle(asked.select("query", F.explode(words("text")).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times")))
    send = F.broadcast if used.count() <= SENT else lambda df: df
    df = index.lists.select("term", "n").join(send(used.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    heavy = used.join(df.select("term", weight.alias("weight")).filter("weight > 0"), "term")
    use = F.struct("query", (F.col("times") * F.col("weight")).alias("weight"))
    uses = settle(heavy.groupBy("term", F.shiftright("query", QUERIES.bit_length() - 1).alias("block")).agg(F.collect_list(use).alias("uses")))
    hits = index.lists.join(send(uses), "term")
    met = settle(index.lists.select("segment", "term").join(send(uses.select("term", "block")), "term").select("segment", "block").distinct())
    heads = index.lists.filter("term is null").join(met, "segment").withColumn("uses", F.lit(None).cast(uses.schema["uses"].dataType))
    # Groups are small but take long: as many partitions as groups, which adaptive execution leaves alone.
    rows = hits.unionByName(heads).repartition(max(1, min(met.count(), PARTITIONS)), "segment", "block")
    ranked = rows.groupBy("segment", "block").applyInArrow(lambda t: _rank(k, t), "query long, score long, doc_id long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = ranked.withColumn("rank", place).filter(F.col("rank") <= k)
    return top.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
