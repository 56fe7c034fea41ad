"""Shards of near equal bytes by sampled splitters.

Records are ordered by a key: the hash of the text, then a hash of the id, so equal texts stand together and a large group of them can
still be cut. A sample in which a record is drawn with a chance in proportion to its size gives splitters; the ranges between
them are weighed over all records, and overfull ones get splitters of their own, until each range is small or holds one key. The
totals of the ranges give every record its place in the whole order, and the places are cut into shards. Only ids and
numbers move, never texts. Records that are equal in id, size and checksum are counted before anything moves, placed as one, and numbered
afterwards in runs of bounded length, so one record that a third of all rows repeat costs no task more than another.

The law is ``bytes``: two shards differ by no more than the two largest records.

Defined results: a null text has no bytes and the checksum of the empty text. Null ids are ordered by the hash of null. Repeated rows
are records of their own. An empty table has no shards. With fewer records than shards, or a record larger than a shard,
some shards stay empty.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.llm.common import quoted, whole
from tabwright.session import settle

SHARDS = 40
OVERHEAD = 16
#: Ranges per shard, and records per range above which there are more of them.
RANGES, RECORDS = 32, 250_000
#: Sampled keys per range.
OVERSAMPLE = 8
#: A range of so many times the fair size is overfull.
OVERFULL = 2
#: Copies of one record that one task numbers.
RUN = 65_536

Key = tuple[int, int]


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32`` and the two parts of the ordering key, ``k1`` and ``k2``."""
    t, i = whole(F.col(quoted(text))), F.col(quoted(key))
    return docs.select(
        i.alias("doc_id"), (F.octet_length(t).cast("long") + OVERHEAD).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("k1"), F.xxhash64(i).alias("k2"),
    )


def counted(records: DataFrame) -> DataFrame:
    """Equal records as one, with the number of ``copies``."""
    return records.groupBy(*records.columns).agg(F.count(F.lit(1)).alias("copies"))


def sample(records: DataFrame, bytes_per_key: float, seed: int) -> list[Key]:
    """Keys drawn in proportion to the size of their records, copies included, one in ``bytes_per_key`` bytes. The draw is a function of the key."""
    u = F.pmod(F.xxhash64("k1", "k2", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    drawn = records.filter(u * bytes_per_key < F.col("size") * F.col("copies")).select("k1", "k2").distinct().collect()
    return sorted((r.k1, r.k2) for r in drawn)


def range_of(splitters: list[Key]) -> Column:
    """Number of the range of a key: how many splitters are not above it."""

    @F.pandas_udf("int")
    def place(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(splitters, k) for k in zip(k1.tolist(), k2.tolist(), strict=True)], dtype="int32")

    return place("k1", "k2")


def weigh(records: DataFrame, splitters: list[Key]) -> dict[int, tuple[int, int]]:
    """Bytes and records of each range: as many rows as there are splitters, whatever the table."""
    rows = records.groupBy(range_of(splitters).alias("range")).agg(F.sum(F.col("size") * F.col("copies")).alias("b"), F.sum("copies").alias("n")).collect()
    return {r.range: (r.b, r.n) for r in rows}


def split(records: DataFrame, shards: int = SHARDS) -> tuple[list[Key], dict[int, tuple[int, int]]]:
    """Splitters, and what each range between them weighs."""
    total, n = records.agg(F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    if not n:
        return [], {}
    ranges = max(shards * RANGES, -(-n // RECORDS))
    fair = total / ranges
    drawn = sample(records, fair / OVERSAMPLE, 0)
    splitters = sorted(set(drawn[OVERSAMPLE - 1 :: OVERSAMPLE]))
    while True:
        weights = weigh(records, splitters)
        full = [r for r, (b, _) in weights.items() if b > OVERFULL * fair]
        inside = records.filter(range_of(splitters).isin(full)) if full else None
        # Within an overfull range every sampled key is a splitter.
        more = set(sample(inside, fair, len(splitters))) - set(splitters) if full else set()
        if not more:
            return splitters, weights
        splitters = sorted(set(splitters) | more)


def numbered(records: DataFrame) -> DataFrame:
    """Each copy of each record, with its number ``copy`` from 0."""
    few = records.filter(F.col("copies") <= RUN).withColumn("run", F.lit(0).cast("long"))
    # Only records of many copies move again, a row for each run.
    many = records.filter(F.col("copies") > RUN).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {RUN}"))))
    runs = few.unionByName(many.repartition("k1", "k2", "run"))
    return runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, "copies") - 1)))


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` (gapless in the shard) and ``grown_shard`` of every record."""
    records = settle(counted(keyed(docs, key, text)))
    splitters, weights = split(records, shards)
    order = sorted(weights)
    bytes_before = [0, *accumulate(weights[r][0] for r in order)]
    rows_before = [0, *accumulate(weights[r][1] for r in order)]
    place = {r: (bytes_before[k], rows_before[k]) for k, r in enumerate(order)}
    total = max(bytes_before[-1], 1)

    @F.pandas_udf("b long, n long")
    def before(ranges: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([place[r] for r in ranges], columns=["b", "n"], dtype="int64")

    w = Window.partitionBy("range").orderBy("k1", "k2", "size", "text_crc32", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.col("size") * F.col("copies")
    ranged = records.withColumn("range", range_of(splitters)).withColumns({"own": F.sum(held).over(w) - held, "row": F.sum("copies").over(w) - F.col("copies")})
    placed = numbered(settle(ranged.withColumn("before", before("range"))))
    # The shard is that of the record's middle byte.
    middle = 2 * (F.col("before.b") + F.col("own") + F.col("copy") * F.col("size")) + F.col("size")
    placed = settle(
        placed.select(
            "doc_id", "size", "text_crc32", F.least(F.floor(middle * shards / F.lit(2 * total).cast("decimal(38,0)")).cast("int"), F.lit(shards - 1)).alias("shard"),
            (F.col("before.n") + F.col("row") + F.col("copy")).cast("long").alias("place"),
        )
    )
    first = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    starts = F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(shards)])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.element_at(starts, F.col("shard") + 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` as Parquet with a folder ``shard=n`` for each shard, in key order within it.

    Whole ranges go to the shard that holds their middle byte, so texts are dealt where they lie and each move once.
    """
    records = keyed(docs, key, text)
    splitters, weights = split(settle(counted(records)), shards)
    total = max(sum(b for b, _ in weights.values()), 1)
    shard_of, seen = {}, 0
    for r in sorted(weights):
        shard_of[r] = min(shards - 1, (2 * seen + weights[r][0]) * shards // (2 * total))
        seen += weights[r][0]

    @F.pandas_udf("int")
    def shard(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series([shard_of[bisect_right(splitters, k)] for k in zip(k1.tolist(), k2.tolist(), strict=True)], dtype="int32")

    t, i = whole(F.col(quoted(text))), F.col(quoted(key))
    dealt = docs.withColumn("shard", shard(F.xxhash64(t), F.xxhash64(i)))
    dealt.repartitionByRange(max(shards, 1), "shard", F.xxhash64(t), F.xxhash64(i)).write.partitionBy("shard").parquet(path)
