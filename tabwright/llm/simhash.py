"""SimHash near-duplicates by a generalised pigeonhole.

A fingerprint has 64 bits. They are split into groups of bits that vary together, and group ``i`` gets its own threshold
``t_i``. If two fingerprints differ in at most ``d`` bits and the thresholds add up to ``d + 1 - groups``, then in some group they
differ in at most ``t_i`` bits; -1 leaves a group out. So each fingerprint is stored under its bits in each group, probes all
values within ``t_i`` of its own, and every candidate is verified on all 64 bits. Nothing is lost for any choice of groups and
thresholds; a dynamic programme chooses the ones of least expected work, from counts over all fingerprints.

Equal fingerprints are one class from the start. A group value that more than ``HOT`` classes share is not joined pair by pair: its
classes go to blocks, and each pair of blocks gives back one star per connected set, so a ball of near copies gives as many
rows as it has members, not as many as it has pairs.

Defined results: null and empty texts have fingerprint zero and are linked like any other. A null id takes no part in
the choice of the smallest id; a component of null ids alone has a null id. Repeated rows are repeated in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import fresh_name, quoted, whole
from tabwright.llm.components import components
from tabwright.session import settle

BITS = 64
SHINGLE = 4
DISTANCE = 4
#: Classes under one group value, beyond which they are compared in blocks.
HOT = 128
#: Classes in a block.
BLOCK = 2048
#: Work of one signature row, in candidates.
ROW_WORK = 60
#: Shingles whose bits are counted at once.
STEP = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII letters and ASCII white space
    if not words:
        return 0
    size = min(shingle, len(words))
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)])
    n, counts = len(hashes) // 8, np.zeros(BITS, np.int64)
    packed = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for k in range(0, n, STEP):
        counts += np.unpackbits(packed[k : k + STEP], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprint_of(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return prints(whole(text))


def hex16(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- the plan -------------------------------------------------------------------------------------------------------------


def bit_counts(prints: DataFrame, column: str = "fp") -> tuple[int, np.ndarray]:
    """Number of rows, and how often bits i and j are both set, over all rows. 4,097 sums meet at the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = np.asarray(batch.column(0)).astype(np.int64, copy=False)
            for k in range(0, len(values), STEP):
                part = np.ascontiguousarray(values[k : k + STEP], ">i8")
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
                total += bits.T @ bits
            n += len(values)
        cells = np.append(total.astype(np.int64).ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], names=["cell", "n"])

    rows = prints.select(column).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1, np.int64)
    for cell, n in rows:
        cells[cell] = n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, groups: int) -> list[list[int]]:
    """Split the bits (0: most significant) into groups of near equal size, correlated bits together."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    close = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    left, out = set(range(BITS)), []
    for k in range(groups):
        size = len(left) // (groups - k)
        first = max(left, key=lambda b: (round(sum(close[b, c] for c in left if c != b), 9), -b))
        own = [first]
        left.remove(first)
        while len(own) < size:
            best = max(left, key=lambda b: (round(sum(close[b, c] for c in own), 9), -b))
            own.append(best)
            left.remove(best)
        out.append(sorted(own))
    return out


def mask_of(bits: list[int]) -> int:
    return sum(1 << (BITS - 1 - b) for b in bits)


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def flips(bits: list[int], most: int) -> list[int]:
    """All changes of up to ``most`` of the bits, as masks."""
    return [signed(mask_of(list(c))) for k in range(most + 1) for c in combinations(bits, k)]


def growth(share: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Expected pairs within 0, 1, ... ``most`` of each other, over those that are equal in ``bits``."""
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for b in bits:
        p = 2 * share[b] * (1 - share[b])
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    return list(np.cumsum(chance) / max(chance[0], 1e-300))


def allocate(work: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """One threshold for each group, adding up to ``total``, of least work. ``work[i][t]``: work of group i at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for costs in work:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in costs.items():
                if used + t not in step or cost + c < step[used + t][0]:
                    step[used + t] = (cost + c, [*chosen, t])
        best = step
    return best[total]


def plan_groups(classes: DataFrame, distance: int = DISTANCE) -> list[tuple[int, list[int]]]:
    """The mask of each group in use and the flips its probes make."""
    n, both = bit_counts(classes)
    share = np.diag(both) / max(n, 1)
    choices = {m: group_bits(n, both, m) for m in range(1, distance + 2)}
    keys = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(signed(mask_of(g)))).alias("key")) for m, gs in choices.items() for i, g in enumerate(gs) if m > 1]
    same = classes.select(F.explode(F.array(*keys)).alias("k")).groupBy("k.m", "k.i", "k.key").agg(F.count(F.lit(1)).alias("c"))
    pairs = {(r.m, r.i): float(r.p) for r in same.groupBy("m", "i").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("p")).collect()}
    options = []
    for m, gs in choices.items():
        work = []
        for i, g in enumerate(gs):
            more = growth(share, g, distance)
            rows = {t: max(n, 1) * (1 + sum(comb(len(g), k) for k in range(t + 1))) for t in range(distance + 1)}
            work.append({-1: 0.0} | {t: ROW_WORK * rows[t] + pairs.get((m, i), 0.0) * more[t] for t in rows})
        options.append((*allocate(work, distance + 1 - m), gs))
    _, thresholds, gs = min(options, key=lambda o: o[0])
    return [(signed(mask_of(g)), flips(g, t)) for g, t in zip(gs, thresholds, strict=True) if t >= 0]


# ---- probe and verify -----------------------------------------------------------------------------------------------------


def signatures(classes: DataFrame, groups: list[tuple[int, list[int]]], probe: bool) -> DataFrame:
    """``part``, ``key``, ``fp``: the own bits in each group, or all values that a probe looks up."""
    def keys(part: int, mask: int, changes: list[int]) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(mask))
        values = F.transform(F.array(*[F.lit(x).cast("long") for x in changes]), lambda x: own.bitwiseXOR(x)) if probe else F.array(own)
        return F.transform(values, lambda k: F.struct(F.lit(part).alias("part"), k.alias("key")))

    arrays = [keys(i, mask, changes) for i, (mask, changes) in enumerate(groups)]
    return classes.select("fp", F.explode(F.concat(*arrays)).alias("s")).select("s.part", "s.key", "fp")


def stars(values: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """(root, member) for every value but one in each connected set. Work falls with the density; memory is a few rows."""
    left = np.unique(values).view(np.uint64)
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for k in range(0, len(front), 64):
                far = np.flatnonzero(~near)
                if not len(far):
                    break
                close = np.bitwise_count(front[k : k + 64, None] ^ left[far][None, :]) <= distance
                near[far[close.any(axis=0)]] = True
            front, left = left[near], left[~near]
            for x in front.view(np.int64).tolist():
                yield int(root.astype(np.int64)), x


def meetings(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members of hot values (``part``, ``key``, ``fp``), whether stored or probing, in every pair ``at`` of their value's blocks. The
    blocks of a value are as many as its members ask for: far more may probe it than it stores."""
    members = settle(members)
    blocks = settle(members.groupBy("part", "key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb")))
    dealt = members.join(blocks, ["part", "key"]).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("nb")))
    return dealt.select(
        "part", "key", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: F.struct(F.least(x, F.col("mine")).alias("x"), F.greatest(x, F.col("mine")).alias("y")))).alias("at")
    )


def links(classes: DataFrame, distance: int = DISTANCE, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """``u``, ``v``: pairs of fingerprints with the same components as all pairs within ``distance``. Every row connects
    members of one component; outside hot values all pairs are there."""
    groups = plan_groups(classes, distance)
    own, probes = signatures(classes, groups, False), signatures(classes, groups, True)
    full = settle(own.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot))
    a, b = F.col("a.fp"), F.col("b.fp")
    cold = [x.join(full, ["part", "key"], "left_anti") for x in (probes, own)]
    pairs = (
        cold[0].alias("a").join(cold[1].alias("b"), (F.col("a.part") == F.col("b.part")) & (F.col("a.key") == F.col("b.key")) & (a < b) & (F.bit_count(a.bitwiseXOR(b)) <= distance))
        .select(a.alias("u"), b.alias("v"))
    )
    met = meetings(full.select("part", "key").join(probes.union(own).distinct(), ["part", "key"]), block)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(stars(rows["fp"].to_numpy(np.int64), distance)), columns=["u", "v"], dtype="int64")

    return pairs.union(met.groupBy("part", "key", "at").applyInPandas(compare, "u long, v long"))


def label_classes(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``classes`` (``fp``, ``first_id``) with ``root``, the smallest fingerprint of the component."""
    roots = settle(components(links(classes, distance)))
    return settle(classes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id``, ``fingerprint``, ``component_id`` for every row."""
    prints = settle(docs.select(F.col(quoted(key)).alias("doc_id"), fingerprint_of(F.col(quoted(text)), shingle).alias("fp")))
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = label_classes(classes, distance)
    smallest = settle(labels.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = settle(labels.select("fp", "root").join(smallest, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each component, with its own columns: the smallest id (null last), then the smallest text hash."""
    th = fresh_name(docs, "text_hash")
    hashed = docs.withColumn(th, F.xxhash64(whole(F.col(quoted(text)))))
    prints = settle(hashed.select(F.col(quoted(key)).alias("id"), F.col(th).alias("th"), fingerprint_of(F.col(quoted(text)), shingle).alias("fp")))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first_id")
    labels = label_classes(settle(prints.groupBy("fp").agg(first)), distance)
    kept = settle(labels.groupBy("root").agg(F.min("first_id").alias("k")).select(F.col("k.id").alias("id"), F.col("k.th").alias("th")))
    same = F.col(quoted(key)).eqNullSafe(kept["id"]) & (F.col(th) == kept["th"])
    # Rows that repeat an id and a text are one document.
    out = hashed.join(kept, same, "left_semi").dropDuplicates([key, th])
    return out.select(*[F.col(quoted(c)) for c in docs.columns])
