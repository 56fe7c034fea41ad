"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation, components by stars.

A document is the set of its distinct shingles. Equal sets are one class from the start. A signature holds ``HASHES`` minima of
strongly universal multiply-shift hashes, twelve bits of each; the minima of a band fill one number, which is the band's bucket as well. Of
sets at the wanted similarity fewer than one pair in a hundred million shares no bucket (:func:`layout`) or is turned away by its
signatures (:func:`least_matches`). Every link is confirmed on the full sets.

Only components are wanted, so no bucket gives all its pairs. First each member is held against the smallest member of one of its buckets, and
components are found; then against those of its other buckets whose smallest member lies in another component, and components are
found again. A bucket whose members all lie in one component is settled: nothing in it can change the result. In the others the pairs
of *different* components follow. Members of buckets of more than ``HOT`` form crowds, as the copies of one text meet in many bands. A crowd
has one main component; its blocks meet blocks of the other members, and those meet each other, in tasks that confirm links on the
sets themselves and merge what they have linked. So a task gives back fewer links than it has members.

Defined results: null and empty texts have no shingles and are linked with nothing; each is its own component. A null id takes no part in the
choice of the smallest; a component of null ids alone has a null id, and its rows count as kept. Rows that repeat an id and a text are
repeated in the result, each with the same answer. A text of fewer words than a shingle is one shingle. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import quoted, whole
from tabwright.llm.components import components
from tabwright.session import settle

SHINGLE = 5
#: Least similarity of a link, in hundredths.
PERCENT = 80
HASHES = 240
#: Bits of a minimum in a signature, and minima that fit a band.
FIELD, WIDEST = 12, 5
#: Greatest chance that a pair at the wanted similarity shares no bucket, or that its signatures turn it away.
MISS = 1e-8
#: Members of a bucket, beyond which its components are compared in blocks.
HOT = 64
#: Members and shingles of a block.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000
#: Classes whose texts are found by sending their hashes to all tasks (16 bytes each); beyond, texts are shuffled.
SENT = 1_000_000
#: Classes for each task that writes a table of them: a small table dealt over many tasks costs more files than it has rows.
CLASSES_PER_TASK = 2_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MASK = np.uint64((1 << FIELD) - 1)


# ---- sets and signatures --------------------------------------------------------------------------------------------------


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + b
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The hashes of the distinct shingles, sorted. Bytes are split, so that only ASCII letters and white space count."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    take = min(size, len(words))
    out = each[: len(words) - take + 1]
    for k in range(1, take):
        out = _mix(out, each[k : len(words) - take + 1 + k])
    return np.unique(out)


def layout(percent: int = PERCENT) -> tuple[int, int]:
    """Bands and minima in a band: the widest bands that lose no more than ``MISS`` of the pairs at ``percent``."""
    share = percent / 100
    rows = max(r for r in range(1, WIDEST + 1) if r == 1 or (1 - share**r) ** (HASHES // r) <= MISS)
    return HASHES // rows, rows


def least_matches(hashes: int, percent: int = PERCENT) -> int:
    """The most matching minima that all but ``MISS`` of the pairs at ``percent`` reach."""
    share, below = percent / 100, 0.0
    for k in range(hashes):
        below += comb(hashes, k) * share**k * (1 - share) ** (hashes - k)
        if below > MISS:
            return k
    return hashes


@cache
def _family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_811)
    factor, offset = rng.integers(0, 1 << 64, (2, hashes), np.uint64)
    return factor[:, None], offset[:, None]


def signature(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number for each band: low bits of the upper halves of the minima, first of all."""
    factor, offset = _family(bands * rows)
    least = np.full(bands * rows, (1 << 64) - 1, np.uint64)
    x = values >> np.uint64(32)
    for k in range(0, len(x), 256):
        np.minimum(least, (factor * x[k : k + 256] + offset).min(axis=1), out=least)
    fields = (least >> np.uint64(32) & _MASK).reshape(bands, rows)
    out = np.zeros(bands, np.uint64)
    for r in range(rows):
        out = out << np.uint64(FIELD) | fields[:, r]
    return out.view(np.int64)


def _digest(values: np.ndarray) -> tuple[int, int]:
    whole_ = xxhash.xxh3_128_digest(values.tobytes())
    return int.from_bytes(whole_[:8], "little", signed=True), int.from_bytes(whole_[8:], "little", signed=True)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64))).cast(pa.list_(pa.int64()))


def _prints(size: int, bands: int, rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py(), size) for t in batch.column(2)]
        high, low = zip(*map(_digest, sets), strict=True) if sets else ((), ())
        sigs = [signature(s, bands, rows) if len(s) else np.empty(0, np.int64) for s in sets]
        columns = [batch.column(0), batch.column(1), pa.array(list(map(len, sets)), pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), _lists(sigs)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n", "hi", "lo", "sig"])


def _sets(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            sets = [shingles(t.as_py(), size) for t in batch.column(0).slice(at, 256)]
            high, low = zip(*map(_digest, sets), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64()), _lists([s.view(np.int64) for s in sets])], names=["hi", "lo", "members"])


# ---- verification -----------------------------------------------------------------------------------------------------------


def alike(pairs: DataFrame, classes: DataFrame, least: int, rows: int, tasks: int | None = None) -> DataFrame:
    """The pairs (``u``, ``v``) whose signatures agree in ``least`` minima."""
    sig = classes.select("node", "sig")
    both = pairs.join(sig.select(F.col("node").alias("u"), F.col("sig").alias("a")), "u").join(sig.select(F.col("node").alias("v"), F.col("sig").alias("b")), "v")

    def agree(x: Column) -> Column:
        return sum((x.bitwiseAND(F.lit(int(_MASK) << (FIELD * r))) == 0).cast("int") for r in range(rows))

    matches = F.aggregate(F.zip_with("a", "b", lambda x, y: agree(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return settle(both.filter(matches >= least).select("u", "v"), tasks)


def sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, size: int, tasks: int | None = None) -> DataFrame:
    """``node``, ``members`` of the classes in ``nodes`` (``node``), from the one text that stands for each."""
    wanted = settle(classes.join(nodes, "node").select("node", "hi", "lo", "rep"), tasks)
    send = F.broadcast if wanted.count() <= SENT else lambda df: df
    th, key = F.xxhash64("text"), F.col("doc_id")
    reps = wanted.select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th"))
    texts = docs.join(send(reps), (th == F.col("rep_th")) & key.eqNullSafe(F.col("rep_id")), "left_semi").select("text")
    found = texts.mapInArrow(partial(_sets, size), "hi long, lo long, members array<long>")
    # Rows that repeat an id and a text come twice.
    return settle(wanted.select("node", "hi", "lo").join(found, ["hi", "lo"]).groupBy("node").agg(F.first("members").alias("members")), tasks)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, tasks: int | None = None) -> DataFrame:
    """The pairs (``u``, ``v``) whose full sets are similar enough."""
    a, b = (sets.select(F.col("node").alias(n), F.col("members").alias(n + "s")) for n in "uv")
    common = F.size(F.array_intersect("us", "vs")).cast("long")
    either = F.size("us").cast("long") + F.size("vs") - common
    return settle(pairs.join(a, "u").join(b, "v").filter(100 * common >= percent * either).select("u", "v"), tasks)


# ---- buckets ------------------------------------------------------------------------------------------------------------------


def _mates(percent: int, least: int, rows: int, table: pa.Table) -> pa.Table:
    """The pairs of one bucket from different components whose sizes and signatures allow a link. A pair that agrees in several bands is left
    to the first of them, and the smallest member has been held against all others."""
    table = table.sort_by("node")
    node, root, size = (table[c].to_numpy() for c in ("node", "root", "n"))
    band, sigs = table["band"][0].as_py(), np.array(table["sig"].to_pylist(), np.int64)
    found: list[tuple[int, int]] = []
    for i in range(1, len(node) - 1):
        rest = np.arange(i + 1, len(node))
        rest = rest[(root[rest] != root[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))]
        differ = sigs[rest] ^ sigs[i]
        agree = sum((differ & (int(_MASK) << (FIELD * r)) == 0).sum(axis=1) for r in range(rows))
        found += [(int(node[i]), int(node[j])) for j in rest[(agree >= least) & ~(differ[:, :band] == 0).any(axis=1)]]
    u, v = zip(*found, strict=True) if found else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _merge(percent: int, least: int, rows: int, table: pa.Table) -> pa.Table:
    """Links between different components of two blocks (or within one), as many as are needed to connect what is linked."""
    node, root, mine = (table[c].to_numpy() for c in ("node", "root", "mine"))
    cross = table["cross"][0].as_py()
    sigs = np.array(table["sig"].to_pylist(), np.int64)
    sets = [np.asarray(x.values) for x in table["members"]]
    size = np.array(list(map(len, sets)))
    label = np.unique(root, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    for i in range(len(node) - 1):
        rest = np.arange(i + 1, len(node))
        rest = rest[(label[rest] != label[i]) & ((mine[rest] != mine[i]) if cross else True)]
        rest = rest[100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])]
        for k in range(0, len(rest), 2048):
            part = rest[k : k + 2048]
            differ = sigs[part] ^ sigs[i]
            agree = sum((differ & (int(_MASK) << (FIELD * r)) == 0).sum(axis=1) for r in range(rows))
            for j in part[agree >= least].tolist():
                if label[j] != label[i]:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= percent * (size[i] + size[j] - common):
                        out.append((int(node[i]), int(node[j])))
                        label[label == label[j]] = label[i]
    return pa.table({"u": pa.array([min(p) for p in out], pa.int64()), "v": pa.array([max(p) for p in out], pa.int64())})


def crowds(many: DataFrame, sets: DataFrame, block: int, tasks: int | None = None) -> DataFrame:
    """``node``, ``root``, ``crowd``, ``x``, ``y``, ``mine``, ``cross``: members of large buckets (``band``, ``bucket``, ``node``, ``root``) in
    the tasks where they meet those of other components. Buckets that share a member are one crowd. Its main component is in blocks
    0, 1, ..., the others in -1, -2, ...; blocks of the main one needn't meet each other."""
    at = ["band", "bucket"]
    first = settle(many.groupBy(*at).agg(F.min("node").alias("first")), tasks)
    crowd = components(many.join(first, at).select(F.col("first").alias("u"), F.col("node").alias("v"))).select(F.col("u").alias("node"), F.col("root").alias("crowd"))
    size = sets.select("node", F.size("members").cast("long").alias("z"))
    members = settle(many.select("node", "root").distinct().join(crowd, "node").join(size, "node"), tasks)
    parts = members.groupBy("crowd", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("z"))
    main = settle(parts.groupBy("crowd").agg(F.sum("n").alias("n"), F.sum("z").alias("z"), F.max(F.struct("n", (-F.col("root")).alias("r"), "z")).alias("o")), tasks)

    def blocks(n: Column, z: Column) -> Column:
        return F.greatest(F.ceil(n / block), F.ceil(z / BLOCK_SHINGLES)).cast("int")

    main = main.select("crowd", (-F.col("o.r")).alias("main"), blocks(F.col("o.n"), F.col("o.z")).alias("nm"), blocks(F.col("n") - F.col("o.n"), F.col("z") - F.col("o.z")).alias("no"))
    here = members.join(main, "crowd").withColumn("h", F.xxhash64("node"))
    central = here.filter("root = main").withColumn("mine", F.pmod("h", "nm").cast("int"))
    central = central.select("node", "root", "crowd", F.col("mine").alias("x"), F.explode(F.sequence(F.lit(-1), -F.col("no"))).alias("y"), "mine")
    others = here.filter("root <> main").withColumn("mine", (-1 - F.pmod("h", "no")).cast("int"))
    partner = F.explode(F.concat(F.sequence(F.lit(0), F.col("nm") - 1), F.sequence(F.lit(-1), -F.col("no"))))
    others = others.withColumn("o", partner).select("node", "root", "crowd", F.greatest("mine", "o").alias("x"), F.least("mine", "o").alias("y"), "mine")
    # A block that meets itself is compared within, others only across.
    return central.union(others).withColumn("cross", F.col("x") != F.col("y"))


def _apart(held: DataFrame, sizes: DataFrame, roots: DataFrame, tasks: int | None) -> DataFrame:
    """``u``, ``v``: members of other components than the smallest member of their bucket, and that member."""
    at, root = ["band", "bucket"], F.col("root")
    own = held.join(roots.withColumnRenamed("u", "node"), "node", "left").select("node", *at, F.coalesce(root, "node").alias("root"))
    first = sizes.select(*at, "first").join(roots.withColumnRenamed("u", "first"), "first", "left").select("first", *at, F.coalesce(root, "first").alias("its"))
    return settle(own.join(first, at).filter("root <> its").select(F.col("first").alias("u"), F.col("node").alias("v")).distinct(), tasks)


def links(classes: DataFrame, docs: DataFrame, size: int, percent: int = PERCENT, hot: int = HOT, block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """``u``, ``v``: confirmed links with the same components as all pairs of similar classes."""
    _, rows = layout(percent)
    least = least_matches(HASHES // rows * rows, percent)
    own = classes.select("node", F.posexplode("sig").alias("band", "bucket"))
    at = ["band", "bucket"]
    sizes = settle(own.groupBy(*at).agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("first")).filter("c > 1"))
    held = settle(own.join(sizes, at))
    # A member of many buckets is held against one class at first; the other pairs follow where they can still connect anything. Pairs of
    # small buckets are told apart where their members meet, as joining them would move a row for each pair.
    starred = held.filter("node <> first")
    near = alike(starred.groupBy("node").agg(F.min("first").alias("u")).select("u", F.col("node").alias("v")), classes, least, rows, tasks)
    sets = sets_of(near.select(F.explode(F.array("u", "v")).alias("node")).distinct(), classes, docs, size, tasks)
    found = confirm(near, sets, percent, tasks)
    again = alike(_apart(held, sizes, components(found), tasks).join(near, ["u", "v"], "left_anti"), classes, least, rows, tasks)
    sets = sets_of(again.select(F.explode(F.array("u", "v")).alias("node")).distinct(), classes, docs, size, tasks)
    near, found = near.union(again), found.union(confirm(again, sets, percent, tasks))
    # A bucket of two is done. The larger ones with several components are not.
    roots = components(found).withColumnRenamed("u", "node")
    named = settle(held.filter("c > 2").select("node", *at, "c").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), tasks)
    mixed = settle(named.groupBy(*at).agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select(*at), tasks)
    left = settle(named.join(mixed, at), tasks)
    some = left.filter(F.col("c") <= hot).select("node", "root", *at).join(classes.select("node", "n", "sig"), "node")
    few = settle(some.groupBy(*at).applyInArrow(lambda t: _mates(percent, least, rows, t), "u long, v long"))
    many = settle(left.filter(F.col("c") > hot), tasks)
    more = sets_of(few.select(F.explode(F.array("u", "v")).alias("node")).union(many.select("node")).distinct(), classes, docs, size, tasks)
    dealt = crowds(many, more, block, tasks)
    loaded = dealt.join(more, "node").join(classes.select("node", "sig"), "node")
    merged = loaded.groupBy("crowd", "x", "y").applyInArrow(lambda t: _merge(percent, least, rows, t), "u long, v long")
    return settle(found.union(confirm(few, more, percent, tasks)).union(merged).distinct())


# ---- the operator -------------------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row."""
    own = docs.select(F.col(quoted(key)).cast("long").alias("doc_id"), whole(F.col(quoted(text))).alias("text"))
    prints = own.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(partial(_prints, shingle, *layout(percent)), "doc_id long, th long, n long, hi long, lo long, sig array<long>")
    prints = settle(prints)
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep")
    classes = prints.filter("n > 0").groupBy("hi", "lo").agg(rep, F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()))
    tasks = max(1, -(-classes.count() // CLASSES_PER_TASK))
    roots = components(links(classes, own, shingle, percent, hot, block, tasks)).withColumnRenamed("u", "node")
    named = settle(classes.select("node", "hi", "lo", F.col("rep.doc_id").alias("first_id")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), tasks)
    smallest = settle(named.groupBy("root").agg(F.min("first_id").alias("component_id")), tasks)
    known = settle(named.join(smallest, "root").select("hi", "lo", "component_id", F.lit(True).alias("known")), tasks)
    out = prints.select("doc_id", "n", "hi", "lo").join(known, ["hi", "lo"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
