"""Classification forests without a bound on depth, and regression forests over counted inputs.

Spark grows the upper levels of all trees until the distinct rows of a node fit one task. Then the rows go to their nodes, one group for each
tree and node, and every group grows the rest of its tree at once, level by level, until leaves are pure or their rows equal. The
nodes stay a table; the driver never holds them. A table that fits a task needs no upper levels.

Rows travel in packs, one for each task, tree and node, and a group sorts its inputs once: a level only parts what is sorted.

Equal rows are counted first. A group draws the number of times that each of its rows is in the tree's bag, from a generator seeded by tree and
node over rows in a fixed order, so a group that is computed again gives the same tree.

A regression tree needs no more of its bag than how often the rows of each distinct input are in it, and the sum of their labels there.
Every row is drawn for every tree, in streams; what is left of it, one number and one sum for each input and tree, goes to one group for
each tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..plans.scalars import col
from ..session import settle

#: Distinct rows (inputs and label) that one group should hold, and the most it may hold before another upper level is grown.
ROWS_PER_GROUP, MOST_ROWS = 200_000, 1_000_000
#: Levels that are added at a time, up to Spark's bound.
MORE_LEVELS, MAX_LEVELS = 4, 30
#: Values of an input between which a regression tree may cut (the fewest are those of Spark's forest), its deepest level, and parts among
#: which the rows of one input are dealt.
CUTS, FEWEST_CUTS, MOST_DEPTH, SPREAD = 256, 32, 10, 4
#: Distinct rows that travel in one pack for each tree: on the way to grow trees, and to descend them (every tree's shares of a pack meet).
GROW_PACK, DESCEND_PACK = 100_000, 20_000
NODES = "tree int, root int, feature array<int>, threshold array<double>, left array<int>, share array<double>"


def _splits(x, w, node, counts, wanted, min_leaf, orders):
    """For each node the best split among its wanted features: (score, feature, threshold), score -inf if there is none.

    ``x`` has an array for each feature, ``w`` the rows' weights for each class, ``orders`` the rows for each feature, sorted by node
    and value."""
    n_nodes, classes = counts.shape
    best, feature, threshold = np.full(n_nodes, -np.inf), np.full(n_nodes, -1), np.zeros(n_nodes)
    for f, order in enumerate(orders):
        tries = np.ascontiguousarray(wanted[:, f])
        if not tries.any():
            continue
        at = node[order]
        if not tries.all():
            chosen = tries[at]
            order, at = order[chosen], at[chosen]
        v = x[f][order]
        same = at[1:] == at[:-1]
        # Only a place between two values of a node can be a split.
        ends = np.flatnonzero(same & (v[1:] > v[:-1]))
        if not len(ends):
            continue
        first = np.r_[0, np.flatnonzero(~same) + 1]
        of, began = at[ends], at[first]
        n_left, n_right, here, there = np.zeros(len(ends)), np.zeros(len(ends)), np.zeros(len(ends)), np.zeros(len(ends))
        for c in range(classes):
            total = w[c][order].cumsum()
            before = np.zeros(n_nodes)
            before[began] = np.r_[0.0, total[first[1:] - 1]]
            left = total[ends] - before[of]
            right = counts[:, c][of] - left
            n_left += left
            n_right += right
            here += left * left
            there += right * right
        with np.errstate(divide="ignore", invalid="ignore"):
            score = here / n_left + there / n_right
        if min_leaf > 0:
            score[(n_left < min_leaf) | (n_right < min_leaf)] = -np.inf
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        top = np.maximum.reduceat(score, start)
        hits = np.flatnonzero((score > -np.inf) & (score == np.repeat(top, np.diff(np.r_[start, len(of)]))))
        hits = hits[np.flatnonzero(np.r_[True, of[hits][1:] != of[hits][:-1]])] if len(hits) else hits
        nodes, place, score = of[hits], ends[hits], score[hits]
        better = score > best[nodes]
        nodes, place, score = nodes[better], place[better], score[better]
        middle = v[place] + (v[place + 1] - v[place]) / 2
        best[nodes], feature[nodes] = score, f
        threshold[nodes] = np.where(middle < v[place + 1], middle, v[place])
    return best, feature, threshold


def _parted(order: np.ndarray, node: np.ndarray, n_nodes: int) -> np.ndarray:
    """Rows sorted by parent and value, sorted by node and value; the nodes of a parent are an even number and the next."""
    at = node[order]
    right = (at & 1).astype(bool)
    held = np.bincount(at, minlength=n_nodes)
    left_upto, right_upto = held[::2].cumsum(), held[1::2].cumsum()
    parted = np.empty_like(order)
    for side, shift in ((~right, right_upto - held[1::2]), (right, left_upto)):
        rows = order[side]
        parted[np.arange(len(rows)) + shift[at[side] >> 1]] = rows
    return parted


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, tried: int, min_leaf: float, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """A tree over rows of weight ``w``: rows with x[feature] <= threshold go to ``left``, others to ``left + 1``; leaves have feature -1.

    Each node tries ``tried`` features drawn at random, and the others if none of these parts its rows.
    """
    feature, threshold, left, share = [], [], [], []
    held = np.flatnonzero(w > 0)
    inputs, y, w = [np.ascontiguousarray(c) for c in x[held].T], y[held], w[held]
    weights = [np.where(y == c, w, 0.0) for c in range(classes)]
    rows, node, made = np.arange(len(held), dtype="int32"), np.zeros(len(held), "int32"), 1
    orders = [np.argsort(v, kind="stable").astype("int32") for v in inputs]
    n_nodes = 1
    while n_nodes:
        at = node[rows]
        counts = np.column_stack([np.bincount(at, v[rows], n_nodes) for v in weights])
        total = counts.sum(axis=1)
        open_ = counts.max(axis=1) < total
        drawn = rng.random((n_nodes, x.shape[1])).argsort(axis=1).argsort(axis=1) < tried
        part = inputs, weights, node, counts
        score, best, cut = _splits(*part, drawn & open_[:, None], min_leaf, orders)
        missing = open_ & (best < 0)
        if missing.any() and tried < x.shape[1]:
            _, more, where = _splits(*part, ~drawn & missing[:, None], min_leaf, orders)
            best, cut = np.where(missing, more, best), np.where(missing, where, cut)
        split = best >= 0
        below = made + 2 * (np.cumsum(split) - 1)
        feature.append(best), threshold.append(cut), left.append(np.where(split, below, -1))
        share.append(counts / np.maximum(total, 1e-300)[:, None])
        n_nodes = 2 * int(split.sum())
        orders = [o[split[node[o]]] for o in orders]
        rows, at = rows[split[at]], at[split[at]]
        by, right = best[at], np.zeros(len(rows), bool)
        for f, v in enumerate(inputs):
            of = np.flatnonzero(by == f)
            right[of] = v[rows[of]] > cut[at[of]]
        node[rows] = below[at] - made + right
        orders = [_parted(o, node, n_nodes) for o in orders]
        made += n_nodes
    return {"feature": np.concatenate(feature), "threshold": np.concatenate(threshold), "left": np.concatenate(left), "share": np.concatenate(share)}


def descend(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The class shares of the leaf that each row reaches."""
    at = np.zeros(len(x), "int64")
    moving = np.flatnonzero(tree["feature"][at] >= 0)
    while len(moving):
        f = tree["feature"][at[moving]]
        at[moving] = tree["left"][at[moving]] + (x[moving, f] > tree["threshold"][at[moving]])
        moving = moving[tree["feature"][at[moving]] >= 0]
    return tree["share"][at]


class DeepForest:
    """``top`` finds a row's node in every tree (none: the root), ``nodes`` holds what grows below it."""

    def __init__(self, top, nodes: DataFrame, trees: int, classes: int, features_col: str, prediction_col: str):
        self.top, self.nodes, self.trees, self.classes = top, nodes, trees, classes
        self.features_col, self.prediction_col = features_col, prediction_col

    def transform(self, df: DataFrame) -> DataFrame:
        """Shares averaged over the trees; the most likely class, the smallest of several. Distinct points descend once."""
        classes, own = self.classes, f"_{self.prediction_col}_x"

        def shares(key: tuple, packs: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
            if packs.empty or nodes.empty:
                return pd.DataFrame({"pack": [], "tree": [], "place": [], "x": [], "share": []}, dtype=object)
            tree = {c: np.asarray(nodes[c].iloc[0]) for c in ("feature", "threshold", "left", "share")}
            tree["share"] = tree["share"].reshape(-1, classes)
            found = [descend(tree, x.reshape(len(place), -1)).ravel() for x, place in zip(packs.x, packs.place, strict=True)]
            # The points themselves come back once.
            return pd.DataFrame({"pack": packs.pack, "tree": packs.tree, "place": packs.place, "x": packs.x if key[0] == 0 else None, "share": found})

        def summed(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            given = parts[parts.tree == 0]
            n = sum(map(len, given.place))
            x, share = np.empty((n, sum(map(len, given.x)) // n)), np.zeros((n, classes))
            for place, values in zip(given.place, given.x, strict=True):
                x[place] = values.reshape(len(place), -1)
            # Always in the same order.
            for place, values in zip(*(parts.sort_values("tree")[c] for c in ("place", "share")), strict=True):
                share[place] += values.reshape(len(place), -1)
            return pd.DataFrame({own: list(x), "share": list(share)})

        given = df.withColumn(own, vector_to_array(col(self.features_col)))
        points = given.select(F.col(own).alias("x")).distinct()
        # In the same order if a task runs again, as packs are numbered.
        dealt = points.repartition(_tasks(df), "x").sortWithinPartitions("x")
        packs = _packs(self.top, dealt, self.trees, DESCEND_PACK)
        each = packs.groupBy("tree", "root").cogroup(self.nodes.groupBy("tree", "root")).applyInPandas(
            shares, "pack long, tree int, place array<int>, x array<double>, share array<double>"
        )
        scored = each.groupBy("pack").applyInPandas(summed, f"`{own}` array<double>, share array<double>")
        # Rounded, so that the order of summation decides no tie.
        scored = scored.select(own, F.array(*[F.round(F.col("share")[c] / self.trees, 12) for c in range(classes)]).alias("_share"))
        probability, raw = f"{self.prediction_col}_probability", f"{self.prediction_col}_raw"
        best = (F.array_position("_share", F.array_max("_share")) - 1).cast("double")
        return given.join(scored, own).withColumns({
            raw: array_to_vector(F.transform("_share", lambda s: s * self.trees)), probability: array_to_vector("_share"), self.prediction_col: best,
        }).drop(own, "_share")


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _with_leaves(top, points: DataFrame) -> DataFrame:
    """``points`` with their node in every tree (``leaf``)."""
    return top.transform(points.withColumn("_v", array_to_vector("x"))).select(*points.columns, vector_to_array("_leaf").cast("array<int>").alias("leaf"))


def _pack(trees: int, most: int, others: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each tree and node the task's points (``x`` and ``others``), their pack and their places in it, ``most`` points a pack."""
    flat, held, size, number = [], [], 0, 0

    def flushed() -> Iterator[pa.RecordBatch]:
        x, rest = np.concatenate(flat), [np.concatenate([h[i] for h in held]) for i in range(len(others) + 1)]
        leaf, rest = rest[-1], rest[:-1]
        pack = (TaskContext.get().partitionId() << 32) + number
        for tree in range(trees):
            at = leaf[:, tree] if leaf.shape[1] else np.zeros(len(x), "int32")
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
            groups = np.split(order, starts[1:])
            cells = [
                pa.array(np.full(len(groups), pack)), pa.array(np.full(len(groups), tree, "int32")), pa.array(at[order][starts].astype("int32")),
                _lists(groups, 1, order.astype("int32"), pa.int32()), _lists(groups, x.shape[1], x[order].ravel(), pa.float64()),
                *[_lists(groups, 1, r[order], pa.float64()) for r in rest],
            ]
            yield pa.RecordBatch.from_arrays(cells, names=["pack", "tree", "root", "place", "x", *others])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        array = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        flat.append(array["x"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1))
        leaf = array["leaf"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if "leaf" in array else np.empty((n, 0), "int32")
        held.append([*[array[c].to_numpy(zero_copy_only=False).astype("float64") for c in others], leaf])
        size += n
        if size >= most:
            yield from flushed()
            flat, held, size, number = [], [], 0, number + 1
    if size:
        yield from flushed()


def _lists(groups: list[np.ndarray], width: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """``values`` in one list for each group."""
    ends = np.cumsum([0, *map(len, groups)]) * width
    return pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(values, kind))


def _packs(top, points: DataFrame, trees: int, most: int) -> DataFrame:
    """Every row of ``points`` (x and numbers) once for each tree, those of one task, tree and node (none: the root) packed together."""
    others = [c for c in points.columns if c != "x"]
    given = points if top is None else _with_leaves(top, points)
    schema = "pack long, tree int, root int, place array<int>, x array<double>" + "".join(f", {c} array<double>" for c in others)
    return given.mapInArrow(partial(_pack, trees, most, others), schema)


def _largest_node(top, points: DataFrame) -> int:
    """The rows of the fullest node of the trees' upper levels."""
    placed = _with_leaves(top, points.select("x")).select(F.posexplode("leaf").alias("tree", "root"))
    return placed.groupBy("tree", "root").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]


def _upper_levels(points: DataFrame, n: int, trees: int, min_leaf: int, seed: int):
    """A forest of the fewest levels whose nodes hold ``MOST_ROWS`` distinct rows at most (or of Spark's most levels)."""
    if n <= ROWS_PER_GROUP:
        return None
    depth = min(MAX_LEVELS, math.ceil(math.log2(n / ROWS_PER_GROUP)) + 1)
    rows = settle(points.withColumn("_v", array_to_vector("x")))
    while True:
        top = RandomForestClassifier(
            featuresCol="_v", labelCol="y", weightCol="w", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf,
            featureSubsetStrategy="sqrt", seed=seed, leafCol="_leaf", predictionCol="_p", probabilityCol="_q", rawPredictionCol="_r",
        ).fit(rows)
        if _largest_node(top, points) <= MOST_ROWS or depth == MAX_LEVELS:
            return top
        depth = min(MAX_LEVELS, depth + MORE_LEVELS)


def train_deep_forest(
    df: DataFrame, features_col: str = "features", label_col: str = "label", prediction_col: str = "prediction", trees: int = 100,
    min_leaf: int = 1, seed: int = 42,
) -> DeepForest:
    """``trees`` trees on bags of the rows, each node trying the root of the number of features (rounded up).

    Labels are whole numbers from 0. Rows without a label take no part.
    """
    rows = df.where(col(label_col).isNotNull()).select(vector_to_array(col(features_col)).alias("x"), col(label_col).cast("int").alias("y"))
    points = settle(rows.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")))
    facts = points.agg(F.count(F.lit(1)), F.max("y"), F.max(F.size("x"))).first()
    if not facts[0]:
        raise ValueError("no training rows")
    n, classes, inputs = facts[0], facts[1] + 1, facts[2]
    tried = max(1, math.ceil(math.sqrt(inputs)))
    top = _upper_levels(points, n, trees, min_leaf, seed)

    def subtree(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree, root = (int(k) for k in key)
        y, w = (np.concatenate(group[c].to_numpy()) for c in ("y", "w"))
        x, y = np.concatenate(group.x.to_numpy()).reshape(len(y), -1), y.astype("int64")
        order = np.lexsort((y, *x.T))
        x, y, w = x[order], y[order], w[order]
        rng = np.random.default_rng((seed, tree, root))
        bag = rng.poisson(w).astype(float)
        # A small node may draw an empty bag; it then takes its rows as they are.
        made = grow(x, y, bag if bag.any() else w, classes, tried, min_leaf, rng)
        return pd.DataFrame({"tree": [tree], "root": [root], **{c: [made[c].ravel()] for c in ("feature", "threshold", "left", "share")}})

    # Few groups of much work each: dealt to more tasks than their bytes would get.
    dealt = _packs(top, points, trees, GROW_PACK).drop("pack", "place").repartition(max(trees, _tasks(df)), "tree", "root")
    nodes = dealt.groupBy("tree", "root").applyInPandas(subtree, NODES)
    return DeepForest(top, settle(nodes), trees, classes, features_col, prediction_col)


# ---- regression ---------------------------------------------------------------------------------------------------------------


def _bags(trees: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each tree the inputs (``x``) of the task's rows, how often their rows are in its bag and the sum of their labels there.

    Rows come sorted, so equal inputs follow one another."""
    rng = np.random.default_rng((seed, TaskContext.get().partitionId()))
    points, times, sums = [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        y = batch.column(1).to_numpy()
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        drawn = rng.poisson(1.0, (len(y), trees))
        first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(axis=1)])
        points.append(x[first]), times.append(np.add.reduceat(drawn, first)), sums.append(np.add.reduceat(drawn * y[:, None], first))
    if not points:
        return
    x, n, s = (np.concatenate(parts) for parts in (points, times, sums))
    for tree in range(trees):
        held = np.flatnonzero(n[:, tree])
        cells = [[x[held].ravel()], [n[held, tree].astype(float)], [s[held, tree]]]
        yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), *[pa.array(c, pa.list_(pa.float64())) for c in cells]], names=["tree", "x", "n", "s"])


def _cut_values(rows: DataFrame, inputs: int) -> list[np.ndarray]:
    """For each input of ``x`` the values between which trees may cut: all of them if they are few, else quantiles; the largest is the last."""
    x = [F.col("x")[f] for f in range(inputs)]
    probs = [float(p) for p in np.linspace(0, 1, CUTS)]
    found = rows.agg(*[F.percentile_approx(v, probs, 50 * CUTS) for v in x], *[F.approx_count_distinct(v) for v in x], *[F.max(v) for v in x]).first()
    few = [f for f in range(inputs) if found[inputs + f] <= CUTS]
    # No more than about ``CUTS`` values each.
    values = rows.agg(*[F.collect_set(x[f]) for f in few]).first() if few else ()
    cuts = [np.unique(np.array([*found[f], found[2 * inputs + f]], "float64")) for f in range(inputs)]
    for f, each in zip(few, values, strict=True):
        cuts[f] = np.unique(np.array(each, "float64"))
    return cuts


def _thinned(cuts: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the values, evenly spaced, with the last."""
    return cuts if len(cuts) <= most else cuts[np.unique(np.linspace(0, len(cuts) - 1, most).astype("int64"))]


def _raised(cuts: list[np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y) with every value of ``x`` raised to the next cut."""
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        raised = np.column_stack([c[np.minimum(np.searchsorted(c, x[:, f]), len(c) - 1)] for f, c in enumerate(cuts)]) if len(x) else x
        lengths = np.arange(batch.num_rows + 1, dtype="int32") * len(cuts)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(lengths), pa.array(raised.ravel())), batch.column(1)], names=["x", "y"])


def _between_cuts(rows: DataFrame, inputs: int) -> DataFrame | None:
    """``rows`` (x, y) with values raised to as many cuts as leave few enough inputs for a group; None if the fewest leave too many."""
    cuts, width = _cut_values(rows, inputs), CUTS
    while width >= FEWEST_CUTS:
        raised = rows.mapInArrow(partial(_raised, [_thinned(c, width) for c in cuts]), "x array<double>, y double")
        if raised.agg(F.approx_count_distinct("x")).first()[0] <= ROWS_PER_GROUP:
            return raised
        width //= 2
    return None


def grow_means(x: np.ndarray, n: np.ndarray, s: np.ndarray, depth: int, min_leaf: float) -> dict[str, np.ndarray]:
    """A regression tree over inputs with ``n`` rows and label sum ``s``, laid out as by :func:`grow`; ``share`` is a node's mean."""
    cuts, codes = [], []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > CUTS:
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS), method="lower"))
        cuts.append(values), codes.append(np.searchsorted(values, x[:, f]))
    feature, threshold, left, share = [], [], [], []
    rows, node, n_nodes, made = np.arange(len(x)), np.zeros(len(x), "int64"), 1, 1
    while n_nodes:
        total, summed = np.bincount(node, n[rows], n_nodes), np.bincount(node, s[rows], n_nodes)
        # A gain within rounding is none.
        top, best, cut = summed**2 / total * (1 + 1e-12) + 1e-12, np.full(n_nodes, -1), np.zeros(n_nodes)
        for f in range(x.shape[1]) if len(feature) < depth else ():
            width = len(cuts[f])
            if width < 2:
                continue
            at = node * width + codes[f][rows]
            here, there = (np.bincount(at, v[rows], n_nodes * width).reshape(n_nodes, width).cumsum(axis=1)[:, :-1] for v in (n, s))
            rest = total[:, None] - here
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = there**2 / here + (summed[:, None] - there) ** 2 / rest
            gain = np.where((here >= min_leaf) & (rest >= min_leaf), gain, -np.inf)
            place = gain.argmax(axis=1)
            gain = gain[np.arange(n_nodes), place]
            better = gain > top
            top, best, cut = np.where(better, gain, top), np.where(better, f, best), np.where(better, cuts[f][place], cut)
        split = best >= 0
        below = made + 2 * (np.cumsum(split) - 1)
        feature.append(best), threshold.append(cut), left.append(np.where(split, below, -1)), share.append(summed / total)
        goes = split[node]
        rows, node = rows[goes], node[goes]
        right = x[rows, best[node]] > cut[node]
        node, n_nodes = below[node] - made + right, 2 * int(split.sum())
        made += n_nodes
    return {"feature": np.concatenate(feature), "threshold": np.concatenate(threshold), "left": np.concatenate(left), "share": np.concatenate(share)}


class MeanForest:
    """Regression trees of bounded depth; a row's prediction is the mean over them."""

    def __init__(self, trees: list[dict[str, np.ndarray]], mean: float, features_col: str, prediction_col: str):
        self.trees, self.mean, self.features_col, self.prediction_col = trees, mean, features_col, prediction_col

    def transform(self, df: DataFrame) -> DataFrame:
        trees, mean = self.trees, self.mean

        @F.pandas_udf("double")
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for series in batches:
                x = np.stack(series.to_numpy()) if len(series) else np.empty((0, 1))
                # Equal inputs descend once.
                points, of = np.unique(x, axis=0, return_inverse=True)
                yield pd.Series(sum((descend(t, points) for t in trees), np.zeros(len(points)))[of.ravel()] / len(trees) + mean)

        return df.withColumn(self.prediction_col, predict(vector_to_array(col(self.features_col))))


def train_mean_forest(
    df: DataFrame, features_col: str = "features", label_col: str = "label", prediction_col: str = "prediction", trees: int = 100,
    depth: int = 10, min_leaf: int = 1, seed: int = 42,
) -> MeanForest | None:
    """``trees`` regression trees on bags of all rows, each node trying every feature. None if there are more distinct inputs between cuts
    than one group should hold, or more levels than the driver."""
    y = col(label_col).cast("double")
    rows = df.where(y.isNotNull()).select(vector_to_array(col(features_col)).alias("x"), y.alias("y"))
    mean, points, inputs = rows.agg(F.avg("y"), F.approx_count_distinct("x"), F.max(F.size("x"))).first()
    if mean is None:
        raise ValueError("no training rows")
    if depth > MOST_DEPTH:
        return None
    if points > ROWS_PER_GROUP:
        rows = _between_cuts(rows, inputs)
        if rows is None:
            return None
    parts = _tasks(df)
    # Most rows of one input meet, so that their draws are added up at once; a hot input is dealt out.
    dealt = rows.select("x", (F.col("y") - mean).alias("y")).repartition(parts, "x", F.pmod(F.xxhash64("y"), F.lit(SPREAD)))
    cells = dealt.sortWithinPartitions("x", "y").mapInArrow(partial(_bags, trees, seed), "tree int, x array<double>, n array<double>, s array<double>")

    def whole(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n, s = (np.concatenate(group[c].to_numpy()) for c in ("n", "s"))
        made = grow_means(np.concatenate(group.x.to_numpy()).reshape(len(n), -1), n, s, depth, min_leaf)
        return pd.DataFrame({"tree": [int(key[0])], "root": [0], **{c: [made[c]] for c in ("feature", "threshold", "left", "share")}})

    # As many nodes as the depth allows.
    found = cells.groupBy("tree").applyInPandas(whole, NODES).collect()
    names = ("feature", "threshold", "left", "share")
    return MeanForest([{c: np.array(r[c]) for c in names} for r in sorted(found, key=lambda r: r.tree)], mean, features_col, prediction_col)
