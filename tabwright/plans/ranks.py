"""Global ranks, prefix sums and exact quantiles without a one-task window.

Rows go to ordered buckets that any task can compute alone. Windows run inside a bucket; only the
bucket totals, a bounded number per group, meet in one place.
"""

from __future__ import annotations

import math
import os
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.hashing import digest
from .scalars import col

MAX_BUCKETS = 16_384
ROWS_PER_BUCKET = 50_000
SKETCH_ACCURACY = 10_000


#: Bytes of a text that make one order number: as many as a double holds exactly.
TEXT_STEP = 6


def text_order_numbers(df: DataFrame, name: str) -> tuple[Column, Column]:
    """Two doubles that sort like the text: its bytes after what all values share, and the bytes after those.

    Texts of one pair need not be equal, but smaller texts never have a larger pair.
    """
    low, high = df.agg(F.min(col(name)), F.max(col(name))).first()
    start = len(os.path.commonprefix([(low or "").encode(), (high or "").encode()]))
    raw = F.encode(col(name), "UTF-8")

    def number(at: int) -> Column:
        return F.conv(F.rpad(F.hex(F.substring(raw, at + 1, TEXT_STEP)), 2 * TEXT_STEP, "0"), 16, 10).cast("double")

    return number(start), number(start + TEXT_STEP)


def as_order_number(df: DataFrame, name: str) -> Column:
    """A double that sorts like the column, for numbers, texts, dates and timestamps."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return text_order_numbers(df, name)[0]
    if isinstance(dtype, T.NumericType):
        return col(name).cast("double")
    if isinstance(dtype, T.BooleanType):
        return col(name).cast("int").cast("double")
    if isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        return F.unix_micros(col(name).cast("timestamp")).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col(name)).cast("double")
    raise TypeError(f"cannot bucket column {name} of type {dtype.simpleString()}: use a number, text, date or timestamp")


def bucket_edges(df: DataFrame, value: Column) -> tuple[list[float], list[float]]:
    """Approximate quantile edges of ``value`` and the values that fill whole buckets alone.

    A count decides how many buckets there are; the edges come from one bounded sketch. They only
    balance the work, results do not depend on them.
    """
    n = df.agg(F.count(value)).first()[0]
    buckets = min(MAX_BUCKETS, math.ceil(n / ROWS_PER_BUCKET))
    if buckets < 2:
        return [], []
    # A value that spans four grid steps fills the buckets between them alone.
    steps = 4 * buckets
    grid = F.expr("array(" + ",".join(f"{i / steps!r}D" for i in range(1, steps)) + ")")
    sketch = df.agg(F.percentile_approx(value, grid, max(SKETCH_ACCURACY, 4 * steps))).first()[0]
    hot = sorted({a for a, b in zip(sketch, sketch[4:]) if a == b})
    edges = set(sketch[3::4])
    edges.update(hot)
    edges.update(math.nextafter(v, math.inf) for v in hot)
    return sorted(edges), hot


def with_bucket(df: DataFrame, value: str, edges: list[float], name: str = "_bucket") -> DataFrame:
    """Add the ordered bucket of a double column; equal values always share a bucket."""
    if not edges:
        return df.withColumn(name, F.lit(0).cast("double"))
    return Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol=value, outputCol=name, handleInvalid="keep").transform(df)


def value_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Distinct values with their counts and positions: (by…, value, cnt, before, total).

    ``before`` is the number of rows of the group with a smaller value. Equal values are counted
    before any shuffle, so a value that fills a third of the table is one row here.
    """
    by = by or []
    keys = [col(b) for b in by]
    clean = df.select(*keys, col(value).cast("double").alias(value)).where(col(value).isNotNull() & ~F.isnan(col(value)))
    edges, _ = bucket_edges(clean, col(value))
    counts = with_bucket(clean.groupBy(*keys, col(value)).agg(F.count(F.lit(1)).alias("cnt")), value, edges)
    inside = W.partitionBy(*keys, "_bucket")
    running = inside.orderBy(col(value)).rowsBetween(W.unboundedPreceding, W.currentRow)
    if not edges:
        whole = W.partitionBy(*keys) if by else W.partitionBy("_bucket")
        return counts.select(
            *keys, col(value), "cnt",
            (F.sum("cnt").over(running) - F.col("cnt")).alias("before"),
            F.sum("cnt").over(whole).alias("total"),
        )
    totals = counts.groupBy(*keys, "_bucket").agg(F.sum("cnt").alias("_in_bucket"))
    group = W.partitionBy(*keys) if by else W.partitionBy(F.lit(0))
    offsets = totals.select(
        *keys, "_bucket",
        (F.sum("_in_bucket").over(group.orderBy("_bucket")) - F.col("_in_bucket")).alias("_offset"),
        F.sum("_in_bucket").over(group).alias("total"),
    )
    return counts.join(offsets, [*by, "_bucket"]).select(
        *keys, col(value), "cnt",
        (F.col("_offset") + F.sum("cnt").over(running) - F.col("cnt")).alias("before"),
        "total",
    )


def number_rows(df: DataFrame, key: str, by: list[str] | None = None, seed: int | str = 42, digits: int = 4) -> DataFrame:
    """Add ``_row`` (0, 1, … in hash order of the unique ``key``) and ``_rows``, per group of ``by``.

    ``16**digits`` hash buckets hold the rows evenly, even where one group holds most of them.
    """
    by = by or []
    keys = [col(b) for b in by]
    # Hex text sorts like its number.
    hashed = df.withColumn("_digest", digest(col(key), seed)).withColumn("_bucket", F.substring("_digest", 1, digits))
    totals = hashed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_in_bucket"))
    group = W.partitionBy(*keys) if by else W.partitionBy(F.lit(0))
    offsets = totals.select(
        *[k.alias(f"_by{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        (F.sum("_in_bucket").over(group.orderBy("_bucket")) - F.col("_in_bucket")).alias("_offset"),
        F.sum("_in_bucket").over(group).alias("_rows"),
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy("_digest", col(key))
    numbered = hashed.withColumn("_local", F.row_number().over(inside) - 1)
    same = [F.col(f"_by{i}").eqNullSafe(k) for i, k in enumerate(keys)]
    condition = reduce(lambda a, b: a & b, same, F.col("_b") == F.col("_bucket"))
    return numbered.join(offsets, condition).select(
        *[col(c) for c in df.columns], (F.col("_offset") + F.col("_local")).alias("_row"), "_rows"
    )


def exact_quantiles(
    df: DataFrame, cols: list[str], probs: list[float], small: int = 3_000_000, gather: int = 20_000
) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles of double columns, as ``{column: [value per prob]}``.

    Up to ``small`` values in all columns together take one aggregate. Beyond that a sketch brackets every
    wanted rank, a counting pass narrows the bracket, and only the few values left inside are
    sorted. No pass shuffles rows; each shrinks the brackets by about the sketch accuracy.
    """
    row = df.agg(*[F.count(col(c)) for c in cols]).first()
    sizes = dict(zip(cols, row))
    if sum(sizes.values()) <= small:
        values = df.agg(*[F.percentile(col(c), F.array(*[F.lit(p) for p in probs])) for c in cols]).first()
        return {c: list(v) if v is not None else [None] * len(probs) for c, v in zip(cols, values)}
    wanted = {
        c: sorted({f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)}) for c, n in sizes.items() if n
    }
    found = _select_ranks(df, wanted, sizes, gather)
    result: dict[str, list[float | None]] = {}
    for c in cols:
        if not sizes[c]:
            result[c] = [None] * len(probs)
            continue
        spots = [p * (sizes[c] - 1) for p in probs]
        result[c] = [
            found[c, math.floor(s)] + (s - math.floor(s)) * (found[c, math.ceil(s)] - found[c, math.floor(s)])
            for s in spots
        ]
    return result


def _select_ranks(df: DataFrame, wanted: dict, sizes: dict, gather: int) -> dict:
    """The values at 0-based ranks, by narrowing open intervals (low, high) around each rank."""
    found: dict = {}
    # (column, rank) -> [low, high, rows at or below low, rows strictly inside]
    open_ = {(c, r): [-math.inf, math.inf, 0, sizes[c]] for c, ranks in wanted.items() for r in ranks}

    def within(c: str, low: float, high: float) -> Column:
        inside = col(c).isNotNull()
        if low > -math.inf:
            inside = inside & (col(c) > low)
        if high < math.inf:
            inside = inside & (col(c) < high)
        return inside

    slack = 4 / SKETCH_ACCURACY
    while any(b[3] > gather for b in open_.values()):
        wide = [k for k, b in open_.items() if b[3] > gather]
        sketches = []
        for c, r in wide:
            low, high, below, inside = open_[c, r]
            at = (r - below + 0.5) / inside
            around = [max(0.0, at - slack), min(1.0, at + slack)]
            sketches.append(F.percentile_approx(F.when(within(c, low, high), col(c)), around, SKETCH_ACCURACY))
        guesses = df.agg(*sketches).first()
        counts = []
        for (c, _), (a, b) in zip(wide, guesses):
            counts += [
                F.count_if(col(c) < a), F.count_if(col(c) == a), F.count_if((col(c) > a) & (col(c) < b)), F.count_if(col(c) == b)
            ]
        tallies = list(df.agg(*counts).first())
        progress = False
        for i, (k, (a, b)) in enumerate(zip(wide, guesses)):
            r, low, high = k[1], *open_[k][:2]
            under, at_a, between, at_b = tallies[4 * i : 4 * i + 4]
            before = open_[k][3]
            if under <= r < under + at_a:
                found[k] = a
            elif a != b and under + at_a + between <= r < under + at_a + between + at_b:
                found[k] = b
            elif r < under:
                open_[k] = [low, a, open_[k][2], under - open_[k][2]]
            elif r < under + at_a + between:
                open_[k] = [a, b, under + at_a, between]
            else:
                upto = under + at_a + (between + at_b if a != b else 0)
                open_[k] = [b, high, upto, open_[k][2] + before - upto]
            progress = progress or k in found or open_[k][3] < before
        open_ = {k: b for k, b in open_.items() if k not in found}
        slack = slack if progress else slack * 4
    if open_:
        brackets = list(open_.items())
        member = F.array_compact(
            F.array(*[F.when(within(c, b[0], b[1]), F.struct(F.lit(i).alias("i"), col(c).alias("v"))) for i, ((c, _), b) in enumerate(brackets)])
        )
        rows = df.select(F.explode(member).alias("m")).groupBy("m.i", "m.v").count().orderBy("i", "v").collect()
        for i, (k, b) in enumerate(brackets):
            seen = b[2]
            for row in (x for x in rows if x.i == i):
                seen += row["count"]
                if k[1] < seen:
                    found[k] = row.v
                    break
    return found


def order_buckets(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Add ``_bucket`` (a pair) that rises with ``order_by``.

    A first order value held by very many rows gets buckets of its own over the second order column, and a start that very many
    texts share over the bytes that follow it.
    """
    text = isinstance(df.schema[order_by[0]].dataType, T.StringType)
    first, deeper = text_order_numbers(df, order_by[0]) if text else (as_order_number(df, order_by[0]), None)
    edges, hot = bucket_edges(df, first)
    staged = with_bucket(df.withColumn("_first", first), "_first", edges, "_b1")
    second = F.lit(0.0)
    if hot and (text or len(order_by) > 1):
        number = deeper if text else as_order_number(df, order_by[1])
        fine, _ = bucket_edges(df.where(first.isin(hot)), number)
        staged = with_bucket(staged.withColumn("_second", number), "_second", fine, "_b2")
        second = F.when(F.col("_first").isin(hot), F.col("_b2")).otherwise(0.0)
    return staged.withColumn("_bucket", F.struct(F.col("_b1").alias("a"), second.alias("b"))).select(
        *[col(c) for c in df.columns], "_bucket"
    )


def number_in_order(df: DataFrame, order_by: list[str], name: str = "_row") -> DataFrame:
    """Add 0, 1, … in the order of ``order_by`` (numbers, texts, dates or timestamps; together unique)."""
    staged = order_buckets(df, order_by)
    totals = staged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_in_bucket"))
    offsets = totals.select(
        "_bucket", (F.sum("_in_bucket").over(W.partitionBy(F.lit(0)).orderBy("_bucket")) - F.col("_in_bucket")).alias("_offset")
    )
    inside = W.partitionBy("_bucket").orderBy(*[col(c) for c in order_by])
    return staged.withColumn("_local", F.row_number().over(inside) - 1).join(offsets, "_bucket").select(
        *[col(c) for c in df.columns], (F.col("_offset") + F.col("_local")).alias(name)
    )
