"""Column kinds: detection of the analysis type, coercion, category codes, defaults."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numbers import NUMBER_FORMAT, as_double, to_numeric
from ..plans.ranks import number_in_order
from ..plans.scalars import col, unpivot
from ..session import settle

# The date formats tried, and the thresholds of the type decision.
DATE_FORMATS = [
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy", "MM-dd-yyyy", "dd-MM-yyyy", "dd.MM.yyyy",
    "MMM d, yyyy", "d MMM yyyy", "MMMM d, yyyy", "d MMMM yyyy",
]
NUMERIC_SHARE = 0.9
DATE_SHARE = 0.8
CONTINUOUS_ABOVE = 30
CATEGORIES_UP_TO = 20
#: Levels whose codes are sent to all tasks; beyond, rows and codes are shuffled.
SENT_LEVELS = 100_000
CATEGORY_RATIO = 0.5
LONG_TEXT = 64


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_scalar(dtype: T.DataType) -> bool:
    return is_numeric(dtype) or is_string(dtype) or is_temporal(dtype) or isinstance(dtype, T.BooleanType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_string(f.dataType)]


def present(df: DataFrame, name: str) -> Column:
    """True where the cell holds a value; NaN counts as missing."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def coerce_all_numeric(df: DataFrame) -> DataFrame:
    """Parse every string column as numbers and keep the numeric columns, as doubles."""
    kept = [f for f in df.schema if is_numeric(f.dataType) or is_string(f.dataType)]
    return df.select(*[as_double(col(f.name), f.dataType).alias(f.name) for f in kept])


def _cell_counts(df: DataFrame) -> list[tuple[T.DataType, DataFrame]]:
    """Per column type: (column, value, cnt) of the distinct non-missing values.

    Each branch scans only its own columns and keeps their type. Long text is neither number nor
    date, so its digest stands for it in the shuffle.
    """
    groups: dict[str, list[T.StructField]] = {}
    for field in df.schema:
        if is_scalar(field.dataType):
            groups.setdefault(field.dataType.simpleString(), []).append(field)
    frames = []
    for fields in groups.values():
        dtype = fields[0].dataType
        cells = unpivot(df, [f.name for f in fields])
        value = F.col("value")
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            value = F.nanvl(value, F.lit(None).cast(dtype))
        if is_string(dtype):
            short = (F.length(value) <= LONG_TEXT) | value.rlike(NUMBER_FORMAT)
            value = F.when(short, value).otherwise(F.concat(F.lit("\u0000"), F.md5(value)))
        cells = cells.select("column", value.alias("value")).where(F.col("value").isNotNull())
        frames.append((dtype, cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))))
    return frames


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _all_columns(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema) if is_scalar(f.dataType)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def _shape(date_format: str) -> str:
    """A pattern for the texts that a date format can match at all."""
    letters = {"yyyy": "[0-9]{4}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]+", "MM": "[0-9]{2}", "dd": "[0-9]{2}", "d": "[0-9]{1,2}"}
    letters |= {"HH": "[0-9]{2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}", "'T'": "T", ".": "[.]"}
    parts = re.split("(" + "|".join(re.escape(k) for k in letters) + ")", date_format)
    return "^" + "".join(letters.get(part, part) for part in parts) + "$"


def _parses(value: Column, date_format: str) -> Column:
    """True where the text parses; the pattern spares the parser texts that must fail."""
    return F.when(value.rlike(_shape(date_format)), F.try_to_timestamp(value, F.lit(date_format)).isNotNull()).otherwise(False)


def _date_rate(value: Column) -> list[Column]:
    """Number of values that parse, for each format."""
    return [F.sum(F.when(_parses(value, f), F.col("cnt")).otherwise(0)) for f in DATE_FORMATS]


def to_timestamp_rate(df: DataFrame, name: str) -> DataFrame:
    """One row: the best single format and the share of non-null values that it parses."""
    value = col(name).cast("string")
    n = F.count(value)
    shares = [
        F.struct(
            (F.count_if(_parses(value, f)) / n).alias("rate"),
            F.lit(-i).alias("order"),
            F.lit(f).alias("format"),
        )
        for i, f in enumerate(DATE_FORMATS)
    ]
    best = df.where(value.isNotNull()).agg(F.count(value).alias("n"), F.greatest(*shares).alias("best"))
    return best.select("n", F.col("best.format").alias("format"), F.col("best.rate").alias("rate"))


def detect_feature_types(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, n, n_numeric, n_unique, unique_ratio, feature_type) for every scalar column.

    ``approximate=True`` replaces the exact distinct counts by sketches: one pass, no shuffle of values.
    """
    facts = _approximate_facts(df) if approximate else _exact_facts(df)
    n = F.col("n")
    k = F.col("n_numbers")
    sequence = F.col("integral") & (
        ((F.col("low") == 0) & (F.col("high") == k - 1)) | ((F.col("low") == 1) & (F.col("high") == k))
    )
    unique = F.col("n_unique")
    kind = (
        F.when(n == 0, "unknown")
        .when(F.col("temporal"), "date")
        .when(
            F.col("n_numeric") / n > NUMERIC_SHARE,
            F.when(unique > CONTINUOUS_ABOVE, "numeric")
            .when(sequence | (unique <= CATEGORIES_UP_TO), "categorical")
            .otherwise("numeric"),
        )
        .when(F.col("n_date") / n > DATE_SHARE, "date")
        .when((unique <= CATEGORIES_UP_TO) | (unique / n < CATEGORY_RATIO), "categorical")
        .otherwise("text")
    )
    return (
        _all_columns(df)
        .join(facts, "column", "left")
        .na.fill(0, ["n", "n_numeric", "n_unique", "n_numbers", "n_date"])
        .orderBy("position")
        .select(
            "column", "n", "n_numeric", "n_unique",
            F.when(n > 0, unique / n).alias("unique_ratio"),
            kind.alias("feature_type"),
        )
    )


def _exact_facts(df: DataFrame) -> DataFrame:
    parts = []
    for dtype, counts in _cell_counts(df):
        dated = F.lit(0).cast("bigint")
        if is_string(dtype):
            counts = counts.withColumn("number", to_numeric(F.col("value")))
            dated = F.greatest(*_date_rate(F.col("value")))
        elif is_temporal(dtype):
            counts = counts.withColumn("number", F.lit(None).cast("double"))
        else:
            counts = counts.withColumn("number", F.col("value").cast("double"))
        number = F.col("number")
        parts.append(
            counts.groupBy("column").agg(
                F.sum("cnt").alias("n"),
                F.sum(F.when(number.isNotNull(), F.col("cnt")).otherwise(0)).alias("n_numeric"),
                F.count(F.lit(1)).alias("n_unique"),
                F.count_distinct(number).alias("n_numbers"),
                F.coalesce(F.bool_and((number == F.floor(number)) & (F.abs(number) < float("inf"))), F.lit(False)).alias("integral"),
                F.min(number).alias("low"),
                F.max(number).alias("high"),
                dated.alias("n_date"),
                F.lit(is_temporal(dtype)).alias("temporal"),
            )
        )
    return _union(parts)


def _approximate_facts(df: DataFrame) -> DataFrame:
    rows = []
    for field in df.schema:
        if not is_scalar(field.dataType):
            continue
        c, dtype = F.when(present(df, field.name), col(field.name)), field.dataType
        number = c.cast("double") if isinstance(dtype, T.BooleanType) else as_double(c, dtype)
        dated = F.lit(0).cast("bigint")
        if is_string(dtype):
            dated = F.greatest(*[F.count_if(_parses(c, f)) for f in DATE_FORMATS])
        rows.append(
            F.struct(
                F.lit(field.name).alias("column"),
                F.count(c).alias("n"),
                F.count(number).alias("n_numeric"),
                F.approx_count_distinct(c, 0.02).alias("n_unique"),
                F.approx_count_distinct(number, 0.02).alias("n_numbers"),
                F.coalesce(F.bool_and(number == F.floor(number)), F.lit(False)).alias("integral"),
                F.min(number).alias("low"),
                F.max(number).alias("high"),
                dated.alias("n_date"),
                F.lit(is_temporal(dtype)).alias("temporal"),
            )
        )
    return df.agg(F.array(*rows).alias("facts")).select(F.inline("facts"))


def feature_types(df: DataFrame) -> dict[str, str]:
    """Column name to feature type; one small row per column reaches the driver."""
    return {r["column"]: r["feature_type"] for r in detect_feature_types(df).collect()}


def dtype_report(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null, n_unique)."""
    facts = _union(
        [
            counts.groupBy("column").agg(F.sum("cnt").alias("non_null"), F.count(F.lit(1)).alias("n_unique"))
            for _, counts in _cell_counts(df)
        ]
    )
    return (
        _all_columns(df)
        .join(facts, "column", "left")
        .na.fill(0, ["non_null", "n_unique"])
        .orderBy("position")
        .select("column", "dtype", "non_null", "n_unique")
    )


def factorize(df: DataFrame, name: str, order_by: list[str], code: str = "code") -> DataFrame:
    """Add codes 0..k-1 in order of first appearance; null becomes -1."""
    first = (
        df.where(col(name).isNotNull())
        .groupBy(col(name).alias("_level"))
        .agg(F.min(F.struct(*[col(c).alias(f"o{i}") for i, c in enumerate(order_by)])).alias("_first"))
        .select("_level", *[F.col(f"_first.o{i}").alias(f"_o{i}") for i in range(len(order_by))])
    )
    codes = settle(number_in_order(first, [f"_o{i}" for i in range(len(order_by))], "_code").select("_level", "_code"))
    # A few levels go to the rows, which would else meet in one task for each level.
    if codes.count() <= SENT_LEVELS:
        codes = F.broadcast(codes)
    joined = df.join(codes, col(name) == F.col("_level"), "left")
    return joined.select(*[col(c) for c in df.columns], F.coalesce(F.col("_code"), F.lit(-1)).cast("bigint").alias(code))


def default_target(columns: list[str]) -> str:
    """``target`` if present, else a column of that name in other case, else the first column."""
    if "target" in columns:
        return "target"
    return next((c for c in columns if c.lower() == "target"), columns[0])


def suggest_problem_type(df: DataFrame, target: str) -> DataFrame:
    """One row: (target, n_unique, problem_type)."""
    return df.where(present(df, target)).agg(F.count_distinct(col(target)).alias("n_unique")).select(
        F.lit(target).alias("target"),
        "n_unique",
        F.when(F.col("n_unique") <= CATEGORIES_UP_TO, "Classification").otherwise("Regression").alias("problem_type"),
    )
