"""Reading and writing tables, previews and the choice between original and cleaned data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..plans.scalars import col

# The text that a CSV reader with default settings takes for "missing".
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def null_tokens(df: DataFrame) -> DataFrame:
    """NA tokens in string columns and NaN in floating columns become null."""

    def fixed(field: T.StructField) -> Column:
        c = col(field.name)
        if isinstance(field.dataType, T.StringType):
            return F.when(~c.isin(NA_TOKENS), c).alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.nanvl(c, F.lit(None).cast(field.dataType)).alias(field.name)
        return c

    return df.select(*[fixed(f) for f in df.schema])


def read_table_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, infer_rate: float = 1.0, multi_line: bool = False
) -> DataFrame:
    """A CSV table with a header; NA tokens become null.

    Without a schema the types come from a pass over the text, or over the share ``infer_rate`` of
    it; pass a schema for large data. ``multi_line`` allows line breaks inside quotes, at the price
    that one task reads a whole file.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if schema is not None:
        return null_tokens(reader.schema(schema).csv(path))
    text = reader.csv(path)
    # Tokens go first: inference would take a column of numbers and N/A for text.
    clean = null_tokens(text)
    return clean.select(*[c.alias(n) for n, c in _infer(clean, infer_rate)])


def _infer(df: DataFrame, rate: float) -> list[tuple[str, Column]]:
    """Per column the narrowest of bigint, double, boolean, timestamp that fits every value."""
    sample = df if rate >= 1 else df.sample(rate, seed=42)
    # What the text of each type looks like.
    tests = {
        "bigint": r"^[+-]?\d{1,18}$",
        "double": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$",
        "boolean": "^(?i)(true|false)$",
        "timestamp_ntz": r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$",
    }
    checks = []
    for i, name in enumerate(df.columns):
        c = F.trim(col(name))
        for kind, pattern in tests.items():
            checks.append((F.bool_and(c.rlike(pattern)) & (F.count(c) > 0)).alias(f"{kind}_{i}"))
    row = sample.agg(*checks).first()
    chosen = []
    for i, name in enumerate(df.columns):
        kind = next((k for k in tests if row[f"{k}_{i}"]), None)
        chosen.append((name, F.trim(col(name)).try_cast(kind) if kind else col(name)))
    return chosen


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Header CSV, one file per partition, quotes doubled, outer spaces kept."""
    writer = df.write.mode(mode).option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def preview(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first n rows in a given order."""
    return df.orderBy(*[col(c) for c in order_by]).limit(n)


def before_after(df: DataFrame, name: str, cleaned: Column, order_by: list[str], n: int = 10) -> DataFrame:
    """(original, cleaned) of the first n rows, from one projection."""
    ordered = df.orderBy(*[col(c) for c in order_by])
    return ordered.select(col(name).alias("original"), cleaned.alias("cleaned")).limit(n)


def choose_dataset(original: DataFrame, cleaned: DataFrame | None, use_cleaned: bool) -> DataFrame:
    """The cleaned table if wanted and present, else the original."""
    return cleaned if use_cleaned and cleaned is not None else original
