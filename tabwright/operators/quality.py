"""Data-quality profile: sizes, missing cells, duplicates, cleaning issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.numbers import to_numeric
from ..functions.text import NON_WORD, strip
from ..plans.scalars import col, unpivot
from .coltypes import feature_types, numeric_columns, present, string_columns

# Bytes per cell of the fixed-width types, and the methods offered per issue.
CELL_BYTES = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
WIDE_CELL = 8
NUMERIC_FIXES = [
    "extract_numbers", "remove_currency", "remove_percentage", "remove_units", "remove_commas",
    "trim_whitespace", "smart_convert",
]
TEXT_FIXES = [
    "remove_special_chars", "trim_whitespace", "standardize", "remove_duplicates_spaces", "lowercase", "remove_numbers",
]
MAX_EXAMPLES = 10
MAX_CHECKED_VALUES = 50
HEAD = 64  # characters of long text that are compared first


def row_digest(df: DataFrame) -> list[Column]:
    """128 bits of a row as two columns, ``_h0`` and ``_h1``: only they are shuffled, however wide the row. A null leaves a hash as it was,
    so which cells are null goes in by itself."""
    cells = [x for c in df.columns for x in (col(c).isNull(), col(c))]
    return [F.xxhash64(F.lit(i), *cells).alias(f"_h{i}") for i in range(2)]


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier row; nulls equal each other."""
    groups = df.select(*row_digest(df)).groupBy("_h0", "_h1").agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def table_summary(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, estimated bytes, duplicate_rows."""
    fixed = 0
    variable: list[Column] = []
    for field in df.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            variable.append(F.coalesce(F.octet_length(col(field.name)), F.lit(0)))
        else:
            fixed += CELL_BYTES.get(field.dataType.simpleString(), WIDE_CELL)
    text = F.coalesce(F.sum(sum(variable, F.lit(0)).cast("bigint")), F.lit(0)) if variable else F.lit(0)
    sizes = df.agg(F.count(F.lit(1)).alias("n_rows"), text.alias("_text"))
    return sizes.select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        (F.col("n_rows") * fixed + F.col("_text")).alias("bytes"),
        duplicate_count(df).scalar().alias("duplicate_rows"),
    )


def missing_report(df: DataFrame) -> DataFrame:
    """(column, missing, missing_pct, dtype) of the columns with missing cells, worst first."""
    n = F.count(F.lit(1))
    rows = []
    for field in df.schema:
        missing = F.count_if(~present(df, field.name))
        rows.append(
            F.struct(
                F.lit(field.name).alias("column"),
                missing.alias("missing"),
                F.round(missing / n * 100, 2).alias("missing_pct"),
                F.lit(field.dataType.simpleString()).alias("dtype"),
            )
        )
    report = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return report.where("missing > 0").orderBy(F.desc("missing_pct"), "column")


def missing_totals(df: DataFrame) -> DataFrame:
    """One row: missing cells in numeric, string and all columns."""

    def total(names: list[str]) -> Column:
        per_row = sum([(~present(df, c)).cast("bigint") for c in names], F.lit(0).cast("bigint"))
        return F.coalesce(F.sum(per_row), F.lit(0))

    return df.agg(
        total(numeric_columns(df)).alias("numeric_missing"),
        total(string_columns(df)).alias("string_missing"),
        total(df.columns).alias("all_missing"),
    )


def _smallest(values: DataFrame, value: str) -> DataFrame:
    """(column, value, place): the ten smallest distinct values of each column.

    The rank filter keeps ten rows per column and task before its shuffle.
    """
    place = F.row_number().over(W.partitionBy("column").orderBy(value))
    return values.select("column", value).distinct().select("column", value, place.alias("_place")).where(F.col("_place") <= MAX_EXAMPLES)


def _issue_report(df: DataFrame, names: list[str], bad: Column, long_text: bool = False) -> DataFrame:
    """Count, share and up to ten examples of the string cells for which ``bad`` (over ``value``) holds.

    Of ``long_text`` only the heads are shuffled; they tell which few texts can be among the ten
    smallest, and those alone are compared in full.
    """
    if not names:
        return df.sparkSession.createDataFrame([], "column string, issues bigint, pct double, examples array<string>")
    cells = unpivot(df, names)
    totals = cells.groupBy("column").agg(F.count_if(bad).alias("issues"), F.count(F.lit(1)).alias("_n")).where("issues > 0")
    found = cells.where(bad)
    if long_text:
        head = F.substring("value", 1, HEAD)
        limits = _smallest(found.select("column", head.alias("_head")), "_head").groupBy("column").agg(F.max("_head").alias("_limit"))
        # One row for each column goes to the texts, which would else meet in one task.
        found = found.join(F.broadcast(limits), "column").where(head <= F.col("_limit"))
    examples = _smallest(found, "value").groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("examples"))
    return totals.join(F.broadcast(examples), "column").select(
        "column", "issues", F.round(F.col("issues") / F.col("_n") * 100, 2).alias("pct"), "examples"
    )


def non_numeric_report(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """String columns typed numeric: values that do not parse."""
    kinds = types or feature_types(df.select(*[col(c) for c in string_columns(df)]))
    names = [c for c in string_columns(df) if kinds.get(c) == "numeric"]
    return _issue_report(df, names, F.col("value").isNotNull() & to_numeric(F.col("value")).isNull())


def special_char_report(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Categorical and text columns: values with characters other than word characters and spaces."""
    kinds = types or feature_types(df.select(*[col(c) for c in string_columns(df)]))
    bad = F.col("value").rlike(NON_WORD)
    short, long_ = ([c for c in string_columns(df) if kinds.get(c) == k] for k in ("categorical", "text"))
    return _issue_report(df, short, bad).unionByName(_issue_report(df, long_, bad, long_text=True))


def suggest_cleaning(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """(column, issue, issues, methods): the methods that apply to each found issue."""
    kinds = types or feature_types(df.select(*[col(c) for c in string_columns(df)]))

    def offer(report: DataFrame, issue: str, methods: list[str]) -> DataFrame:
        return report.select("column", F.lit(issue).alias("issue"), "issues", F.lit(methods).alias("methods"))

    return offer(non_numeric_report(df, kinds), "non-numeric", NUMERIC_FIXES).unionByName(
        offer(special_char_report(df, kinds), "special-chars", TEXT_FIXES)
    )


def conversion_loss(df: DataFrame, name: str, cleaned: Column) -> DataFrame:
    """One row: values present before and null after cleaning."""
    return df.agg((F.count_if(cleaned.isNull()) - F.count_if(col(name).isNull())).alias("lost"))


def text_issue_report(df: DataFrame, name: str) -> DataFrame:
    """(issue, status, methods): five checks of a column with at most 50 distinct values.

    ``status`` is ``found``, ``absent`` or, above 50 distinct values, ``skipped``.
    """
    v = F.col("v")
    # Flags need one look per distinct value.
    levels = df.select(col(name).cast("string").alias("v")).where(v.isNotNull()).distinct()
    flags = levels.agg(
        F.count(F.lit(1)).alias("k"),
        F.bool_or(v.rlike("[A-Z]")).alias("upper"),
        F.bool_or(v.rlike("[a-z]")).alias("lower"),
        F.bool_or(v != strip(v)).alias("outer"),
        F.bool_or(v.rlike(" {2,}")).alias("double"),
        F.bool_or(v.rlike(NON_WORD)).alias("special"),
        F.count_distinct(strip(F.lower(v))).alias("normalized"),
    )
    checks = [
        ("Mixed case values", F.col("upper") & F.col("lower"), ["lowercase", "standardize"]),
        ("Leading/trailing whitespace", F.col("outer"), ["trim_whitespace"]),
        ("Multiple consecutive spaces", F.col("double"), ["remove_duplicates_spaces"]),
        ("Special characters in values", F.col("special"), ["remove_special_chars"]),
        (
            "Potential duplicates (different cases/spaces)",
            (F.col("k") > 3) & (F.col("normalized") < F.col("k")),
            ["standardize"],
        ),
    ]
    rows = [
        F.struct(
            F.lit(issue).alias("issue"),
            F.when(F.col("k") > MAX_CHECKED_VALUES, "skipped").when(found, "found").otherwise("absent").alias("status"),
            F.lit(methods).alias("methods"),
        )
        for issue, found, methods in checks
    ]
    return flags.select(F.inline(F.array(*rows)))
