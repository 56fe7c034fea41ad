"""String to number conversion and the numeric cleaning methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from .text import strip

# The accepted number format, the currency signs and the unit names.
NUMBER_FORMAT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
CURRENCY_SIGNS = "$€¥₹₽"
UNIT_NAMES = ["kg", "g", "lb", "oz", "mph", "km/h", "°C", "°F", "m", "cm", "inch"]


def to_numeric(c: Column) -> Column:
    """Text to double; what is not a plain decimal number becomes null."""
    return F.when(c.rlike(NUMBER_FORMAT), F.trim(c).try_cast("double"))


def as_double(c: Column, dtype: T.DataType) -> Column:
    """Any column as double: text is parsed, numbers are cast, NaN counts as missing."""
    if isinstance(dtype, T.StringType):
        return to_numeric(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    return F.lit(None).cast("double")


def _digits_only(c: Column) -> Column:
    return to_numeric(F.regexp_replace(c, "[^0-9.-]", ""))


def _drop(c: Column, literal: str) -> Column:
    return F.replace(c, F.lit(literal), F.lit(""))


NUMERIC_METHODS: dict[str, Callable[[Column], Column]] = {
    "extract_numbers": _digits_only,
    "remove_currency": lambda c: to_numeric(F.regexp_replace(c, f"[{CURRENCY_SIGNS},]", "")),
    "remove_percentage": lambda c: to_numeric(_drop(c, "%")) / 100,
    # Unit names hold only characters that the digit filter removes too.
    "remove_units": _digits_only,
    "remove_commas": lambda c: to_numeric(_drop(c, ",")),
    "trim_whitespace": lambda c: to_numeric(strip(c)),
    # Stripping and currency removal change nothing that the digit filter keeps.
    "smart_convert": _digits_only,
}


def clean_numeric(c: Column, method: str = "extract_numbers") -> Column:
    """Text to number by one of ``NUMERIC_METHODS``; null stays null.

    The digit filter also erases an exponent: ``1e3`` becomes 13.
    """
    return NUMERIC_METHODS[method](c.cast("string"))
