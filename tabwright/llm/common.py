"""Helpers the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of most contracts: runs without ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: What separates words made of ASCII letters, digits and everything beyond ASCII.
PLAIN_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, UPPER, UPPER.lower())


def spaced_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0))


def count_of(text: Column, characters: str) -> Column:
    """How many code points of ``text`` are among ``characters``."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
