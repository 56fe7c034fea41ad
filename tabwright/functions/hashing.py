"""Deterministic draws: a row's key and a seed fix its random number, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DIGITS = 13  # 52 bits, exact in a double


def digest(key: Column, seed: int | str = 42) -> Column:
    """md5 hex text of ``key|seed``."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def digest_prefix(hexed: Column, digits: int) -> Column:
    """The first ``digits`` hex characters as a number."""
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("bigint")


def hash_uniform(key: Column, seed: int | str = 42) -> Column:
    """A number in [0, 1) with 52 random bits."""
    return digest_prefix(digest(key, seed), DIGITS) / F.lit(float(16**DIGITS))
