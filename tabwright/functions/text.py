"""Text cleaning methods, all as JVM-side column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The punctuation dropped by ``remove_special_chars`` and the words that mean "missing".
SPECIAL_CHARS = "!@#$%^&*()_+=[]{};:'\".,<>?/\\|`~-"
MISSING_MARKERS = ["n/a", "na", "null", "none", "nan", "-", "?", "---", "unknown", "n.a.", "n.a", "n/a."]
NON_WORD = r"(?U)[^\w\s]"


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _squeeze(c: Column) -> Column:
    return F.regexp_replace(c, " +", " ")


def _standardize(c: Column) -> Column:
    return F.lower(_squeeze(strip(c)))


_SPECIAL_CLASS = "[" + "".join(re.escape(ch) for ch in SPECIAL_CHARS) + "]"

TEXT_METHODS: dict[str, Callable[[Column], Column]] = {
    "remove_special_chars": lambda c: strip(F.regexp_replace(c, _SPECIAL_CLASS, "")),
    "trim_whitespace": strip,
    "lowercase": lambda c: strip(F.lower(c)),
    "lowercase_only": F.lower,
    "remove_duplicates_spaces": lambda c: strip(_squeeze(c)),
    "standardize": _standardize,
    "remove_numbers": lambda c: strip(F.regexp_replace(c, "[0-9]", "")),
    "remove_non_word": lambda c: strip(F.regexp_replace(c, NON_WORD, "")),
    "standardize_strict": lambda c: F.regexp_replace(_standardize(c), NON_WORD, ""),
    "keep_marker": lambda c: c,
}


def clean_text(c: Column, method: str = "remove_special_chars") -> Column:
    """Text to text by one of ``TEXT_METHODS``; null stays null."""
    return TEXT_METHODS[method](c.cast("string"))


def markers_to_null(c: Column, substring: bool = False) -> Column:
    """Values that mean "missing" become null.

    ``substring=True`` deletes every marker wherever it occurs, one after the other, and then
    turns blank text into null.
    """
    text = c.cast("string")
    if not substring:
        return F.when(~F.lower(strip(text)).isin(MISSING_MARKERS), text)
    for marker in MISSING_MARKERS:
        text = F.regexp_replace(text, "(?iu)" + re.escape(marker), "")
    return F.when(strip(text) != "", text)
