"""Scalar functions on names, shares and texts, as column expressions where built-ins suffice."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def jurisdiction(c: Column) -> Column:
    """Two-letter country of a code such as ``us-de``; null if there is none."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(c)), r"^([A-Z]{2})(\s*-.*)?$", 1), F.lit(""))


#: A share in figures: a sign and a number, or two numbers with a dash.
_SHARE = r"^([<>≤≥~]?)[\t\n\f\r ]*(\d+(?:\.\d+)?)(?:[\t\n\f\r ]*[-–][\t\n\f\r ]*(\d+(?:\.\d+)?))?$"


def share_range(c: Column) -> Column:
    """A share as text, read as a struct of pct, low, high and bounds; all null if unreadable.

    ``50``, ``50%``, ``12,5`` and ``~50`` are points; ``25-50`` is closed on both ends, ``<10`` is
    open on both, ``≤10`` and ``>50`` are open below, ``≥50`` is closed.  ``pct`` is there for points only.
    Shares outside (0, 100], reversed ranges and open ranges of no width are unreadable.
    """
    text = F.trim(F.replace(F.replace(c, F.lit("%"), F.lit("")), F.lit(","), F.lit(".")))
    sign, one, two = (F.regexp_extract(text, _SHARE, i) for i in (1, 2, 3))
    first, second = (F.when(x != "", x.try_cast("decimal(9,4)")) for x in (one, two))
    pair = two != ""
    low = F.when(pair, first).when(sign.isin("<", "≤"), F.lit(0).cast("decimal(9,4)")).otherwise(first)
    high = F.when(pair, second).when(sign.isin(">", "≥"), F.lit(100).cast("decimal(9,4)")).otherwise(first)
    bounds = F.when(pair | ~sign.isin("<", "≤", ">"), "[]").when(sign == "<", "()").otherwise("(]")
    good = ~(pair & (sign != "")) & (high > 0) & (high <= 100) & (low <= high) & ((low < high) | (bounds == "[]"))
    kept = [(low == high, high, "pct"), (F.lit(True), low, "low"), (F.lit(True), high, "high")]
    return F.struct(*(F.when(good & when, value.cast("decimal(7,4)")).alias(name) for when, value, name in kept), F.when(good, bounds).alias("bounds"))


#: A number with a percent sign or word, not within another number.
_PERCENT = r"(?i)(?<![\d.,])(\d{1,3}(?:\.\d{1,6})?)\s*(?:%|per\s?cent\b)"


def percentages(c: Column) -> Column:
    """The percentages above 0 and up to 100 that a text states in figures, in order, to four places."""
    values = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_PERCENT), 1), lambda t: t.cast("decimal(9,6)"))
    return F.transform(F.filter(values, lambda v: (v > 0) & (v <= 100)), lambda v: F.bround(v, 4).cast("decimal(7,4)").cast("string"))


def blocks(c: Column) -> Column:
    """The first four letters of each word of a name, each once."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(c), " "), lambda t: t != ""), lambda t: F.left(t, F.lit(4))))


def fold(name: str) -> str:
    """Compatibility form, case-folded, without combining marks."""
    text = unicodedata.normalize("NFKC", name).casefold()
    return unicodedata.normalize("NFC", "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch)))


def sorted_words_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence of the word-sorted names over their joint length."""
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not x and not y:
        return 1.0
    at: dict[str, int] = {}
    for i, ch in enumerate(x):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for ch in y:
        u = row & at.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    return 2 * (len(x) - row.bit_count()) / (len(x) + len(y))


@F.pandas_udf(StringType())
def folded(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else fold(n))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else sorted_words_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
