"""String similarity that Spark has no built-in for, as Arrow-batched functions."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def indel_ratio(a: str | None, b: str | None) -> float | None:
    """(len a + len b - distance) / (len a + len b) with insertions and deletions only; 1 for two empty texts."""
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    if not total:
        return 1.0
    # The longest common subsequence by bit rows: bit i of v is clear where row i matched.
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & where.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return 2 * (len(a) - v.bit_count()) / total


def sequence_ratio(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else SequenceMatcher(None, a, b).ratio()


def _pairwise(f):
    """An Arrow-batched function of two text columns; made when it is used, for workers import this module without a session."""

    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(ratios, T.DoubleType())


def indel_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _pairwise(indel_ratio)(a, b)


def sequence_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _pairwise(sequence_ratio)(a, b)


def near_substring(text: str | None, marker: str, least: int = 8) -> bool:
    """Does the text, reduced to a-z and 0-9, hold the marker with at most one letter replaced?  Short markers must match exactly."""
    bare = "".join(ch for ch in (text or "").lower() if ch.isascii() and ch.isalnum())
    if marker in bare:
        return True
    n = len(marker)
    return n >= least and any(sum(x != y for x, y in zip(bare[i : i + n], marker, strict=True)) <= 1 for i in range(len(bare) - n + 1))


def holds_near(text: Column, marker: str, least: int = 8) -> Column:
    """``near_substring`` of a column, in the JVM: each letter of the marker in turn may be any; a null text holds nothing."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")
    if len(marker) < least:
        return bare.contains(marker)
    return bare.rlike("|".join(f"{re.escape(marker[:k])}.{re.escape(marker[k + 1:])}" for k in range(len(marker))))
