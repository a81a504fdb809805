"""Text column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Suffix tokens of generations.
SUFFIXES = "jr|sr|ii|iii|iv|v"


def _accents() -> tuple[str, str]:
    """Latin letters with marks and the letters that they decompose to."""
    found = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    found = [(c, d[0]) for c, d in found if len(d) > 1 and d[0].isascii()]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


def fold_accents(col: Column) -> Column:
    """Latin letters without their marks; combining marks are dropped."""
    marked, plain = _accents()
    return F.regexp_replace(F.translate(col, marked, plain), r"\p{Mn}", "")


def normalize_name_key(col: Column, loose: bool = False) -> Column:
    """ASCII-folded, lower, without a generation suffix at the end, letters only; the loose key drops all but the first and last word.

    Null stays null; text without letters gives the empty string.
    """
    text = F.trim(F.regexp_replace(F.lower(fold_accents(col)), r"[^a-z ]", ""))
    text = F.regexp_replace(text, rf"\s+({SUFFIXES})$", "")
    if loose:
        words = F.split(text, r"\s+")
        text = F.when(F.size(words) > 2, F.concat(words[0], F.element_at(words, -1))).otherwise(text)
    return F.regexp_replace(text, r"\s+", "")


def _jaro_winkler(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, ours = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                ours.append(c)
                break
    if not ours:
        return 0.0
    theirs = [c for c, t in zip(b, taken, strict=True) if t]
    m = len(ours)
    swaps = sum(x != y for x, y in zip(ours, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two short texts in Arrow batches; for pairs that a blocking key has already brought together."""
    return pd.Series([_jaro_winkler(None if pd.isna(x) else x, None if pd.isna(y) else y) for x, y in zip(a, b, strict=True)], dtype="float64")
