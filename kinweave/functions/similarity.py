"""String similarities: scalar kernels for the pair scorers, and columns."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.config import DEFAULT, SimilarityConfig
from kinweave.functions.text import EXTENDED_FOLD, SIMPLE_FOLD

_CACHE = 1 << 16


@functools.lru_cache(maxsize=_CACHE)
def jaro_winkler(a: str, b: str, config: SimilarityConfig = DEFAULT) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, hits = list(b), []
    for i, ch in enumerate(a):
        low = max(0, i - reach)
        at = next((j for j in range(low, min(len(b), i + reach + 1)) if free[j] == ch), None)
        if at is not None:
            free[at] = None
            hits.append((i, at))
    if not hits:
        return 0.0
    other = [b[j] for j in sorted(j for _, j in hits)]
    swapped = sum(a[i] != ch for (i, _), ch in zip(hits, other)) // 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= config.boost_threshold:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + config.prefix_weight * prefix * (1 - jaro)


@functools.lru_cache(maxsize=_CACHE)
def edit_distance(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    # What both begin or end with costs no edit.
    start, stop = 0, len(b)
    while start < stop and a[start] == b[start]:
        start += 1
    while stop > start and a[stop - len(b) - 1] == b[stop - 1]:
        stop -= 1
    a, b = a[start : len(a) - len(b) + stop], b[start:stop]
    row = list(range(len(b) + 1))
    for i, ch in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, other in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (ch != other))
    return row[-1]


def levenshtein_similarity(a: str, b: str, config: SimilarityConfig = DEFAULT) -> float:
    if a == b:
        return 1.0
    short, long = sorted((len(a), len(b)))
    if not short:
        return 0.0
    if config.levenshtein_by == "longer":
        return 1.0 - edit_distance(a, b) / long
    if short / long <= config.min_length_ratio:
        return 0.0
    return 1.0 - min(edit_distance(a, b), short) / short


def _no_marks(text: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", text) if not unicodedata.category(x).startswith("M"))


def _swap(text: str, table: dict[str, str]) -> str:
    for a, b in table.items():
        text = text.replace(a, b)
    return text


_NOT_LETTER = re.compile("[^A-Z0-9]")


@functools.lru_cache(maxsize=_CACHE)
def folded(text: str, keep_special: bool = False) -> str:
    out = _no_marks(_swap(text.upper(), EXTENDED_FOLD))
    return out if keep_special else _NOT_LETTER.sub("", out)


@functools.lru_cache(maxsize=_CACHE)
def foldings(text: str) -> frozenset[str]:
    upper = text.upper()
    return frozenset(_NOT_LETTER.sub("", _no_marks(_swap(upper, table))) for table in ({}, EXTENDED_FOLD, SIMPLE_FOLD))


def fold_equal(a: str | None, b: str | None) -> bool:
    if a is None or b is None:
        return a is b
    return not foldings(a).isdisjoint(foldings(b))


def likely_abbreviation(a: str | None, b: str | None) -> bool:
    """Whether the shorter starts as the longer does and is spelled by letters of it in order."""
    if not a or not b or len(a) == len(b):
        return False
    short, long = sorted((a.lower(), b.lower()), key=len)
    rest = iter(long)
    return short[0] == long[0] and all(ch in rest for ch in short)


def strict_fuzzy(a: str | None, b: str | None, threshold: float = 0.94) -> bool:
    if fold_equal(a, b):
        return True
    if a is None or b is None:
        return False
    x, y = folded(a), folded(b)
    return min(len(x), len(y)) >= 4 and jaro_winkler(x, y) >= threshold


def levenshtein_similarity_column(a: Column, b: Column, config: SimilarityConfig = DEFAULT) -> Column:
    """levenshtein_similarity() in the JVM."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    distance = F.levenshtein(a, b)
    if config.levenshtein_by == "longer":
        return F.when(a == b, 1.0).when(short == 0, 0.0).otherwise(1.0 - distance / long)
    return F.when(a == b, 1.0).when((short == 0) | (short / long <= config.min_length_ratio), 0.0).otherwise(1.0 - F.least(distance, short) / short)


def pair_udf(kernel, kind: str):
    """An Arrow-batched function of two or more string columns from a scalar kernel; null if any input is.

    Non-deterministic for Catalyst, so that a filter on the result doesn't evaluate it a second time.
    """

    @F.pandas_udf(kind)
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else kernel(*row) for row in zip(*columns)], dtype=object)

    return score.asNondeterministic()


def jaro_winkler_column(a: Column, b: Column) -> Column:
    return pair_udf(jaro_winkler, "double")(a, b)


def likely_abbreviation_column(a: Column, b: Column) -> Column:
    return pair_udf(likely_abbreviation, "boolean")(a, b)


def strict_fuzzy_column(a: Column, b: Column) -> Column:
    return pair_udf(strict_fuzzy, "boolean")(a, b)
