"""Label similarity. Edit distances are built in; the Indel family and word breaks are Arrow-batched UDFs, meant for
distinct strings only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import lexical_normal, sorted_tokens


def normalized_levenshtein(a: Column, b: Column) -> Column:
    """Distance by the longer length; 0 for two empty strings."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / F.nullif(longest, F.lit(0)))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table in the bits of one integer."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 x (1 - insertions and deletions / total length)."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * common_subsequence(a, b) / total


def best_window(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer one, partial windows at the ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    return max(ratio(a, b[max(i, 0) : i + n]) for i in range(1 - n, len(b)))


def _pairwise(f):
    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a, b):
            if pair not in known:
                known[pair] = None if None in pair else f(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return score


indel_ratio = _pairwise(ratio)
partial_indel = _pairwise(best_window)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(sorted_tokens(a), sorted_tokens(b))


def partial_ratio(a: Column, b: Column) -> Column:
    return partial_indel(lexical_normal(a), lexical_normal(b))


def break_words(text: str, vocabulary: frozenset[str], longest: int) -> list[str] | None:
    """Fewest vocabulary words that spell text; None if none do."""
    best: list[tuple[int, int] | None] = [(0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - longest), end):
            if best[begin] and text[begin:end] in vocabulary and (best[end] is None or best[begin][0] + 1 < best[end][0]):
                best[end] = (best[begin][0] + 1, begin)
    if best[-1] is None:
        return None
    out, at = [], len(text)
    while at:
        out.append(text[best[at][1] : at])
        at = best[at][1]
    return out[::-1]


def nearest(word: str, by_length: dict[int, list[str]], reach: int) -> tuple[str, int] | None:
    """Closest vocabulary word within reach edits; ties by length, then vocabulary order."""
    found = None
    for n in range(len(word) - reach, len(word) + reach + 1):
        for candidate in by_length.get(n, ()):
            d = edits(word, candidate, reach)
            if d is not None and (found is None or d < found[1]):
                found = (candidate, d)
                if d <= 1:
                    return found
    return found


def edits(a: str, b: str, reach: int) -> int | None:
    """Levenshtein distance up to reach."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
        if min(row) > reach:
            return None
    return row[-1] if row[-1] <= reach else None
