"""Token-based string similarity on pairs, batch by batch (no built-in expression has it)."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=200_000)
def indel_ratio(a: str, b: str) -> float:
    """2 x longest common subsequence / total length; 1 for two empty strings."""
    if not a and not b:
        return 1.0
    if a == b:
        return 1.0
    # bit-parallel longest common subsequence: one machine-word row per character of b
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """1 if one token set contains the other; 0 if either is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 1.0
    sect, dx, dy = " ".join(both), " ".join(only_x), " ".join(only_y)
    if not sect:
        return indel_ratio(dx, dy)
    lx, ly = len(sect) + 1 + len(dx), len(sect) + 1 + len(dy)
    # the common prefix counts as matched in full
    shared = len(sect) + 1 + (len(dx) + len(dy)) * indel_ratio(dx, dy) / 2
    return max(2.0 * shared / (lx + ly), 2.0 * len(sect) / (len(sect) + lx), 2.0 * len(sect) / (len(sect) + ly))


@F.pandas_udf(T.StringType())
def sorted_tokens(a: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else " ".join(sorted(x.split())) for x in a], dtype="object")


def _on_pairs(f):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


token_sort = _on_pairs(token_sort_ratio)
token_set = _on_pairs(token_set_ratio)
