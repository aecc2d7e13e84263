"""Similarities and information measures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two arrays as sets; ``empty`` is the value of two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def npmi(df_a: Column, df_b: Column, df_ab: Column, n: Column) -> Column:
    """Normalized pointwise mutual information from document counts; 0 where a count is 0."""
    value = F.log((df_ab * n) / (df_a * df_b)) / F.nullif(-F.log(df_ab / n), F.lit(0.0))
    return F.when((df_a > 0) & (df_b > 0) & (df_ab > 0), F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def entropy_term(p: Column, base: float | None = None) -> Column:
    """``-p log p``, to be summed; natural logarithm unless a base is given."""
    return F.when(p > 0, -p * (F.log(p) if base is None else F.log(float(base), p))).otherwise(F.lit(0.0))


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one bit per character of the first text."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask, s = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & mask
    return len(a) - s.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths."""
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs_length(a, b) / total


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer one, cut off at its ends too."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, best = len(a), 0.0
    for start in range(1 - n, len(b)):
        window = b[max(0, start) : start + n]
        if 200.0 * len(window) / (n + len(window)) > best:
            best = max(best, indel_ratio(a, window))
    return best


def indel_column(a: Column, b: Column) -> Column:
    """``indel_ratio`` of two columns, in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([indel_ratio(u or "", v or "") for u, v in zip(x, y, strict=True)])

    return ratio(a, b)


def title_column(a: Column, b: Column, most: int = 50) -> Column:
    """``indel_ratio`` where the first is longer than ``most``, else ``partial_ratio``, in Arrow batches; nulls count as empty."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([(indel_ratio if len(u or "") > most else partial_ratio)(u or "", v or "") for u, v in zip(x, y, strict=True)])

    return ratio(a, b)
