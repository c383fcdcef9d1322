"""Joins that keep rows whose key is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` where null equals null; columns of ``left``, then the others of ``right``."""
    if not on:
        return left.join(right, how=how)
    other = right.withColumnsRenamed({c: f"_of_{c}" for c in on})
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_of_{c}")), on[1:], F.col(on[0]).eqNullSafe(F.col(f"_of_{on[0]}")))
    return left.join(other, same, how).drop(*[f"_of_{c}" for c in on])
