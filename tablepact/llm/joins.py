"""Joins in which null keys match, without ambiguous names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def match(left: DataFrame, right: DataFrame, keys: dict[str, str] | list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` where the keys (left's name: right's) are equal or both null; right's keys are dropped."""
    keys = keys if isinstance(keys, dict) else {k: k for k in keys}
    right = right.withColumnsRenamed({r: f"__{r}" for r in keys.values()})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"__{r}"]) for k, r in keys.items()])
    return left.join(right, on, how).drop(*[f"__{r}" for r in keys.values()])
