"""Names of working columns that don't clash with a caller's, and joins on keys that may be null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, with underscores before those that df has already, whatever their case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which null equals null, with the keys of the left side."""
    if not keys:
        return left.crossJoin(right)  # one row
    renamed = free_names(left, *[f"_r_{c}" for c in keys])
    other = right.withColumnsRenamed(dict(zip(keys, renamed, strict=True)))
    same = F.lit(True)
    for c, r in zip(keys, renamed, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(r))
    return left.join(other, same, how).drop(*renamed)
