"""Compound selects: left-associative chains with equal precedence, and their limits."""

from __future__ import annotations

from pyspark.sql import DataFrame

_STEPS = {
    "union all": lambda a, b: a.unionAll(b),
    "union": lambda a, b: a.unionAll(b).distinct(),
    "intersect": lambda a, b: a.intersect(b),
    "except": lambda a, b: a.subtract(b),
}


def compound(first: DataFrame, *arms: tuple[str, DataFrame]) -> DataFrame:
    """first OP arm OP arm ..., applied from the left; arms take the names of the first."""
    out = first
    for op, arm in arms:
        if len(arm.columns) != len(out.columns):
            raise ValueError(f"SELECTs to the left and right of {op.upper()} do not have the same number of result columns")
        out = _STEPS[op.lower()](out, arm.toDF(*first.columns))
    return out


def limited(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """LIMIT and OFFSET: a negative limit is none, a negative offset is 0, limit 0 reads nothing."""
    if offset > 0:
        df = df.offset(offset)
    return df if limit < 0 else df.limit(limit)
