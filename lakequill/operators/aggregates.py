"""Aggregates with the engine's own empty-input and bare-column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def total(x: Column) -> Column:
    """A double; 0.0 over no rows."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def group_concat(x: Column, separator: str = ",", order: list[Column] | None = None) -> Column:
    """Non-null values joined; with `order`, in that order. Null if there is none."""
    if order is None:
        return F.listagg(x.cast("string"), F.lit(separator))
    items = F.filter(F.array_sort(F.collect_list(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], x.cast("string").alias("v")))), lambda i: i["v"].isNotNull())
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda i: i["v"]), separator))


def with_extreme(df: DataFrame, keys: list[str], extreme: str, bare: list[str], largest: bool = True, ties: list[str] | None = None) -> DataFrame:
    """GROUP BY keys with max (or min) of a column and, beside it, columns of the row that has it.

    Of rows that tie, the one with the smallest `ties` (default: the bare columns) counts. For
    numbers, or for min, this is one aggregation whose partial results combine before the shuffle;
    the largest value of another type is joined back, since its order cannot be turned round.
    """
    known = df.where(F.col(extreme).isNotNull())
    row = F.struct(F.col(extreme).alias("x"), *[F.col(c).alias(f"b_{c}") for c in bare])
    tie = [F.col(c).alias(f"t{i}") for i, c in enumerate(ties or bare)]
    if not largest or isinstance(df.schema[extreme].dataType, T.NumericType):
        rank = -F.col(extreme) if largest else F.col(extreme)
        rows = known.groupBy(*keys).agg(F.min_by(row, F.struct(rank.alias("r"), *tie)).alias("_row"))
    else:
        top = known.groupBy(*keys).agg(F.max(extreme).alias("_top"))
        found = known.join(top, keys).where(F.col(extreme) == F.col("_top"))
        rows = found.groupBy(*keys).agg(F.min_by(row, F.struct(*tie)).alias("_row"))
    return rows.select(*keys, F.col("_row.x").alias(extreme), *[F.col(f"_row.b_{c}").alias(c) for c in bare])


def bare_of_max(x: Column, by: Column) -> Column:
    """A bare column's value in a row with the largest `by`; arbitrary among ties."""
    return F.max_by(x, by)


def bare_of_min(x: Column, by: Column) -> Column:
    return F.min_by(x, by)


def filtered(x: Column, condition: Column) -> Column:
    """FILTER (WHERE ...) for any null-skipping aggregate's argument."""
    return F.when(condition, x)
