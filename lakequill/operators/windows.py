"""Window frames and functions that Spark's window clause does not take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNBOUNDED_BEFORE, UNBOUNDED_AFTER = Window.unboundedPreceding, Window.unboundedFollowing


def groups_frame(df: DataFrame, partition: list[str], order: list[Column], low: int, high: int, aggregates: dict[str, Column]) -> DataFrame:
    """GROUPS BETWEEN: the frame counts peer groups. A dense rank makes it a RANGE frame over one whole number."""
    names = df.columns
    ranked = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    frame = Window.partitionBy(*partition).orderBy("_group").rangeBetween(low, high)
    return ranked.select(*names, *[a.over(frame).alias(n) for n, a in aggregates.items()])


def excluding(
    df: DataFrame,
    partition: list[str],
    order: list[Column],
    value: Column,
    fold: Callable[[Column], Column],
    exclude: str,
    name: str,
    low: int = UNBOUNDED_BEFORE,
    high: int = UNBOUNDED_AFTER,
    mode: str = "rows",
) -> DataFrame:
    """An aggregate over a frame without the current row, its peer group or its ties.

    `fold` maps the array of the remaining values to the result. The frame is gathered for each
    row, so this costs the frame's length per row; sums and counts have `excluding_sum`.
    """
    by = Window.partitionBy(*partition).orderBy(*order)
    frame = by.rowsBetween(low, high) if mode == "rows" else by.rangeBetween(low, high)
    held = df.withColumns({"_n": F.row_number().over(by), "_peer": F.rank().over(by)})
    held = held.withColumn("_frame", F.collect_list(F.struct(F.col("_n").alias("n"), F.col("_peer").alias("p"), value.alias("v"))).over(frame))
    keep = {
        "no others": lambda i: F.lit(True),
        "current row": lambda i: i["n"] != F.col("_n"),
        "group": lambda i: i["p"] != F.col("_peer"),
        "ties": lambda i: (i["p"] != F.col("_peer")) | (i["n"] == F.col("_n")),
    }[exclude]
    left = F.transform(F.filter("_frame", keep), lambda i: i["v"])
    return held.select(*df.columns, fold(left).alias(name))


def excluding_sum(df: DataFrame, partition: list[str], order: list[Column], value: Column, exclude: str, name: str) -> DataFrame:
    """Sum over the whole partition with an exclusion, by subtraction: one window pass, linear."""
    whole, peers = Window.partitionBy(*partition), Window.partitionBy(*partition, *order)
    x = F.coalesce(value, F.lit(0))
    out = {
        "no others": F.sum(x).over(whole),
        "current row": F.sum(x).over(whole) - x,
        "group": F.sum(x).over(whole) - F.sum(x).over(peers),
        "ties": F.sum(x).over(whole) - F.sum(x).over(peers) + x,
    }[exclude]
    n = F.count(value)
    left = {
        "no others": n.over(whole),
        "current row": n.over(whole) - value.isNotNull().cast("int"),
        "group": n.over(whole) - n.over(peers),
        "ties": n.over(whole) - n.over(peers) + value.isNotNull().cast("int"),
    }[exclude]
    return df.select(*df.columns, F.when(left > 0, out).alias(name))


def filtered_over(aggregate: Callable[[Column], Column], x: Column, condition: Column, window) -> Column:
    """agg(x) FILTER (WHERE condition) OVER window."""
    return aggregate(F.when(condition, x)).over(window)


def lag_by(df: DataFrame, partition: list[str], order: list[Column], value: str, offset: Column, name: str, default: Column | None = None) -> DataFrame:
    """lag with an offset that may differ from row to row (negative: lead): an equi-join on row numbers."""
    names = df.columns
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    rows = df.withColumn("_n", n).withColumn("_want", F.col("_n") - offset)
    # the row numbers are read twice from one plan; the exchange below them is shared
    source = rows.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(partition)], F.col("_n").alias("_at"), F.col(value).alias("_value"))
    same = F.col("_want") == F.col("_at")
    for i, p in enumerate(partition):
        same = same & F.col(p).eqNullSafe(F.col(f"_p{i}"))
    found = rows.join(source, same, "left")
    out = F.col("_value") if default is None else F.when(F.col("_at").isNull(), default).otherwise(F.col("_value"))
    return found.select(*names, out.alias(name))


def nth_by(df: DataFrame, partition: list[str], order: list[Column], value: str, n: Column, name: str) -> DataFrame:
    """nth_value over the default frame with an n that may differ from row to row."""
    names = df.columns
    by = Window.partitionBy(*partition).orderBy(*order)
    # the frame ends at the last peer of the row
    rows = df.withColumns({"_n": F.row_number().over(by), "_end": F.count(F.lit(1)).over(by), "_want": n})
    source = rows.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(partition)], F.col("_n").alias("_at"), F.col(value).alias("_value"))
    same = (F.col("_want") == F.col("_at")) & (F.col("_want") <= F.col("_end"))
    for i, p in enumerate(partition):
        same = same & F.col(p).eqNullSafe(F.col(f"_p{i}"))
    return rows.join(source, same, "left").select(*names, F.col("_value").alias(name))
