"""Table constructors: VALUES, JSON table functions and lateral use of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.functions import json as J


def values(spark: SparkSession, rows: Sequence[Sequence], types: Sequence[str]) -> DataFrame:
    """VALUES (...), (...): columns column1, column2, ..."""
    schema = ", ".join(f"column{i + 1} {t}" for i, t in enumerate(types))
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def lateral_each(df: DataFrame, doc: Column, root: str = "$", deep: bool = False, outer: bool = False) -> DataFrame:
    """df, json_each(doc, root): each row beside the rows of its document (json_tree with `deep`)."""
    rows = J.json_tree(doc, root) if deep else J.json_each(doc, root)
    explode = F.explode_outer if outer else F.explode
    return df.withColumn("_row", explode(rows)).select(*df.columns, "_row.*")


def banded_join(left: DataFrame, right: DataFrame, on: list[str], at: str, other: str, width: float, low: float = 0.0) -> DataFrame:
    """Rows of both sides with equal `on` and low <= right.other - left.at <= width.

    The right side is bucketed by `width`, the left looks into the two buckets that its band can
    touch: an equi-join in place of a nested loop.
    """
    names = {c: f"r_{c}" for c in right.columns}
    r = right.select(*[F.col(c).alias(n) for c, n in names.items()]).withColumn("_b", F.floor(F.col(names[other]) / width))
    first = F.floor((F.col(at) + low) / width)
    last = F.floor((F.col(at) + width) / width)
    l = left.withColumn("_b", F.explode(F.sequence(first, last)))
    same = l["_b"] == r["_b"]
    for c in on:
        same = same & (l[c] == r[names[c]])
    gap = F.col(names[other]) - F.col(at)
    return l.join(r, same).where((gap >= low) & (gap <= width)).drop("_b")
