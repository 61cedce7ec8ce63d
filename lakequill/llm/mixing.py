"""Mixing sources to target weights by pivotal dependent rounding.

Every document wants the same expected number of copies as its source: target
divided by size. The whole part is given to all; the fractional part is rounded
by pairing documents of one source and moving words from one to the other, up
or down at random with the odds that keep expectations, until one of the two
is integral. A move keeps the words of a pair, so a source's total changes only
where its very last residual is rounded: to the nearer whole copy, not at random,
which keeps the total within half of that document's words.

The pairing is a reduction tree: blocks of documents of similar length run on
their own, each leaves one residual, and residuals combine in groups of
`FAN_IN` blocks, long documents first, so that the residual left at the end
tends to be a short one. Randomness is a hash of the document, so reruns agree
whatever the partitioning.

Defined cases: a null text has no words and is taken 0 times; sources without
words have target 0; a null source is the last source; repeated rows are
rounded independently where their sizes allow; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakequill.llm.common import materialize, small_or_shuffled
from lakequill.llm.textscan import mix

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BLOCK_ROWS = 1024
FAN_IN = 64


def n_words(text: Column) -> Column:
    """Maximal runs of characters other than space and \\x09-\\x0D; null has none.

    An expression, so that whole rows need not go through Python and back for it.
    """
    runs = F.regexp_replace(text, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.length(F.ltrim(runs, F.lit(" \t\n\x0b\x0c\r"))), F.lit(0)).cast("bigint")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size, the number of words of the whole text."""
    return docs.select("doc_id", "source", n_words(F.col("text").cast("string")).alias("size"))


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, rows, target: weights cycle over the sources in code point order, null last.

    Targets that reach `cap` times their source's size stop there; what they leave is shared among
    the others by weight. The level of the others is found in one pass over the sources ordered by
    cap / weight. The windows see one row per source, not per document.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.element_at(cycle, (rank - 1) % len(weights) + 1))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
    per = per.withColumn("full", (F.col("budget") - before) * F.col("w") >= F.col("cap") * left)
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole)
    open_weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(whole)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(rest * F.col("w") / open_weight, F.col("cap")))
    return per.select("source", "source_size", "rows", target.alias("target"))


def pivot(size: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Round fractions x of documents of `size` words in the given order; at most one stays fractional."""
    size, x, u = size.astype(float).tolist(), x.tolist(), u.tolist()
    c = 0
    for i in range(1, len(x)):
        if not 0.0 < x[i] < 1.0:
            continue
        if not 0.0 < x[c] < 1.0:
            c = i
            continue
        up_c, up_i = (1.0 - x[c]) * size[c], x[i] * size[i]
        down_c, down_i = x[c] * size[c], (1.0 - x[i]) * size[i]
        up, down = min(up_c, up_i), min(down_c, down_i)
        if u[i] * (up + down) < down:
            if up_c <= up_i:
                x[i] = x[i] - up / size[i] if up_c < up_i else 0.0
                x[c], c = 1.0, i
            else:
                x[c] += up / size[c]
                x[i] = 0.0
        elif down_c <= down_i:
            x[i] = x[i] + down / size[i] if down_c < down_i else 1.0
            x[c], c = 0.0, i
        else:
            x[c] -= down / size[c]
            x[i] = 1.0
    return np.array(x)


def _round_group(last: bool, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        # equal keys (repeated rows) still draw different numbers
        with np.errstate(over="ignore"):
            salt = (pdf.groupby(["size", "key"], dropna=False).cumcount().to_numpy().astype(np.uint64) + np.uint64(level << 32)) * np.uint64(0x9E3779B97F4A7C15)
            u = mix(pdf["key"].to_numpy().astype(np.int64).view(np.uint64) + salt) / 2.0**64
        x = pivot(pdf["size"].to_numpy(), pdf["x"].to_numpy(), u)
        pdf["x"] = np.rint(x) if last else x
        return pdf

    return run


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (whole copies of the document in the mix)."""
    sized = materialize(sizes(docs))
    goal = materialize(targets(sized, weights, share, cap))
    blocks = F.greatest(F.ceil(F.col("rows") / F.lit(BLOCK_ROWS)), F.lit(1))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        sized.withColumn("no_source", F.col("source").isNull())
        .withColumn("source", F.coalesce("source", F.lit("")))
        .join(goal.withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit(""))), ["source", "no_source"])
        .withColumn("rate", rate)
        .withColumn("whole", F.floor("rate"))
        .withColumn("x", F.when(F.col("size") > 0, F.col("rate") - F.col("whole")).otherwise(0.0))
        .withColumn("key", F.xxhash64("doc_id", "source", "size"))
        .withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), blocks))
        .withColumn("class", F.floor(F.log2(F.col("size") + 1)).cast("int"))
        .select("doc_id", "source", "no_source", "size", "source_size", "target", "whole", "x", "key", "block", "class")
    )
    most = goal.agg(F.max("rows")).first()[0] or 0
    n = -(-most // BLOCK_ROWS)
    done: list[DataFrame] = []
    level = 0
    groups = ["source", "no_source", "block", "class"]
    open_ = rows
    while True:
        last = level > 0 and n <= 1
        split = open_.groupBy(*groups).applyInPandas(_round_group(last, level), rows.schema)
        if last:
            done.append(split)
            break
        split = materialize(split)
        done.append(split.where("x = 0 or x = 1"))
        open_ = split.where("x > 0 and x < 1")
        n = -(-n // FAN_IN)
        open_ = open_.withColumn("block", F.floor(F.col("block") / FAN_IN))
        groups = ["source", "no_source", "block"]
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(
        "doc_id",
        F.when(~F.col("no_source"), F.col("source")).alias("source"),
        "size",
        "source_size",
        "target",
        (F.col("whole") + F.col("x")).cast("bigint").alias("copies"),
    )


def op4(docs: DataFrame) -> DataFrame:
    mixed = mix_sources(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def document_targets(docs: DataFrame) -> DataFrame:
    """The columns of `op4` that SQL can express, targets to three places."""
    return op4(docs).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


TARGET_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 1.5 * sum(source_size) OVER () AS budget FROM s),
o AS (
  SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
f AS (SELECT *, (budget - before) * weight >= 2 * source_size * open AS full_ FROM o),
t AS (
  SELECT source, source_size, CASE WHEN full_ THEN CAST(2 * source_size AS DOUBLE)
    ELSE (budget - coalesce(sum(2 * source_size) FILTER (WHERE full_) OVER (), 0)) * weight / sum(weight) FILTER (WHERE NOT full_) OVER () END AS target FROM f)
SELECT doc_id, size, source_size, round(CAST(target AS DOUBLE), 3) AS target
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it.

    Rows and decisions meet by doc_id, source and size; only where several rows share all three are
    they numbered, and the n-th row gets the n-th decision.
    """
    names = docs.columns
    key = ["doc_id", "source", "size"]
    decided = materialize(mix_sources(docs, **how).select(*key, "copies"))
    per = materialize(decided.groupBy(*key).agg(F.count("*").alias("n"), F.sum("copies").alias("copies")))
    once = per.where("n > 1 or copies > 0").select(*[F.col(c).alias(f"k_{c}") for c in key], "n", "copies")
    rows = _with_size(docs)

    def same(other: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [rows[c].eqNullSafe(other[f"k_{c}"]) for c in key])

    taken = rows.join(small_or_shuffled(once), same(once)).select("row", *key, "n", "copies")
    single = taken.where("n = 1").select("row", "copies")
    again = per.where("n > 1").select(*key)
    if not again.isEmpty():
        nth = Window.partitionBy(*key)
        many = taken.where("n > 1").select("row", *key).withColumn("nth", F.row_number().over(nth.orderBy("row.text")))
        each = decided.join(again.select(*[F.col(c).alias(f"k_{c}") for c in key]), reduce(lambda a, b: a & b, [decided[c].eqNullSafe(F.col(f"k_{c}")) for c in key]), "left_semi")
        each = each.withColumn("nth", F.row_number().over(nth.orderBy("copies"))).select(*[F.col(c).alias(f"k_{c}") for c in key], F.col("nth").alias("k_nth"), "copies")
        on = reduce(lambda a, b: a & b, [many[c].eqNullSafe(each[f"k_{c}"]) for c in [*key, "nth"]])
        single = single.unionByName(many.join(each.where("copies > 0"), on).select("row", "copies"))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return single.where("copies > 0").select("row", copies.alias("copy")).select(*[F.col("row").getField(c).alias(c) for c in names])


def _with_size(docs: DataFrame) -> DataFrame:
    """row (all columns of `docs`), doc_id, source and size, the number of words."""
    row = F.struct(*[docs[c] for c in docs.columns])
    return docs.select(row.alias("row"), "doc_id", "source", n_words(F.col("text").cast("string")).alias("size"))
