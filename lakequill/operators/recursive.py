"""Recursive queries beyond what the SQL form takes: UNION, several recursive arms, body LIMIT and queue order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakequill.session import shared_dir, written

STEPS = 10_000

Step = Callable[[DataFrame], DataFrame]


class _Layers:
    """Rows seen so far: one folder, to which each layer adds a table; one scan reads them all."""

    def __init__(self, seed: DataFrame, distinct: bool):
        self.names, self.distinct, self.schema = seed.columns, distinct, seed.schema
        self.folder, self.count, self.spark = shared_dir(seed.sparkSession), 0, seed.sparkSession

    def add(self, rows: DataFrame) -> DataFrame:
        """The rows that are new, written as the next layer."""
        rows = rows.toDF(*self.names)
        if self.distinct:
            rows = rows.distinct()
            if self.count:
                seen = self.all()
                rows = rows.join(seen, _same(rows, seen, self.names), "left_anti")
        # later layers keep the first one's types, as its columns do
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema.fields])
        self.count += 1
        return written(rows, f"{self.folder}/layer-{self.count:08d}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/layer-*")


def fixpoint(seed: DataFrame, step: Step, distinct: bool = True, steps: int = STEPS) -> DataFrame:
    """seed UNION step(seed) UNION step(step(seed)) ... until a step brings nothing new.

    With `distinct` (UNION) rows that were seen before are dropped, so cycles end; without
    (UNION ALL) it ends when a step is empty. Each step is one distributed join; only whether it
    brought rows comes to the driver. Rows still new after `steps` steps are an error.
    """
    layers = _Layers(seed, distinct)
    front = layers.add(seed)
    for _ in range(steps):
        front = layers.add(step(front))
        if front.isEmpty():
            return layers.all()
    raise RuntimeError(f"no fixpoint within {steps} steps")


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    out = a[names[0]].eqNullSafe(b[names[0]])
    for n in names[1:]:
        out = out & a[n].eqNullSafe(b[n])
    return out


def queue(seed: DataFrame, step: Step, limit: int, offset: int = 0, order: list[Column] | None = None, distinct: bool = False, steps: int = STEPS) -> DataFrame:
    """A recursive body with LIMIT and, with `order`, a priority queue: the smallest pending row is
    taken out, emitted, and its successors go in. Without `order` rows leave first in, first out.

    The result has `_turn`: with `order` the row's place (from 1), else the number of its layer,
    whose rows leave at once. A limit ends the loop, however large; without one, rows still pending
    after `steps` steps are an error.
    """
    want = limit + offset if limit >= 0 else None
    rows = _first_in_first_out(seed, step, want, distinct, steps) if order is None else _by_priority(seed, step, want, order, distinct, steps)
    if order is not None:
        return rows.where(F.col("_turn") > offset)
    return rows.orderBy("_turn", *seed.columns).offset(offset) if offset else rows


def _first_in_first_out(seed: DataFrame, step: Step, want: int | None, distinct: bool, steps: int) -> DataFrame:
    layers, out = _Layers(seed, distinct), shared_dir(seed.sparkSession)
    schema = seed.withColumn("_turn", F.lit(1).cast("bigint")).schema
    front, taken, turn = layers.add(seed), 0, 0
    while True:
        n = front.count()
        turn += 1
        part = front if want is None or taken + n <= want else front.orderBy(*seed.columns).limit(want - taken)
        written(part.withColumn("_turn", F.lit(turn).cast("bigint")), f"{out}/layer-{turn:08d}")
        taken += n
        if not n or (want is not None and taken >= want):
            break
        if want is None and turn > steps:
            raise RuntimeError(f"rows are still pending after {steps} steps")
        front = layers.add(step(front))
    return seed.sparkSession.read.schema(schema).parquet(f"{out}/layer-*")


def _by_priority(seed: DataFrame, step: Step, want: int | None, order: list[Column], distinct: bool, steps: int) -> DataFrame:
    """Rows get a number when they enter the queue; it breaks ties, so each leaves exactly once.

    All rows that tie for the first place leave together unless one of their successors would come
    before them; then the first of them leaves alone.
    """
    names, spark = seed.columns, seed.sparkSession
    layers, out = _Layers(seed, distinct), shared_dir(spark)
    schema = seed.withColumn("_turn", F.lit(1).cast("bigint")).schema
    entered, taken, round_ = 0, 0, 0

    def enter(rows: DataFrame) -> DataFrame:
        nonlocal entered
        entered += 1
        return written(rows.withColumns({"_in": F.lit(entered), "_no": F.monotonically_increasing_id()}))

    pending = enter(layers.add(seed))
    place = F.rank().over(Window.orderBy(*order))
    turn = F.row_number().over(Window.orderBy("_in", "_no")).cast("bigint")
    while want is None or taken < want:
        first = written(pending.withColumn("_place", place).where("_place = 1").drop("_place"))
        n = first.count()
        if not n:
            break
        if want is None and round_ >= steps:
            raise RuntimeError(f"rows are still pending after {steps} steps")
        fresh = None
        if n > 1:
            fresh = written(step(first.select(*names)).toDF(*names))
            both = fresh.withColumn("_tie", F.lit(0)).unionAll(first.limit(1).select(*names).withColumn("_tie", F.lit(1)))
            if both.withColumn("_place", place).where("_place = 1 and _tie = 1").isEmpty():
                first, n, fresh = written(first.orderBy("_in", "_no").limit(1)), 1, None
        if want is not None and taken + n > want:
            first, n = written(first.orderBy("_in", "_no").limit(want - taken)), want - taken
        round_ += 1
        written(first.withColumn("_turn", turn + F.lit(taken)).select(*names, "_turn"), f"{out}/layer-{round_:08d}")
        taken += n
        if want is not None and taken >= want:
            break
        entering = enter(layers.add(step(first.select(*names)) if fresh is None else fresh))
        rest = pending.join(first.select("_in", "_no"), ["_in", "_no"], "left_anti").select(*names, "_in", "_no")
        pending = written(rest.unionAll(entering))
    if not round_:
        return seed.withColumn("_turn", F.lit(1).cast("bigint")).where("false")
    return spark.read.schema(schema).parquet(f"{out}/layer-*")
