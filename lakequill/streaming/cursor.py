"""A cursor that steps through a result without collecting it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row


class LimitError(RuntimeError):
    """A result is larger than its statement's limits allow."""


class Cursor:
    """step() moves to the next row; column(i) reads from it. Partitions are fetched one at a time."""

    def __init__(self, df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None):
        self.df, self.max_rows, self.max_bytes = df, max_rows, max_bytes
        self.reset()

    def reset(self) -> None:
        self._rows: Iterator[Row] | None = None
        self.row: Row | None = None
        self.taken = 0
        self.size = 0

    def step(self) -> bool:
        if self._rows is None:
            self._rows = self.df.toLocalIterator(prefetchPartitions=True)
        self.row = next(self._rows, None)
        if self.row is None:
            return False
        self.taken += 1
        if self.max_rows is not None and self.taken > self.max_rows:
            raise LimitError(f"more than {self.max_rows} rows")
        if self.max_bytes is not None:
            self.size += sum(len(v.encode()) if isinstance(v, str) else len(v) if isinstance(v, (bytes, bytearray)) else 8 for v in self.row)
            if self.size > self.max_bytes:
                raise LimitError(f"more than {self.max_bytes} bytes")
        return True

    def column(self, i: int) -> Any:
        if self.row is None:
            raise IndexError("no current row")
        return self.row[i]

    def __iter__(self) -> Iterator[Row]:
        while self.step():
            yield self.row  # type: ignore[misc]
