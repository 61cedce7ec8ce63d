"""Connections and prepared statements over a folder of tables."""

from __future__ import annotations

import re
import threading
import uuid
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.functions import sql_udfs
from lakequill.operators.compound import limited
from lakequill.operators.recursive import fixpoint, queue
from lakequill.plans.dialect import Loop, SqlError, Translator, quoted, split_statements, tokens
from lakequill.sources import catalog
from lakequill.streaming.cursor import Cursor, LimitError

#: Names of metadata statements that read only.
_KINDS = {"INTEGER": "int", "REAL": "real", "TEXT": "text"}


class EngineError(RuntimeError):
    """kind: sql, misuse, limit, cancelled, timeout or unsupported."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def _order_column(term: str, names: list[str]) -> Column:
    """An ORDER BY term of a recursive body; a number is a column's place."""
    body, nulls = re.fullmatch(r"(.*?)(?: NULLS (FIRST|LAST))?", term, re.S).groups()  # type: ignore[union-attr]
    down = body.endswith(" DESC")
    body = body.removesuffix(" DESC").removesuffix(" ASC")
    c = F.col(quoted(names[int(body) - 1])) if body.isdigit() else F.expr(body)
    first = (nulls or ("LAST" if down else "FIRST")) == "FIRST"
    return (c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last())


class Connection:
    """One read-only database: every table of a folder as a view of the session."""

    def __init__(self, spark: SparkSession, sf_dir: str, max_rows: int | None = None, max_sql: int = 16 << 20, max_bytes: int | None = None):
        """max_rows and max_bytes bound what one statement may give out."""
        self.spark, self.sf_dir, self.max_rows, self.max_sql, self.max_bytes = spark, sf_dir, max_rows, max_sql, max_bytes
        self.defined: set[str] = set()
        catalog.register(spark, sf_dir)
        sql_udfs.register(spark)

    def column_kinds(self) -> dict[str, str]:
        """Kinds of column names; a name whose tables disagree has none."""
        kinds: dict[str, set[str | None]] = {}
        for t in self.spark.catalog.listTables():
            for f in self.spark.table(quoted(t.name)).schema.fields:
                kinds.setdefault(f.name.lower(), set()).add(_KINDS.get(catalog.declared_type(f.dataType)))
        return {n: k for n, s in kinds.items() if len(s) == 1 and (k := next(iter(s)))}

    def define_view(self, name: str, sql: str, columns: list[str] | None = None) -> None:
        """A named SELECT, with its own column names or given ones; views may stand on views."""
        rows = self.query(sql)
        if columns is not None and len(columns) != len(rows.columns):
            raise EngineError("sql", f"expected {len(columns)} columns for '{name}' but got {len(rows.columns)}")
        (rows.toDF(*columns) if columns else rows).createOrReplaceTempView(quoted(name))

    def define(self, functions: dict[str, str]) -> None:
        """Temporary functions that a statement's text needs; their names follow from what they do."""
        for name, text in functions.items():
            if name not in self.defined:
                self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
                self.defined.add(name)

    def prepare(self, sql: str) -> tuple["Statement | None", str]:
        """The first statement and the rest of the text; None where there is only white space."""
        if len(sql) > self.max_sql:
            raise EngineError("limit", "statement too long")
        first, rest = split_statements(sql)
        try:
            words = tokens(first)
        except SqlError as e:
            raise EngineError("sql", str(e)) from e
        if not words:
            return None, rest
        if words[0].word not in ("SELECT", "WITH", "VALUES", "PRAGMA"):
            raise EngineError("unsupported", "only SELECT, VALUES, WITH and PRAGMA statements are accepted")
        return Statement(self, first), rest

    def query(self, sql: str, *values: Any, **named: Any) -> DataFrame:
        """The DataFrame of one statement with its parameters bound."""
        statement, rest = self.prepare(sql)
        if statement is None or (rest.strip() and self.prepare(rest)[0] is not None):
            raise EngineError("misuse", "one statement is needed")
        statement.bind(*values, **named)
        return statement.dataframe()


class Statement:
    def __init__(self, connection: Connection, sql: str):
        self.connection, self.sql = connection, sql
        self.tag = f"lq-{uuid.uuid4().hex}"
        self.cursor: Cursor | None = None
        self.values: dict[str, Any] = {}
        self.translator = None
        self.text = None
        if tokens(sql)[0].word == "PRAGMA":
            return
        self.translator = Translator(sql, connection.column_kinds())
        try:
            self.text = self.translator.statement()
        except SqlError as e:
            raise EngineError("sql", str(e)) from e

    @property
    def parameters(self) -> list[str]:
        return self.translator.parameters if self.translator else []

    def bind(self, *values: Any, **named: Any) -> "Statement":
        """Values by place, then by name; a parameter without one is null."""
        if self.cursor is not None:
            raise EngineError("misuse", "reset the statement before binding")
        names = self.parameters
        if len(values) > len(names) or set(named) - set(names):
            raise EngineError("misuse", "no such parameter")
        self.values.update(dict(zip(names, values)) | named)
        return self

    def clear_bindings(self) -> None:
        self.values.clear()

    def dataframe(self) -> DataFrame:
        spark = self.connection.spark
        try:
            if self.translator is None:
                return self._pragma()
            for name, argument, view in self.translator.pragmas:
                df = catalog.schema_table(spark) if name == "schema" else catalog.pragma(spark, name, argument, self.connection.sf_dir)
                if df is None:
                    raise EngineError("sql", f"no such table: pragma_{name}")
                df.createOrReplaceTempView(view)
            self.connection.define(self.translator.functions)
            for loop in self.translator.loops:
                self._run_loop(loop)
            return spark.sql(self._limited(self.text), args={n: self.values.get(n) for n in self.parameters} or None)
        except PySparkException as e:
            raise EngineError("sql", str(e).split("\n")[0]) from e

    def _limited(self, text: str) -> str:
        """Limits given as parameters, written out: a negative one is none."""

        def one(m: re.Match) -> str:
            n = self.values.get(m[2])
            if isinstance(n, bool) or not isinstance(n, (int, float)) or n != int(n):
                raise EngineError("sql", "datatype mismatch")
            return "" if n < 0 else f" {m[1]} {int(n)}"

        names = "|".join(map(re.escape, self.translator.limits))
        return re.sub(rf" (LIMIT|OFFSET) :({names})\b", one, text) if names else text

    def _run_loop(self, loop: Loop) -> None:
        spark = self.connection.spark
        args = {n: self.values.get(n) for n in self.parameters} or None

        def rows_of(text: str, *tables: str) -> DataFrame:
            head = [*loop.before, *tables]
            return spark.sql((f"WITH RECURSIVE {', '.join(head)} " if head else "") + text, args=args)

        seed = rows_of(loop.seed)
        seed = seed.toDF(*loop.columns) if loop.columns else seed

        def step(front: DataFrame) -> DataFrame:
            front.createOrReplaceTempView(f"{loop.view}_front")
            return rows_of(loop.step, f"{quoted(loop.name)} AS (SELECT * FROM {loop.view}_front)")

        order = [_order_column(t, seed.columns) for t in loop.order] or None
        if loop.limit >= 0 or order:
            rows = queue(seed, step, loop.limit, loop.offset, order, loop.distinct).select(*[quoted(c) for c in seed.columns])
        else:
            rows = limited(fixpoint(seed, step, loop.distinct), -1, loop.offset)
        rows.createOrReplaceTempView(loop.view)

    def _pragma(self) -> DataFrame:
        words = tokens(self.sql)
        name = words[1].text if len(words) > 1 else ""
        rest = [w.text for w in words[2:] if w.text not in ("(", ")", ";")]
        if "=" in rest:
            raise EngineError("unsupported", "this pragma would change the database")
        argument = rest[0].strip("'\"`[]") if rest else None
        df = catalog.pragma(self.connection.spark, name, argument, self.connection.sf_dir)
        return self.connection.spark.createDataFrame([], "nothing string") if df is None else df

    @property
    def columns(self) -> list[tuple[str, str]]:
        """Names and types of the result."""
        return [(f.name, catalog.declared_type(f.dataType)) for f in self.dataframe().schema.fields]

    def step(self) -> bool:
        """Move to the next row; False behind the last."""
        spark = self.connection.spark
        try:
            if self.cursor is None:
                self.cursor = Cursor(self.dataframe(), self.connection.max_rows, self.connection.max_bytes)
            spark.addTag(self.tag)
            return self.cursor.step()
        except LimitError as e:
            raise EngineError("limit", str(e)) from e
        except PySparkException as e:
            raise EngineError("cancelled" if "cancel" in str(e).lower() else "sql", str(e).split("\n")[0]) from e
        finally:
            spark.removeTag(self.tag)

    def column(self, i: int) -> Any:
        if self.cursor is None:
            raise EngineError("misuse", "no current row")
        return self.cursor.column(i)

    def reset(self) -> None:
        self.cursor = None

    def cancel(self) -> None:
        """Stop the statement's running jobs, from any thread."""
        self.connection.spark.interruptTag(self.tag)

    def rows(self, timeout: float | None = None) -> list[tuple]:
        """All rows; past `timeout` seconds the statement is cancelled."""
        timer = threading.Timer(timeout, self.cancel) if timeout else None
        if timer:
            timer.start()
        try:
            out = []
            while self.step():
                out.append(tuple(self.cursor.row))  # type: ignore[union-attr,arg-type]
            return out
        except EngineError as e:
            raise EngineError("timeout", "the statement took too long") if timer and not timer.is_alive() else e from None
        finally:
            if timer:
                timer.cancel()
            self.reset()

    def finalize(self) -> None:
        self.reset()
        self.clear_bindings()
