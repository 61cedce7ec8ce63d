"""Date and time calls of SQL text as native functions.

The Column forms of `dates` are the one implementation. A call whose modifiers
and format are literals becomes a chain of temporary SQL functions, one for
each step, whose bodies are those Columns written out as text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakequill.functions import dates as D

_NUMBER = r"^\s*[+-]?\d+(\.\d+)?([eE][+-]?\d+)?\s*$"
_OPERATOR = re.compile(r"('(?:[^'\\]|\\.)*')|(?<![\w`])(and|or|!=|<=>|<=|>=|<>|[-+*/%!=<>])\(")
#: Modifiers that interpret a numeric input and so belong to its reading.
_READING = ("unixepoch", "auto", "julianday")
_FORMATS = {"date": "%Y-%m-%d", "time": "%H:%M:%S", "datetime": "%Y-%m-%d %H:%M:%S"}


def sql_of(column: Column) -> str:
    """A Column as SQL text: operators, which print before their operands, become functions of that name."""
    return _OPERATOR.sub(lambda m: m[1] or f"`{m[2]}`(", column._jc.node().sql())


def _reading(kind: str, modifiers: list[str]) -> Column:
    x = F.col("x")
    number = D.moment(x if kind == "number" else x.try_cast("double"), *modifiers, numeric=True).ms
    if kind == "number":
        return number
    text = F.lit(None).cast("bigint") if {"unixepoch", "auto"} & set(modifiers) else D.moment(x).ms
    now = F.floor(F.unix_millis(F.current_timestamp()))
    return F.when(F.lower(x) == "now", now).when(x.rlike(_NUMBER), number).otherwise(text).cast("bigint")


def _steps(modifiers: list[str]) -> list[list[str]]:
    """Modifiers applied together: one that looks back at a shift stays with it."""
    out: list[list[str]] = []
    for m in modifiers:
        if m in ("floor", "ceiling") and out:
            out[-1].append(m)
        else:
            out.append([m])
    return out


def _result(name: str, pattern: str | None, subsec: bool) -> tuple[str, Column]:
    m = D.Moment(F.col("ms"), subsec=subsec)
    if name == "julianday":
        return "DOUBLE", D.julianday(m)
    if name == "unixepoch":
        return ("DOUBLE" if subsec else "BIGINT"), D.unixepoch(m)
    pattern = pattern if name == "strftime" else _FORMATS[name]
    return "STRING", D.strftime(pattern.replace("%S", "%f") if subsec and name != "strftime" else pattern, m)


def call(name: str, x: str, numeric: bool, modifiers: list[str], pattern: str | None, define: Callable[[str, str], None]) -> tuple[str, str]:
    """The text of a date call on the expression `x`, and its kind; `define` takes the functions it needs."""

    def function(argument: str, returns: str, body: Column) -> str:
        text = sql_of(body)
        made = f"lq_d{zlib.crc32((argument + returns + text).encode()):08x}"
        define(made, f"{made}({argument}) RETURNS {returns} RETURN CAST({text} AS {returns})")
        return made

    plain = [m.strip().lower() for m in modifiers]
    subsec = any(m in ("subsec", "subsecond") for m in plain)
    plain = [m for m in plain if m not in ("subsec", "subsecond")]
    n = next((i for i, m in enumerate(plain) if m not in _READING), len(plain))
    if any(m in ("unixepoch", "auto") for m in plain[n:]):
        return "CAST(NULL AS STRING)", "text"
    kind, argument = ("number", "x DOUBLE") if numeric else ("text", "x STRING")
    text = f"{function(argument, 'BIGINT', _reading(kind, plain[:n]))}(CAST({x} AS {argument.split()[1]}))"
    for some in _steps(plain[n:]):
        m = D.Moment(F.col("ms"))
        for modifier in some:
            m = m.modified(modifier)
        text = f"{function('ms BIGINT', 'BIGINT', m.ms)}({text})"
    returns, body = _result(name, pattern, subsec)
    return f"{function('ms BIGINT', returns, body)}({text})", {"STRING": "text", "DOUBLE": "real", "BIGINT": "int"}[returns]
