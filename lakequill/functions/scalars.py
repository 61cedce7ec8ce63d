"""Scalar operators and functions as native Column expressions.

Numbers that overflow become doubles, division by zero and undefined results
are null, and letters fold in ASCII only. Text that must be a number counts by
its numeric prefix.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_MAX, _MIN = 2**63 - 1, -(2**63)


def _nonzero(x: Column) -> Column:
    return F.when(x != 0, x)


# --- arithmetic and bits


def add(a: Column, b: Column) -> Column:
    """a + b as a double where the whole-number sum leaves 64 bits."""
    return F.coalesce(F.try_add(a, b).cast("double"), a.cast("double") + b.cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_subtract(a, b).cast("double"), a.cast("double") - b.cast("double"))


def multiply(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_multiply(a, b).cast("double"), a.cast("double") * b.cast("double"))


def int_divide(a: Column, b: Column) -> Column:
    """Whole-number division that truncates; null for a zero divisor."""
    return F.call_function("div", a.cast("bigint"), _nonzero(b.cast("bigint")))


def divide(a: Column, b: Column) -> Column:
    return a.cast("double") / _nonzero(b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign, operands cut to whole numbers."""
    return a.cast("bigint") % _nonzero(b.cast("bigint"))


def shift_left(a: Column, n: Column) -> Column:
    """Negative counts shift the other way; 64 places or more leave the sign only."""
    a, n = a.cast("bigint"), n.cast("bigint")
    left = F.when(n >= 64, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", a, n.cast("int")))
    right = F.when(n <= -64, F.when(a < 0, F.lit(-1)).otherwise(F.lit(0)).cast("bigint")).otherwise(F.call_function("shiftright", a, (-n).cast("int")))
    return F.when(n >= 0, left).otherwise(right)


def shift_right(a: Column, n: Column) -> Column:
    return shift_left(a, -n.cast("bigint"))


# --- conversion


def cast_integer(text: Column) -> Column:
    """The whole number that text starts with, 0 without one, held within 64 bits."""
    digits = F.regexp_extract(text, r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)", 1)
    wide = digits.try_cast("decimal(38,0)")
    held = F.when(wide > _MAX, F.lit(_MAX)).when(wide < _MIN, F.lit(_MIN)).otherwise(F.least(F.greatest(wide, F.lit(_MIN).cast("decimal(38,0)")), F.lit(_MAX).cast("decimal(38,0)")).cast("bigint"))
    far = F.when(digits.startswith("-"), F.lit(_MIN)).otherwise(F.lit(_MAX))
    return F.when(text.isNotNull(), F.when(digits == "", F.lit(0).cast("bigint")).otherwise(F.coalesce(held, far)))


def cast_real(text: Column) -> Column:
    """The number that text starts with, 0.0 without one."""
    number = F.regexp_extract(text, r"^[ \t\n\x0B\f\r]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.when(text.isNotNull(), F.coalesce(number.try_cast("double"), F.lit(0.0)))


def truth(text: Column) -> Column:
    """Text as a condition: its numeric prefix is not zero."""
    return cast_real(text) != 0


# --- patterns


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def ascii_upper(x: Column) -> Column:
    return F.translate(x, LOWER, UPPER)


def like(x: Column, pattern: str, escape: str = "\\") -> Column:
    """LIKE that ignores the case of ASCII letters only."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in pattern)
    if escape != "\\":
        out, k = "", 0
        while k < len(low):
            if low[k] == escape.lower() and k + 1 < len(low):
                out, k = out + "\\" + low[k + 1], k + 2
            else:
                out, k = out + ("\\\\" if low[k] == "\\" else low[k]), k + 1
        low = out
    return ascii_lower(x).like(low)


def glob_regex(pattern: str) -> str:
    """A Java regex with the meaning of a GLOB pattern: * ? [set] [^set]."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        k += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = pattern.find("]", k + 1 + (pattern[k : k + 1] == "^"))
            if end < 0:
                return "(?!)"  # an open set matches nothing
            body = pattern[k:end]
            head = "^" if body[:1] == "^" else ""
            body = body[len(head) :]
            out += "[" + head + re.sub(r"([\\\[\]&^~])", r"\\\1", body) + "]"
            k = end + 1
        else:
            out += re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", c)
    return rf"(?s)^{out}\z"


def glob(x: Column, pattern: str) -> Column:
    """Case-sensitive GLOB; a literal beginning becomes a prefix test, which reaches the scan."""
    head = re.match(r"[^*?\[]*", pattern)[0]
    if pattern == head:
        return x == pattern
    if pattern == head + "*":
        return x.startswith(head)
    test = x.rlike(glob_regex(pattern))
    return x.startswith(head) & test if head else test


# --- comparison of rows


def row_equal(left: list[Column], right: list[Column]) -> Column:
    out = left[0] == right[0]
    for a, b in zip(left[1:], right[1:]):
        out = out & (a == b)
    return out


def row_less(left: list[Column], right: list[Column], or_equal: bool = False) -> Column:
    """(a, b, ...) < (c, d, ...) with nulls deciding nothing, element by element."""
    a, b = left[0], right[0]
    if len(left) == 1:
        return a <= b if or_equal else a < b
    return (a < b) | ((a == b) & row_less(left[1:], right[1:], or_equal))


# --- ordinary functions


def scalar_min(*cols: Column) -> Column:
    """Null where any argument is null."""
    some = cols[0].isNull()
    for c in cols[1:]:
        some = some | c.isNull()
    return F.when(~some, F.least(*cols))


def scalar_max(*cols: Column) -> Column:
    some = cols[0].isNull()
    for c in cols[1:]:
        some = some | c.isNull()
    return F.when(~some, F.greatest(*cols))


def substr(x: Column, start: Column, length: Column | None = None) -> Column:
    """Characters from a 1-based start. Negative starts count from the end, a negative length takes
    the characters before the start, and start 0 stands one place before the first."""
    n = F.length(x).cast("bigint")
    at = F.when(start > 0, start.cast("bigint") - 1).when(start < 0, n + start).otherwise(F.lit(-1).cast("bigint"))
    if length is None:
        low, high = at, n
    else:
        low = F.when(length >= 0, at).otherwise(at + length)
        high = F.when(length >= 0, at + length).otherwise(at)
    low, high = F.greatest(low, F.lit(0)), F.least(high, n)
    return F.when(x.isNotNull() & start.isNotNull(), F.substring(x, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")))


def round_half_away(x: Column, digits: int = 0) -> Column:
    return F.round(x.cast("double"), min(max(digits, 0), 30))


def concat_all(*cols: Column) -> Column:
    """Null arguments count as empty text."""
    return F.concat_ws("", *[c.cast("string") for c in cols])


def char(*codes: Column) -> Column:
    """Text of the given code points."""
    one = [F.decode(F.unhex(F.lpad(F.hex(c.cast("bigint")), 8, "0")), "UTF-32") for c in codes]
    return F.concat_ws("", *one)


def unicode(x: Column) -> Column:
    """First code point; null for empty text."""
    return F.when(F.length(x) > 0, F.ascii(x))


def hex_text(x: Column) -> Column:
    return F.coalesce(F.hex(x.cast("string").cast("binary")), F.lit(""))


def unhex_text(x: Column, ignore: str = "") -> Column:
    plain = F.translate(x, ignore, "") if ignore else x
    return F.when(plain.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(plain))


def quote_text(x: Column) -> Column:
    """Text as an SQL literal."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def quote_blob(x: Column) -> Column:
    return F.coalesce(F.concat(F.lit("X'"), F.hex(x), F.lit("'")), F.lit("NULL"))


def quote_number(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("NULL"))


_CLASSES = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "boolean": "integer", "float": "real", "double": "real", "binary": "blob"}


def typeof(x: Column, spark_type: str) -> Column:
    """Storage class of a column of the given Spark type."""
    kind = _CLASSES.get(spark_type, "real" if spark_type.startswith("decimal") else "text")
    return F.when(x.isNull(), F.lit("null")).otherwise(F.lit(kind))


def zeroblob(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), F.greatest(n, F.lit(0)).cast("int")))


def iif(*args: Column) -> Column:
    """Condition, value pairs and an optional last value."""
    out = F.when(args[0], args[1])
    k = 2
    while k + 1 < len(args):
        out = out.when(args[k], args[k + 1])
        k += 2
    return out.otherwise(args[k]) if k < len(args) else out


def likely(x: Column, *_: object) -> Column:
    """Planner hints change nothing."""
    return x


def random_integer() -> Column:
    return F.xxhash64(F.rand(), F.monotonically_increasing_id())


def random_blob(n: int) -> Column:
    words = [F.hex(F.xxhash64(F.rand(), F.lit(k))) for k in range(-(-n // 8))]
    return F.unhex(F.substring(F.concat(*[F.lpad(w, 16, "0") for w in words]), 1, 2 * n))
