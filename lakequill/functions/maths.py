"""Mathematical functions: null for arguments outside a function's domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _real(x: Column) -> Column:
    return x.cast("double")


def defined(x: Column) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(x), x)


def ln(x: Column) -> Column:
    return F.when(_real(x) > 0, F.ln(_real(x)))


def log10(x: Column) -> Column:
    return F.when(_real(x) > 0, F.log10(_real(x)))


def log2(x: Column) -> Column:
    return F.when(_real(x) > 0, F.log2(_real(x)))


def log(x: Column, base: Column | None = None) -> Column:
    """Base 10 for one argument; log(value, base) needs a positive base that is not 1."""
    if base is None:
        return log10(x)
    return F.when((_real(base) > 0) & (_real(base) != 1) & (_real(x) > 0), F.ln(_real(x)) / F.ln(_real(base)))


def trunc(x: Column) -> Column:
    """Towards zero; whole numbers stay whole."""
    return F.signum(_real(x)) * F.floor(F.abs(_real(x))).cast("double")


def mod(x: Column, y: Column) -> Column:
    return _real(x) % F.when(_real(y) != 0, _real(y))


def unary(name: str, x: Column) -> Column:
    """sqrt, exp, the circular and hyperbolic functions and their inverses, radians, degrees."""
    return defined(getattr(F, name)(_real(x)))


def power(x: Column, y: Column) -> Column:
    return defined(F.pow(_real(x), _real(y)))
