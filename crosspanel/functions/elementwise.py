"""Element-wise functions. Missing in, missing out; what is undefined is null, never NaN or an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add(x: Column, y: Column) -> Column:
    return x + y


def sub(x: Column, y: Column) -> Column:
    return x - y


def mul(x: Column, y: Column) -> Column:
    return x * y


def safe_div(x: Column, y: Column) -> Column:
    return F.try_divide(x, y)


def log_abs(x: Column) -> Column:
    return F.ln(F.nullif(F.abs(x), F.lit(0.0)))


def abs_val(x: Column) -> Column:
    return F.abs(x)


def sign(x: Column) -> Column:
    return F.signum(x)


def neg(x: Column) -> Column:
    return -x


def relu(x: Column) -> Column:
    return F.when(x < 0, 0.0).otherwise(x)


def square(x: Column) -> Column:
    return x * x


def signed_sqrt(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def cwise_max(x: Column, y: Column) -> Column:
    """x where x > y, else y: a missing x gives y, a missing y gives missing."""
    return F.when(x > y, x).otherwise(y)


def cwise_min(x: Column, y: Column) -> Column:
    return F.when(x < y, x).otherwise(y)


def greater(x: Column, y: Column) -> Column:
    return (x > y).cast("double")


def less(x: Column, y: Column) -> Column:
    return (x < y).cast("double")


def finite(x: Column) -> Column:
    """Infinite and NaN values become null."""
    return F.when(F.abs(x) < float("inf"), x)


def mask(x: Column, member: Column) -> Column:
    return F.when(member, x)


def clip(x: Column, lo: float = -0.95, hi: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
