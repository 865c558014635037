"""Functions across the symbols of a date, and windows over daily series."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

DATE = ("date",)


def across(keys: tuple[str, ...] = DATE) -> WindowSpec:
    return Window.partitionBy(*keys)


def average_rank(x: Column, keys: tuple[str, ...] = DATE) -> Column:
    """Rank among the present values of a group, ties averaged: the mean of the first place of a row's peers and of their last. One sort serves both."""
    order = across(keys).orderBy(x.asc_nulls_last())
    last = F.round(F.cume_dist().over(order) * F.count(F.lit(1)).over(across(keys)))
    return F.when(x.isNotNull(), (F.rank().over(order) + last) / 2)


def cs_rank(x: Column, keys: tuple[str, ...] = DATE) -> Column:
    return average_rank(x, keys) / F.count(x).over(across(keys))


def cs_zscore(x: Column, keys: tuple[str, ...] = DATE) -> Column:
    return F.try_divide(x - F.avg(x).over(across(keys)), F.stddev_samp(x).over(across(keys)))


def cs_winsorize(x: Column, low: float = 0.01, high: float = 0.99, keys: tuple[str, ...] = DATE) -> Column:
    lo, hi = (F.percentile(x, F.lit(p)).over(across(keys)) for p in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def normed_rank_diff(x: Column, y: Column) -> Column:
    return cs_rank(x) - cs_rank(y)


def quantile_bucket(x: Column, q: int, keys: tuple[str, ...] = DATE) -> Column:
    """Bucket 1 to q of the present values, ties in symbol order: ceil(k * q / (n - 1)) of the rank k from 0, at least 1."""
    k = F.row_number().over(across(keys).orderBy(x.asc_nulls_last(), "symbol")) - 1
    n = F.count(x).over(across(keys))
    up = F.floor((k * q + n - 2) / F.greatest(n - 1, F.lit(1)))  # the ceiling in whole numbers
    return F.when(x.isNotNull(), F.greatest(F.lit(1), up).cast("int"))


def group_demean(x: Column, group: Column) -> Column:
    """x minus its mean within date and group; a missing group gives null."""
    return F.when(group.isNotNull(), x - F.avg(x).over(Window.partitionBy("date", group)))


def series(keys: tuple[str, ...]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def equity_curve(r: Column, keys: tuple[str, ...] = ()) -> Column:
    """Running product of 1 + r per series."""
    return F.product(1 + r).over(series(keys))


def drawdown(equity: Column, keys: tuple[str, ...] = ()) -> Column:
    """Distance from the running peak; the start value 1 is not part of the peak."""
    peak = F.max(equity).over(series(keys))
    return F.try_divide(equity - peak, peak)
