"""Functions along time, per symbol. Windows count grid rows, not observations.

Every window is partitioned by symbol and ordered by t, so all functions of one level share a single exchange and sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows per block of the exponential mean.
EMA_BLOCK = 512


def by_time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("t")


def so_far() -> WindowSpec:
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def rows(w: int) -> WindowSpec:
    return by_time().rowsBetween(1 - w, 0)


def joint(x: Column, y: Column) -> tuple[Column, Column]:
    """x and y where both are present."""
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def ts_mean(x: Column, w: int) -> Column:
    return F.avg(x).over(rows(w))


def ts_std(x: Column, w: int) -> Column:
    return F.stddev_samp(x).over(rows(w))


def ts_delta(x: Column, w: int) -> Column:
    return x - F.lag(x, w).over(by_time())


#: Windows up to this length are looked at through one lag per row instead of an array.
LAGS = 64


def ts_rank(x: Column, w: int) -> Column:
    """Share of the window's values below the current one, ties averaged."""
    n = F.count(x).over(rows(w))
    if w <= LAGS:
        past = [F.lag(x, i).over(by_time()) for i in range(1, w)]
        halves = sum((F.when(v < x, 2).when(v == x, 1).otherwise(0) for v in past), F.lit(0))
        return F.when(x.isNotNull(), (halves + 2) / (2 * n))
    seen = F.collect_list(x).over(rows(w))
    below = F.size(F.filter(seen, lambda v: v < x))
    equal = F.size(F.filter(seen, lambda v: v == x))
    return F.when(x.isNotNull(), (below + (equal + 1) / 2) / n)


def ts_min(x: Column, w: int) -> Column:
    return F.min(x).over(rows(w))


def ts_max(x: Column, w: int) -> Column:
    return F.max(x).over(rows(w))


def ts_returns(x: Column, w: int, pad: bool = True) -> Column:
    """Relative change over w rows; with pad, gaps are filled forward first."""
    f = F.last(x, ignorenulls=True).over(so_far()) if pad else x
    return F.try_divide(f, F.lag(f, w).over(by_time())) - 1


def ts_corr(x: Column, y: Column, w: int) -> Column:
    """Correlation of at least 3 joint pairs; a constant side gives null (corr() itself would raise)."""
    a, b = joint(x, y)
    over = rows(w)
    spread = F.stddev_pop(a).over(over) * F.stddev_pop(b).over(over)
    return F.when(F.count(a).over(over) >= 3, F.try_divide(F.covar_pop(a, b).over(over), spread))


def ts_shift(x: Column, w: int) -> Column:
    return F.lag(x, w).over(by_time())


def ts_sum(x: Column, w: int) -> Column:
    return F.sum(x).over(rows(w))


def ts_median(x: Column, w: int) -> Column:
    return F.percentile(x, F.lit(0.5)).over(rows(w))


def ts_skew(x: Column, w: int) -> Column:
    """Bias-corrected; null for fewer than 3 values or a constant window."""
    n = F.count(x).over(rows(w))
    return F.when(n >= 3, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x).over(rows(w)))


def ts_kurt(x: Column, w: int) -> Column:
    """Bias-corrected excess; null for fewer than 4 values or a constant window."""
    n = F.count(x).over(rows(w))
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(rows(w)) + 6))


def ts_ema(x: Column, w: int) -> Column:
    """Exponential mean with span w over all rows so far, weights adjusted for gaps.

    Weights are powers relative to the start of a block of rows, so that they stay in range; the block before is added through a range
    window. Anything older weighs less than (1 - 2 / (w + 1)) to the power of the block, which has to be below 1e-17.
    """
    decay = 1 - 2 / (w + 1)
    block = max(EMA_BLOCK, math.ceil(math.log(1e-18) / math.log(decay)))
    at, within = F.floor(F.col("t") / block), F.col("t") % block
    own = Window.partitionBy("symbol", at).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("symbol").orderBy(at).rangeBetween(-1, -1)
    weight = F.when(x.isNotNull(), F.pow(F.lit(decay), -within))
    total = lambda v: F.coalesce(F.sum(v).over(own), F.lit(0.0)) + F.lit(decay**block) * F.coalesce(F.sum(v).over(before), F.lit(0.0))
    return F.try_divide(total(x * weight), total(weight))


def ts_zscore(x: Column, w: int) -> Column:
    return F.try_divide(x - ts_mean(x, w), ts_std(x, w))


def ts_ir(x: Column, w: int) -> Column:
    return F.try_divide(ts_mean(x, w), ts_std(x, w))


def ts_maxmin_scale(x: Column, w: int) -> Column:
    return F.try_divide(x - ts_min(x, w), ts_max(x, w) - ts_min(x, w))


def ts_max_diff(x: Column, w: int) -> Column:
    return x - ts_max(x, w)


def ts_min_diff(x: Column, w: int) -> Column:
    return x - ts_min(x, w)


def ts_delta_ratio(x: Column, w: int) -> Column:
    past = ts_shift(x, w)
    return F.try_divide(x - past, F.abs(past))


def ts_decayed_linear(x: Column, w: int) -> Column:
    """Linear weights, the newest heaviest; any gap in the window gives null."""
    over, t = rows(w), F.col("t")
    total = (w - t) * F.sum(x).over(over) + F.sum(x * t).over(over)
    return F.when(F.count(x).over(over) == w, total / (w * (w + 1) / 2))


def ts_linear_reg(x: Column, w: int) -> Column:
    """Least-squares slope per row over a full window."""
    return F.when(F.count(x).over(rows(w)) == w, F.regr_slope(x, F.col("t").cast("double")).over(rows(w)))


def ts_cov(x: Column, y: Column, w: int) -> Column:
    a, b = joint(x, y)
    return F.when(F.count(a).over(rows(w)) >= 3, F.covar_samp(a, b).over(rows(w)))


def _position(x: Column, w: int, filler: float, best) -> Column:
    seen = F.collect_list(F.coalesce(x, F.lit(filler))).over(rows(w))
    at = F.array_position(seen, best(seen)) - 1
    return F.when((F.size(seen) == w) & (F.count(x).over(rows(w)) > 0), at.cast("double"))


def ts_argmax(x: Column, w: int) -> Column:
    """Position of the largest value in a window of w rows, 0 the oldest; the first of ties, gaps count as positions."""
    return _position(x, w, float("-inf"), F.array_max)


def ts_argmin(x: Column, w: int) -> Column:
    return _position(x, w, float("inf"), F.array_min)
