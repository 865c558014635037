"""How good a signal is: rank IC and what follows from it, turnover, factor return, summaries of return series.

All take long tables with the signal in one column; `keys` are the columns that name a signal (none for a single one), so a
whole batch of signals is scored in one plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import average_rank, cs_rank, drawdown, equity_curve
from ..functions.elementwise import clip

DAYS_PER_YEAR = 252
#: A spread at or below this counts as none.
NO_SPREAD = 1e-12
Keys = tuple[str, ...]


def rank_ic(df: DataFrame, signal: str, label: str, min_stocks: int = 20, keys: Keys = ()) -> DataFrame:
    """keys, date, ic: the daily Spearman correlation over cells where both are present; thin and constant days are left out."""
    by = (*keys, "date")
    cells = df.where(F.col(signal).isNotNull() & F.col(label).isNotNull()).select(*by, F.col(signal).alias("_x"), F.col(label).alias("_y"))
    ranked = cells.select(*by, average_rank(F.col("_x"), by).alias("_x"), average_rank(F.col("_y"), by).alias("_y"))
    ic = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))
    return ranked.groupBy(*by).agg(ic.alias("ic"), F.count(F.lit(1)).alias("_n")).where((F.col("_n") >= min_stocks) & F.col("ic").isNotNull()).drop("_n")


def icir(ic: Column) -> Column:
    """Aggregate: mean over sample deviation; 0 without a spread."""
    sd = F.stddev_samp(ic)
    return F.when(sd >= NO_SPREAD, F.avg(ic) / sd).otherwise(0.0)


def ic_summary(daily: DataFrame, scale: float = 1.0, keys: Keys = ()) -> DataFrame:
    """keys, ic, icir, tstat, n_days. scale: the step by which dates were thinned."""
    n = F.count("ic")
    return daily.groupBy(*keys).agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("ic"), icir(F.col("ic")).alias("icir"), (icir(F.col("ic")) * F.sqrt(n * scale)).alias("tstat"), n.alias("n_days"))


def turnover(df: DataFrame, signal: str, keys: Keys = ()) -> DataFrame:
    """keys, turnover: mean over dates of the mean absolute change in percentile rank."""
    by = (*keys, "date")
    ranked = df.select(*by, "symbol", "t", cs_rank(F.col(signal), by).alias("_u"))
    moved = F.abs(F.col("_u") - F.lag("_u").over(Window.partitionBy(*keys, "symbol").orderBy("t")))
    daily = ranked.select(*by, moved.alias("_moved")).groupBy(*by).agg(F.avg("_moved").alias("_moved"))
    return daily.groupBy(*keys).agg(F.avg("_moved").alias("turnover"))


def factor_return(df: DataFrame, signal: str, label: str, keys: Keys = ()) -> DataFrame:
    """keys, date, ret: the return (clipped) of a dollar-neutral book with weights by centred rank; null where all ranks tie."""
    by = (*keys, "date")
    cells = df.where(F.col(signal).isNotNull() & F.col(label).isNotNull()).select(*by, F.col(signal).alias("_x"), clip(F.col(label)).alias("_y"))
    ranked = cells.select(*by, "_y", average_rank(F.col("_x"), by).alias("_x"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("_n"))
    return ranked.groupBy(*by).agg(_book_return(F.col("_x"), F.col("_n"), F.col("_y")).alias("ret"))


def _book_return(rank: Column, n: Column, ret: Column) -> Column:
    """Aggregate: weights are ranks less their mean, which is (n + 1) / 2 of n cells."""
    weight = rank - (n + 1) / 2
    return F.try_divide(F.sum(weight * ret), F.sum(F.abs(weight)))


def daily_figures(df: DataFrame, signal: str, label: str, keys: Keys = (), scored: Column | None = None) -> DataFrame:
    """keys, date, ic, n_joint, ret (of factor_return), moved (mean absolute change in percentile rank), n_values, n_cells: all that scores of a signal need, per day.

    IC and return are of the cells where `scored` holds (all by default). All ranks share one exchange by signal and date; the change in rank
    needs a second one by signal and symbol; what is aggregated then has a row per signal and day. df: with symbol and t.
    """
    by = (*keys, "date")
    x, y = F.col(signal), F.col(label)
    joint = x.isNotNull() & y.isNotNull() & (F.lit(True) if scored is None else scored)
    cells = df.select(*by, "symbol", "t", x.alias("_v"), F.when(joint, x).alias("_x"), F.when(joint, y).alias("_y"))
    ranked = cells.select(*by, "symbol", "t", F.col("_v").isNotNull().alias("_has"), clip(F.col("_y")).alias("_r"), cs_rank(F.col("_v"), by).alias("_u"), average_rank(F.col("_x"), by).alias("_x"), average_rank(F.col("_y"), by).alias("_y"), F.count("_x").over(Window.partitionBy(*by)).alias("_n"))
    before = F.lag("_u").over(Window.partitionBy(*keys, "symbol").orderBy("t"))
    ic = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))
    return ranked.withColumn("_moved", F.abs(F.col("_u") - before)).groupBy(*by).agg(
        ic.alias("ic"), F.count("_x").alias("n_joint"), _book_return(F.col("_x"), F.col("_n"), F.col("_r")).alias("ret"), F.avg("_moved").alias("moved"), F.sum(F.col("_has").cast("bigint")).alias("n_values"), F.count(F.lit(1)).alias("n_cells")
    )


def sharpe(r: Column) -> Column:
    """Aggregate: annualised; 0 for fewer than two returns or without a spread."""
    sd = F.stddev_samp(r)
    return F.when(sd > NO_SPREAD, math.sqrt(DAYS_PER_YEAR) * F.avg(r) / sd).otherwise(0.0)


def annual_return(r: Column) -> Column:
    """Aggregate: compounded to a year; 0 without returns, -1 where all is lost."""
    total, n = F.product(1 + r), F.count(r)
    return F.when(n == 0, 0.0).when(total <= 0, -1.0).otherwise(F.pow(total, F.lit(float(DAYS_PER_YEAR)) / n) - 1)


def max_drawdown(daily: DataFrame, ret: str = "ret", keys: Keys = ()) -> DataFrame:
    """keys, max_drawdown of the compounded series."""
    curve = daily.where(F.col(ret).isNotNull()).withColumn("_e", equity_curve(F.col(ret), keys))
    return curve.withColumn("_d", drawdown(F.col("_e"), keys)).groupBy(*keys).agg(F.coalesce(F.min("_d"), F.lit(0.0)).alias("max_drawdown"))


def return_summary(daily: DataFrame, ret: str = "ret", keys: Keys = (), guarded: bool = False) -> DataFrame:
    """keys, sharpe, annual_return, max_drawdown, n_days. guarded: with fewer than two returns or without a spread all three figures are 0, the rule of scores."""
    r = F.col(ret)
    curve = daily.select(*keys, "date", r).withColumn("_e", F.when(r.isNotNull(), equity_curve(F.coalesce(r, F.lit(0.0)), keys)))
    some = (F.stddev_samp(r) > NO_SPREAD) | F.lit(not guarded)
    figures = {"sharpe": sharpe(r), "annual_return": annual_return(r), "max_drawdown": F.coalesce(F.min("_d"), F.lit(0.0))}
    held = curve.withColumn("_d", drawdown(F.col("_e"), keys))
    return held.groupBy(*keys).agg(*[F.when(some, c).otherwise(0.0).alias(n) for n, c in figures.items()], F.count(r).alias("n_days"))


def vw_benchmark(df: DataFrame, label: str = "forward_returns", cap: str = "market_cap") -> DataFrame:
    """date, ret, equity: the cap-weighted return (caps of all names; a missing product counts 0), the plain mean where no cap is known."""
    daily = df.groupBy("date").agg(F.coalesce(F.try_divide(F.coalesce(F.sum(F.col(label) * F.col(cap)), F.lit(0.0)), F.sum(cap)), F.avg(label)).alias("ret"))
    return daily.withColumn("equity", equity_curve(F.coalesce("ret", F.lit(0.0))))


def pooled_beta(df: DataFrame, signal: str, composite: str) -> DataFrame:
    """beta over joint cells, no intercept; 0 without a positive denominator."""
    s, c = F.col(signal), F.col(composite)
    joint = df.where(s.isNotNull() & c.isNotNull())
    return joint.agg(F.when(F.sum(c * c) > 0, F.sum(s * c) / F.sum(c * c)).otherwise(0.0).alias("beta"))
