"""Quantile long-short backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import average_rank, quantile_bucket
from ..functions.elementwise import clip
from ..sources.writers import materialized
from .metrics import NO_SPREAD, Keys, ic_summary, return_summary, turnover


def buckets(df: DataFrame, signal: str, label: str, q: int = 5, keys: Keys = ()) -> DataFrame:
    """keys, date, bucket, ret (clipped), _n, _sd of the joint cells."""
    by = (*keys, "date")
    cells = df.where(F.col(signal).isNotNull() & F.col(label).isNotNull())
    over = Window.partitionBy(*by)
    return cells.select(*by, quantile_bucket(F.col(signal), q, by).alias("bucket"), clip(F.col(label)).alias("ret"), F.count(F.lit(1)).over(over).alias("_n"), F.stddev_samp(signal).over(over).alias("_sd"))


def long_short(df: DataFrame, signal: str, label: str, q: int = 5, keys: Keys = ()) -> DataFrame:
    """keys, date, ret for every date of df: mean of the top bucket less that of the bottom one; 0 on thin or constant days."""
    by = (*keys, "date")
    daily = buckets(df, signal, label, q, keys).where((F.col("_n") >= 2 * q) & (F.col("_sd") >= NO_SPREAD)).groupBy(*by)
    daily = daily.agg((F.avg(F.when(F.col("bucket") == q, F.col("ret"))) - F.avg(F.when(F.col("bucket") == 1, F.col("ret")))).alias("ret"))
    return df.select(*by).distinct().join(daily, list(by), "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))


def quantile_returns(df: DataFrame, signal: str, label: str, q: int = 5, keys: Keys = ()) -> DataFrame:
    """keys, bucket, mean_return (mean of daily means), n_days."""
    rows = buckets(df, signal, label, q, keys).where((F.col("_n") >= 2 * q) & (F.col("_sd") >= NO_SPREAD))
    daily = rows.groupBy(*keys, "date", "bucket").agg(F.avg("ret").alias("_r"))
    return daily.groupBy(*keys, "bucket").agg(F.avg("_r").alias("mean_return"), F.count(F.lit(1)).alias("n_days"))


def book_figures(df: DataFrame, signal: str, label: str, q: int = 5, keys: Keys = ()) -> DataFrame:
    """keys, date, ic, n (joint cells), ret (of long_short) for every date of df, all from one exchange by keys and date."""
    by = (*keys, "date")
    over = Window.partitionBy(*by)
    joint = F.col(signal).isNotNull() & F.col(label).isNotNull()
    cells = df.select(*by, "symbol", F.when(joint, F.col(signal)).alias("_x"), F.when(joint, F.col(label)).alias("_y"))
    x, y = F.col("_x"), F.col("_y")
    ranked = cells.select(*by, quantile_bucket(x, q, by).alias("_b"), clip(y).alias("_r"), average_rank(x, by).alias("_rx"), average_rank(y, by).alias("_ry"), F.stddev_samp(x).over(over).alias("_sd"))
    ic = F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))
    spread = F.avg(F.when(F.col("_b") == q, F.col("_r"))) - F.avg(F.when(F.col("_b") == 1, F.col("_r")))
    enough = (F.count("_rx") >= 2 * q) & (F.max("_sd") >= NO_SPREAD)
    return ranked.groupBy(*by).agg(ic.alias("ic"), F.count("_rx").alias("n"), F.when(enough, F.coalesce(spread, F.lit(0.0))).otherwise(0.0).alias("ret"))


def portfolio_metrics(df: DataFrame, signal: str, label: str, min_stocks: int = 20, q: int = 5, keys: Keys = ()) -> DataFrame:
    """keys, ic, icir, sharpe, annual_return, max_drawdown, turnover of signals."""
    daily = materialized(book_figures(df, signal, label, q, keys), "book")
    out = ic_summary(daily.withColumn("ic", F.when(F.col("n") >= min_stocks, F.col("ic"))), keys=keys).select(*keys, "ic", "icir")
    for part in (return_summary(daily, keys=keys).drop("n_days"), turnover(df, signal, keys)):
        out = out.join(part, list(keys)) if keys else out.join(part, F.lit(True))
    return out
