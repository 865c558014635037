"""Gates and scores of many signals at once, on long tables (signal_id, date, t, symbol, value, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import cs_rank
from ..sources.writers import materialized
from .backtest import book_figures, long_short
from .metrics import NO_SPREAD, daily_figures, ic_summary, rank_ic, return_summary, turnover

ID = ("signal_id",)


def quality_gate(signals: DataFrame, min_coverage: float = 0.05, min_breadth: float = 20, min_active: float = 0.30) -> DataFrame:
    """signal_id, status, coverage, median_breadth, active: all_nan, sparse, constant or ok, in that order.

    Coverage is the share of all grid cells; dates without values count as inactive.
    """
    daily = signals.groupBy("signal_id", "date").agg(F.count("value").alias("_n"), F.count(F.lit(1)).alias("_cells"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("_sd"))
    per = daily.groupBy("signal_id").agg((F.sum("_n") / F.sum("_cells")).alias("coverage"), F.percentile("_n", F.lit(0.5)).alias("median_breadth"), F.avg((F.col("_sd") > NO_SPREAD).cast("double")).alias("active"), F.sum("_n").alias("_n"))
    sparse = (F.col("coverage") < min_coverage) | (F.col("median_breadth") < min_breadth)
    status = F.when(F.col("_n") == 0, "all_nan").when(sparse, "sparse").when(F.col("active") < min_active, "constant").otherwise("ok")
    return per.select("signal_id", status.alias("status"), "coverage", "median_breadth", "active")


def signal_diagnostics(signals: DataFrame) -> DataFrame:
    """signal_id, coverage, median_breadth, rank_turnover, distinct_share (median over days), dead_days."""
    daily = signals.groupBy("signal_id", "date").agg(F.count("value").alias("_n"), F.count(F.lit(1)).alias("_cells"), F.countDistinct("value").alias("_d"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("_sd"))
    per = daily.groupBy("signal_id").agg(
        (F.sum("_n") / F.sum("_cells")).alias("coverage"),
        F.percentile("_n", F.lit(0.5)).alias("median_breadth"),
        F.percentile(F.try_divide(F.col("_d"), F.col("_n")), F.lit(0.5)).alias("distinct_share"),
        F.avg((F.col("_sd") <= NO_SPREAD).cast("double")).alias("dead_days"),
    )
    return per.join(turnover(signals, "value", ID).withColumnRenamed("turnover", "rank_turnover"), "signal_id")


def diagnosed(daily: DataFrame) -> DataFrame:
    """The same from daily figures (columns as of score.SPREAD)."""
    return daily.groupBy("signal_id").agg(
        (F.sum("n_values") / F.sum("n_cells")).alias("coverage"),
        F.percentile("n_values", F.lit(0.5)).alias("median_breadth"),
        F.percentile(F.try_divide(F.col("n_distinct"), F.col("n_values")), F.lit(0.5)).alias("distinct_share"),
        F.avg((F.col("sd") <= NO_SPREAD).cast("double")).alias("dead_days"),
        F.avg("moved").alias("rank_turnover"),
    )


def search_fitness(signals: DataFrame, label: str = "forward_returns", min_stocks: int = 20, step: int = 5, thin_above: int = 200, min_dates: int = 30, min_days: int = 10) -> DataFrame:
    """signal_id, fitness: mean IC of a whole population, on every `step`-th date where there are many; 0 with too few dates or ICs."""
    dates = signals.select("signal_id", "date").distinct().withColumn("_at", F.row_number().over(Window.partitionBy("signal_id").orderBy("date")) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("signal_id")))
    used = dates.where((F.col("_n") >= min_dates) & ((F.col("_n") <= thin_above) | (F.col("_at") % step == 0))).select("signal_id", "date")
    ic = rank_ic(signals.join(used, ["signal_id", "date"], "left_semi"), "value", label, min_stocks, ID)
    found = ic.groupBy("signal_id").agg(F.avg("ic").alias("_ic"), F.count("ic").alias("_days"))
    return signals.select("signal_id").distinct().join(found, "signal_id", "left").select("signal_id", F.when(F.col("_days") >= min_days, F.col("_ic")).otherwise(0.0).alias("fitness"))


def score_signals(signals: DataFrame, k: int = 3, label: str = "forward_returns", min_stocks: int = 20) -> DataFrame:
    """signal_id and the eight metrics of the catalogue: IC and return figures on every k-th date, turnover and coverage on all.

    One pass gives a small table with a row per signal and day, which is written; the metrics are aggregates of it.
    """
    first = signals.agg(F.min("t").alias("_first"))
    cells = signals.join(F.broadcast(first), F.lit(True))  # one row
    scored = (F.col("t") - F.col("_first")) % k == 0
    return summarised(materialized(daily_figures(cells.withColumn("_scored", scored), "value", label, ID, F.col("_scored")), "daily"), k, min_stocks)


def summarised(daily: DataFrame, k: int, min_stocks: int) -> DataFrame:
    """The eight metrics from the daily figures of signals (columns as of daily_figures)."""
    ic = F.when(F.col("n_joint") >= min_stocks, F.col("ic"))
    own = ic_summary(daily.withColumn("ic", ic), k, ID).drop("n_days")
    rest = daily.groupBy("signal_id").agg(F.avg("moved").alias("turnover"), (F.sum("n_values") / F.sum("n_cells")).alias("coverage"))
    out = rest.join(own, "signal_id").join(return_summary(daily, keys=ID, guarded=True), "signal_id")
    named = {"ic": "is_ic", "icir": "is_icir", "tstat": "is_tstat", "sharpe": "is_sharpe", "annual_return": "is_annual_return", "max_drawdown": "is_max_drawdown"}
    return out.select("signal_id", *[F.col(c).alias(n) for c, n in named.items()], "turnover", "coverage")


def best_single(scores: DataFrame) -> DataFrame:
    """The row with the largest absolute in-sample IC."""
    return scores.orderBy(F.desc(F.abs("is_ic")), "signal_id").limit(1)


def method_scores(books: DataFrame, label: str = "forward_returns", q: int = 5) -> DataFrame:
    """method, sharpe of every combination method's book, on the split that is given (the in-sample one for choosing)."""
    daily = long_short(books.withColumnRenamed("method", "signal_id"), "value", label, q, ID)
    return return_summary(daily, keys=ID).select(F.col("signal_id").alias("method"), "sharpe")


def select_headline(rows: DataFrame, fit_scores: DataFrame) -> DataFrame:
    """The row of the method that scored best in-sample; without such scores, the one with the largest test Sharpe."""
    scored = rows.join(fit_scores.select("method", F.col("sharpe").alias("_fit")), "method", "left")
    return scored.orderBy(F.desc_nulls_last("_fit"), F.desc("sharpe"), "method").limit(1).drop("_fit")


def gate_ablation(signals: DataFrame, tstats: DataFrame, thresholds: list[float], label: str = "forward_returns", min_stocks: int = 20, q: int = 5) -> DataFrame:
    """threshold, n, ic, sharpe, annual_return: the equal book of all signals with an absolute t-stat of at least the threshold; one job for all.

    A signal that passes a threshold passes all lower ones, so a cell is read once: sums and counts by the highest threshold passed, then added up from above.
    """
    rising = sorted(set(map(float, thresholds)))
    passed = sum((F.when(F.abs("is_tstat") >= x, 1).otherwise(0) for x in rising), F.lit(0))
    gates = tstats.select("signal_id", passed.alias("_passed")).where("_passed > 0")
    cells = signals.join(F.broadcast(gates), "signal_id")  # a row per signal
    value = lambda i: F.when(F.col("_passed") > i, F.col("value"))
    wide = cells.groupBy("date", "t", "symbol", label).agg(*[F.sum(value(i)).alias(f"_s{i}") for i in range(len(rising))], *[F.count(value(i)).alias(f"_c{i}") for i in range(len(rising))])
    books = F.array(*[F.struct(F.lit(x).alias("threshold"), F.try_divide(F.col(f"_s{i}"), F.col(f"_c{i}")).alias("value")) for i, x in enumerate(rising)])
    book = wide.select("date", "t", "symbol", label, F.explode(books).alias("b")).select("b.*", "date", "t", "symbol", label)
    keys = ("threshold",)
    daily = materialized(book_figures(book, "value", label, q, keys), "books")
    ic = ic_summary(daily.withColumn("ic", F.when(F.col("n") >= min_stocks, F.col("ic"))), keys=keys).select("threshold", "ic")
    figures = return_summary(daily, keys=keys).select("threshold", "sharpe", "annual_return")
    n = gates.select(F.explode(F.slice(F.array(*map(F.lit, rising)), F.lit(1), F.col("_passed"))).alias("threshold")).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"))
    return n.join(ic, "threshold").join(figures, "threshold")


def survivor_table(catalogue: DataFrame, columns: tuple[str, ...] = ("hash", "expression", "source", "is_ic", "is_icir", "is_tstat", "is_sharpe", "turnover", "coverage")) -> DataFrame:
    return catalogue.select(*columns)


def standardised(signals: DataFrame) -> DataFrame:
    """Every signal as z-scores across each date, the form in which signals are combined.

    Means and deviations are an aggregate with a row per signal and date, which is written: its size tells whether it goes to every task, so that no cell has to move.
    """
    daily = materialized(signals.groupBy("signal_id", "date").agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_sd")), "daily")
    daily = daily.select(F.col("signal_id").alias("_id"), F.col("date").alias("_date"), "_mean", "_sd")
    joined = signals.join(daily, F.col("signal_id").eqNullSafe(F.col("_id")) & F.col("date").eqNullSafe(F.col("_date")))
    return joined.withColumn("value", F.try_divide(F.col("value") - F.col("_mean"), F.col("_sd"))).select(*signals.columns)


def standardised_columns(wide: DataFrame, names: list[str]) -> DataFrame:
    """The same of signals that are columns of a written frame: means and deviations are a row per date, and no cell moves."""
    figures = [f(F.col(f"`{n}`")).alias(f"_{w}{i}") for i, n in enumerate(names) for w, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    daily = materialized(wide.groupBy("date").agg(*figures), "daily").withColumnRenamed("date", "_date")
    joined = wide.join(daily, F.col("date").eqNullSafe(F.col("_date")))
    return joined.withColumns({n: F.try_divide(F.col(f"`{n}`") - F.col(f"_mean{i}"), F.col(f"_sd{i}")) for i, n in enumerate(names)}).select(*[f"`{c}`" for c in wide.columns])


def rank_standardised(signals: DataFrame) -> DataFrame:
    return signals.withColumn("value", cs_rank(F.col("value"), ("signal_id", "date")))
