"""Tables about runs: the catalogue's filters and statistics, funnels, token costs, comparison of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a catalogue may be ordered by.
ORDERS = ("is_ic", "is_icir", "is_tstat", "is_sharpe", "turnover", "coverage", "created_at")


def catalogue_filter(catalogue: DataFrame, min_ic: float | None = None, min_icir: float | None = None, min_tstat: float | None = None, min_sharpe: float | None = None, max_turnover: float | None = None, min_coverage: float | None = None, order_by: str | None = None, descending: bool = True, limit: int | None = None) -> DataFrame:
    """Rows with status ok within the bounds (absolute values of signed metrics); a null metric passes no bound on it."""
    out = catalogue.where(F.col("status") == "ok")
    for name, bound in (("is_ic", min_ic), ("is_icir", min_icir), ("is_tstat", min_tstat), ("is_sharpe", min_sharpe)):
        out = out if bound is None else out.where(F.abs(name) >= bound)
    out = out if max_turnover is None else out.where(F.col("turnover") <= max_turnover)
    out = out if min_coverage is None else out.where(F.col("coverage") >= min_coverage)
    if order_by is not None:
        if order_by not in ORDERS:
            raise ValueError(f"can't order by {order_by!r}")
        out = out.orderBy(F.desc(order_by) if descending else F.asc(order_by), "hash")
    return out if limit is None else out.limit(limit)


def catalogue_stats(catalogue: DataFrame) -> DataFrame:
    """status, n; the row with the null status is the total."""
    return catalogue.rollup("status").agg(F.count(F.lit(1)).alias("n"))


def token_cost(rows: DataFrame, prices: DataFrame, default: tuple[float, float] = (5.0, 30.0)) -> DataFrame:
    """rows with cost: tokens at the model's price per million; an unknown model costs the default, which is the dearest. prices: a row per model."""
    price = prices.select("model", "prompt_price", "completion_price")
    out = rows.join(price, "model", "left")
    million = F.lit(1e6)
    cost = F.col("prompt_tokens") / million * F.coalesce("prompt_price", F.lit(default[0])) + F.col("completion_tokens") / million * F.coalesce("completion_price", F.lit(default[1]))
    return out.withColumn("cost", cost).drop("prompt_price", "completion_price")


def per_expression_tokens(tokens: Column, expressions: Column) -> Column:
    """A batch's tokens shared by its expressions, rounded half to even."""
    return F.bround(tokens / F.greatest(F.lit(1), F.size(expressions)), 0).cast("bigint")


def reject_funnel(rows: DataFrame, reasons: list[str]) -> DataFrame:
    """One row of counts over tried expressions (idea, batch, status, reason, tokens, cost): ideas, batches, evaluated, stored, dup, one column per reason, tokens, cost, cost per stored one."""
    is_ = lambda s: F.sum((F.col("status") == s).cast("bigint"))
    stored = is_("ok")
    return rows.agg(
        F.countDistinct("idea").alias("ideas"),
        F.countDistinct("batch").alias("batches"),
        F.sum((F.col("status") != "duplicate").cast("bigint")).alias("evaluated"),
        stored.alias("stored"),
        is_("duplicate").alias("dup"),
        *[F.sum(((F.col("status") == "reject") & (F.col("reason") == r)).cast("bigint")).alias(f"reject_{r}") for r in reasons],
        F.sum("tokens").alias("tokens"),
        F.sum("cost").alias("cost"),
        F.coalesce(F.try_divide(F.sum("cost"), stored), F.lit(0.0)).alias("cost_per_stored"),
    )


def headline_rows(runs: DataFrame) -> DataFrame:
    """source and the figures of each run's row with method equal, or else its best row; runs without either are left out.

    runs: params.source, n_survivors, factory.est_cost_usd, portfolio.rows (array), portfolio.best.
    """
    equal = F.get(F.filter("portfolio.rows", lambda r: r["method"] == "equal"), 0)
    row = F.coalesce(equal, F.col("portfolio.best"))
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    out = runs.select(F.col("params.source").alias("source"), row.alias("row"), zero(F.col("n_survivors")).alias("n_survivors"), zero(F.col("factory.est_cost_usd")).alias("cost")).where(F.col("row").isNotNull())
    return out.select("source", *[zero(F.col(f"row.{c}")).alias(c) for c in ("sharpe", "ic", "annual_return")], "n_survivors", "cost")


def compare_sources(rows: DataFrame) -> DataFrame:
    """Per source the number of runs, and means and population deviations of its headline rows."""
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.avg("sharpe").alias("sharpe_mean"),
        F.stddev_pop("sharpe").alias("sharpe_std"),
        F.avg("ic").alias("ic_mean"),
        F.stddev_pop("ic").alias("ic_std"),
        F.avg("annual_return").alias("annual_return_mean"),
        F.avg("n_survivors").alias("n_survivors_mean"),
        F.avg("cost").alias("cost_mean"),
    )
