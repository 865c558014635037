"""Shared shapes over the given tables, once for Spark and once as SQL, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timeseries import by_time, so_far
from ..operators.universe import forward_returns
from ..sources.readers import densify
from ..sources.writers import dealt, materialized
from ..sources.writers import scratch_path as scratch  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
IS_END = "1999-12-31"
MIN_STOCKS = 20
#: Prices over quantities often lie just between two values of six digits, where engines round differently; this moves them off.
OFF_EDGE = 3.71828e-8


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows where SQL can."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def both(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run SQL that Spark and DuckDB share over the named tables."""
    return spark.sql(sql.format(**{t: "{" + t + "}" for t in tables}), **{t: table(spark, sf_dir, t) for t in tables})


def r6(c: Column | str) -> Column:
    """Rounded for comparison, off the edges of rounding; a negative zero becomes zero."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(OFF_EDGE), 6) + F.lit(0.0)


def q6(sql: str) -> str:
    return f"(round(({sql}) + {OFF_EDGE}, 6) + 0.0)"



def week() -> Column:
    return F.date_trunc("week", "l_shipdate").cast("date")


def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of weekly_facts."""
    return table(spark, sf_dir, "lineitem").select(week().alias("date"))


def weekly_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are dealt out by symbol before they are added up, so that everything along time that follows stays where it is."""
    li = dealt(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount"), "l_suppkey")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return li.groupBy(week().alias("date"), F.col("l_suppkey").alias("symbol")).agg(
        F.round(F.avg(price) + OFF_EDGE, 6).alias("close"),
        F.round(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")) + OFF_EDGE, 6).alias("open"),
        F.round(F.max(price) + OFF_EDGE, 6).alias("high"),
        F.round(F.min(price) + OFF_EDGE, 6).alias("low"),
        F.round(F.sum("l_quantity") + OFF_EDGE, 6).alias("volume"),
        F.round(F.sum("l_extendedprice") + OFF_EDGE, 6).alias("dollar_volume"),
        F.count(F.lit(1)).cast("double").alias("num_trades"),
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("int").alias("sector"))
    return table(spark, sf_dir, "supplier").join(F.broadcast(nation), "s_nationkey").select(F.col("s_suppkey").alias("symbol"), "sector")  # 25 nations


def panel_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier by week of shipment: a dense grid with prices, volumes, sector, membership, returns and the label."""
    grid = densify(weekly_facts(spark, sf_dir), days=weeks(spark, sf_dir)).join(sectors(spark, sf_dir), "symbol", "left")
    filled = F.last("close", ignorenulls=True).over(so_far())
    grid = grid.withColumns({"market_cap": F.col("dollar_volume"), "member": F.col("close").isNotNull(), "_f": filled})
    grid = grid.withColumn("returns", F.try_divide(F.col("_f"), F.lag("_f", 1).over(by_time())) - 1).drop("_f")
    return forward_returns(grid)


PANEL_W = """
WITH facts AS (
    SELECT date_trunc('week', l_shipdate)::DATE AS date, l_suppkey AS symbol,
           round(avg(l_extendedprice / l_quantity) + 3.71828e-8, 6) AS close,
           round(avg(l_extendedprice * (1 - l_discount) / l_quantity) + 3.71828e-8, 6) AS open,
           round(max(l_extendedprice / l_quantity) + 3.71828e-8, 6) AS high, round(min(l_extendedprice / l_quantity) + 3.71828e-8, 6) AS low,
           round(sum(l_quantity) + 3.71828e-8, 6) AS volume, round(sum(l_extendedprice) + 3.71828e-8, 6) AS dollar_volume, count(*)::DOUBLE AS num_trades
    FROM lineitem GROUP BY 1, 2),
cal AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS t FROM (SELECT DISTINCT date FROM facts)),
sec AS (SELECT s_suppkey AS symbol, n_regionkey::INT AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey),
grid AS (
    SELECT cal.date, cal.t, s.symbol, close, open, high, low, volume, dollar_volume, num_trades, dollar_volume AS market_cap, sector,
           close IS NOT NULL AS member, last_value(close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY cal.t) AS f
    FROM cal CROSS JOIN (SELECT DISTINCT symbol FROM facts) s
    LEFT JOIN facts ON facts.date = cal.date AND facts.symbol = s.symbol LEFT JOIN sec ON sec.symbol = s.symbol),
rets AS (SELECT *, f / nullif(lag(f) OVER (PARTITION BY symbol ORDER BY t), 0) - 1 AS returns FROM grid),
panel AS (SELECT *, CASE WHEN member THEN lead(returns) OVER (PARTITION BY symbol ORDER BY t) END AS forward_returns FROM rets)
"""


def avg_rank_sql(x: str, by: str = "date") -> str:
    """Average rank of the non-null x within the columns `by`."""
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END"


def pct_rank_sql(x: str, by: str = "date") -> str:
    return f"({avg_rank_sql(x, by)}) / count({x}) OVER (PARTITION BY {by})"


#: A few signals on the weekly panel: (id, formula, SQL over the panel with R(w) and P windows).
R = "OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
P = "OVER (PARTITION BY symbol ORDER BY t)"
SIGNALS = {
    "delta": (("ts_delta_5", "close"), f"close - lag(close, 5) {P}"),
    "mean": (("ts_mean_5", "volume"), f"avg(volume) {R.format(4)}"),
    "spread": (("safe_div", ("sub", "high", "low"), "close"), "(high - low) / nullif(close, 0)"),
    "range": (("ts_maxmin_scale_20", "close"), f"(close - min(close) {R.format(19)}) / nullif(max(close) {R.format(19)} - min(close) {R.format(19)}, 0)"),
    "trades": (("neg", ("ts_sum_5", "num_trades")), f"-(sum(num_trades) {R.format(4)})"),
}
_ONE = "SELECT '{}' AS signal_id, date, t, symbol, market_cap, forward_returns, round({}, 12) AS value FROM panel"
KEPT = ("date", "t", "symbol", "market_cap", "forward_returns")
LONG = PANEL_W + ", long AS (" + " UNION ALL ".join(_ONE.format(k, s) for k, (_, s) in SIGNALS.items()) + ")"


def signals_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, t, symbol, market_cap, forward_returns and a column per signal of SIGNALS, evaluated once in one plan and written."""
    from ..plans.evaluate import signal_columns

    wide = signal_columns(panel_w(spark, sf_dir), {k: f for k, (f, _) in SIGNALS.items()})
    return materialized(wide.select(*KEPT, *[F.round(k, 12).alias(k) for k in SIGNALS]), "signals")


def as_long(wide: DataFrame) -> DataFrame:
    """signal_id, date, t, symbol, market_cap, forward_returns, value. Rows of a cell follow each other; only the wide ones are on disk."""
    cells = F.array(*[F.struct(F.lit(k).alias("signal_id"), F.col(k).alias("value")) for k in SIGNALS])
    return wide.select(*KEPT, F.inline(cells)).select("signal_id", *KEPT, "value")


def signals_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(signals_wide(spark, sf_dir))


def signal_scores(wide: DataFrame) -> DataFrame:
    """The metrics of SIGNALS."""
    from ..plans.score import score_columns

    return score_columns(wide, [*SIGNALS], 3, min_stocks=MIN_STOCKS)


def ic_sql(rows: str, by: str = "date", least: int = MIN_STOCKS) -> str:
    """SELECT by..., ic from rows with columns x, y."""
    ranked = f"SELECT {by}, {avg_rank_sql('x', by)} AS rx, {avg_rank_sql('y', by)} AS ry FROM ({rows}) WHERE x IS NOT NULL AND y IS NOT NULL"
    return f"SELECT * FROM (SELECT {by}, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS ic, count(*) AS n FROM ({ranked}) GROUP BY {by}) WHERE n >= {least} AND ic IS NOT NULL"


def long_short_sql(rows: str, by: str = "date", q: int = 5) -> str:
    """SELECT by..., ret from rows with columns x, y, symbol: the quantile long-short return, 0 on thin and constant days."""
    k = f"row_number() OVER (PARTITION BY {by} ORDER BY x, symbol) - 1"
    cells = f"SELECT {by}, y, {k} AS k, count(*) OVER (PARTITION BY {by}) AS n, stddev_samp(x) OVER (PARTITION BY {by}) AS sd FROM ({rows}) WHERE x IS NOT NULL AND y IS NOT NULL"
    bucketed = f"SELECT {by}, least(greatest(y, -0.95), 1.0) AS y, greatest(1, ceil(k * {q}.0 / (n - 1)))::INT AS b FROM ({cells}) WHERE n >= {2 * q} AND sd >= 1e-12"
    daily = f"SELECT {by}, avg(y) FILTER (b = {q}) - avg(y) FILTER (b = 1) AS ret FROM ({bucketed}) GROUP BY {by}"
    return f"SELECT {by}, coalesce(ret, 0.0) AS ret FROM (SELECT DISTINCT {by} FROM ({rows})) LEFT JOIN ({daily}) USING ({by})"


def returns_sql(daily: str, by: str = "", guarded: bool = False) -> str:
    """sharpe, annual_return, max_drawdown, n_days of SELECT by, date, ret."""
    some = "stddev_samp(ret) > 1e-12 AND" if guarded else ""
    part, group, key = (f"PARTITION BY {by}", f"GROUP BY {by}", f"{by}, ") if by else ("", "", "")
    curve = f"SELECT {key}date, ret, product(1 + ret) OVER ({part} ORDER BY date) AS e FROM ({daily})"
    down = f"SELECT {key}ret, (e - max(e) OVER ({part} ORDER BY date)) / nullif(max(e) OVER ({part} ORDER BY date), 0) AS d FROM ({curve})"
    return f"""SELECT {key}CASE WHEN stddev_samp(ret) > 1e-12 THEN sqrt(252) * avg(ret) / stddev_samp(ret) ELSE 0.0 END AS sharpe,
        CASE WHEN {some} count(ret) > 0 THEN CASE WHEN product(1 + ret) <= 0 THEN -1.0 ELSE pow(product(1 + ret), 252.0 / count(ret)) - 1 END ELSE 0.0 END AS annual_return,
        CASE WHEN {some} count(ret) > 0 THEN coalesce(min(d), 0.0) ELSE 0.0 END AS max_drawdown, count(ret) AS n_days FROM ({down}) {group}"""


def turnover_sql(rows: str, by: str = "") -> str:
    """turnover per `by` of rows with by, date, t, symbol, x."""
    key = f"{by}, " if by else ""
    u = f"SELECT {key}date, t, symbol, {pct_rank_sql('x', f'{key}date')} AS u FROM ({rows})"
    moved = f"SELECT {key}date, abs(u - lag(u) OVER (PARTITION BY {key}symbol ORDER BY t)) AS m FROM ({u})"
    return f"SELECT {key}avg(m) AS turnover FROM (SELECT {key}date, avg(m) AS m FROM ({moved}) GROUP BY {key}date) {f'GROUP BY {by}' if by else ''}"
