"""Element-wise (E), time-series (W) and cross-sectional (V) functions over the weekly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import crosssection as cs
from ..functions import elementwise as el
from ..operators import neutralize
from ..plans.evaluate import signal_columns
from ..plans.registry import WINDOWS
from .base import PANEL_W, P, R, panel_w, pct_rank_sql, q6, query, r6

_JX, _JY = "CASE WHEN volume IS NOT NULL THEN close END", "CASE WHEN close IS NOT NULL THEN volume END"
#: Number in the inventory, fields, SQL for a window; {r} is the window of w rows, {p} the ordered one, {w} its length.
_W = {
    "ts_mean": (1, "avg(close) {r}"),
    "ts_std": (2, "stddev_samp(close) {r}"),
    "ts_delta": (3, "close - lag(close, {w}) {p}"),
    "ts_rank": (4, "CASE WHEN close IS NOT NULL THEN (len(list_filter(list(close) FILTER (close IS NOT NULL) {r}, lambda v: v < close)) + (len(list_filter(list(close) FILTER (close IS NOT NULL) {r}, lambda v: v = close)) + 1) / 2.0) / count(close) {r} END"),
    "ts_min": (5, "min(close) {r}"),
    "ts_max": (6, "max(close) {r}"),
    "ts_returns": (7, "f / nullif(lag(f, {w}) {p}, 0) - 1"),
    "ts_corr": (8, "CASE WHEN count(jx) {r} >= 3 THEN covar_pop(jx, jy) {r} / nullif(stddev_pop(jx) {r} * stddev_pop(jy) {r}, 0) END"),
    "ts_shift": (9, "lag(close, {w}) {p}"),
    "ts_sum": (10, "sum(close) {r}"),
    "ts_median": (11, "quantile_cont(close, 0.5) {r}"),
    "ts_skew": (12, "CASE WHEN count(close) {r} >= 3 THEN skewness(close) {r} END"),
    "ts_kurt": (13, "CASE WHEN count(close) {r} >= 4 THEN kurtosis(close) {r} END"),
    "ts_ema": (14, "sum(close * pow(1 - 2.0 / ({w} + 1), -t)) {p} / sum(pow(1 - 2.0 / ({w} + 1), -t)) FILTER (close IS NOT NULL) {p}"),
    "ts_zscore": (15, "(close - avg(close) {r}) / nullif(stddev_samp(close) {r}, 0)"),
    "ts_ir": (16, "avg(close) {r} / nullif(stddev_samp(close) {r}, 0)"),
    "ts_maxmin_scale": (17, "(close - min(close) {r}) / nullif(max(close) {r} - min(close) {r}, 0)"),
    "ts_max_diff": (18, "close - max(close) {r}"),
    "ts_min_diff": (19, "close - min(close) {r}"),
    "ts_delta_ratio": (20, "(close - lag(close, {w}) {p}) / nullif(abs(lag(close, {w}) {p}), 0)"),
    "ts_decayed_linear": (21, None),
    "ts_linear_reg": (22, "CASE WHEN count(close) {r} = {w} THEN regr_slope(close, t) {r} END"),
    "ts_cov": (23, "CASE WHEN count(jx) {r} >= 3 THEN covar_samp(jx, jy) {r} END"),
    "ts_argmax": (24, "CASE WHEN count(*) {r} = {w} AND count(close) {r} > 0 THEN (list_position(list(coalesce(close, -1e300)) {r}, max(close) {r}) - 1)::DOUBLE END"),
    "ts_argmin": (25, "CASE WHEN count(*) {r} = {w} AND count(close) {r} > 0 THEN (list_position(list(coalesce(close, 1e300)) {r}, min(close) {r}) - 1)::DOUBLE END"),
}


def _window_sql(name: str, w: int) -> str:
    form = _W[name][1]
    if name == "ts_decayed_linear":
        form = "(" + " + ".join(f"{w - i} * lag(close, {i}) {{p}}" for i in range(w)) + f") / {w * (w + 1) / 2}"
    return form.format(w=w, r=R.format(w - 1), p=P)


def _register_window(name: str) -> None:
    number, _ = _W[name]
    two = name in ("ts_corr", "ts_cov")
    source = f"(SELECT *, {_JX} AS jx, {_JY} AS jy FROM panel)" if two else "panel"
    values = ", ".join(f"{q6(_window_sql(name, w))} AS v{w}" for w in WINDOWS[name])

    @query(f"w{number:02d}_{name}", f"{PANEL_W} SELECT date, symbol, {values} FROM {source}")
    def run(spark, sf_dir) -> DataFrame:
        args = ("close", "volume") if two else ("close",)
        out = signal_columns(panel_w(spark, sf_dir), {f"v{w}": (f"{name}_{w}", *args) for w in WINDOWS[name]})
        return out.select("date", "symbol", *[r6(f"v{w}").alias(f"v{w}") for w in WINDOWS[name]])


for _name in _W:
    _register_window(_name)

#: Inventory number, SQL over x and y, where x is a return times 100 and y a price spread.
_E = {
    "add": (1, "x + y"),
    "sub": (2, "x - y"),
    "mul": (3, "x * y"),
    "safe_div": (4, "x / nullif(y, 0)"),
    "log_abs": (5, "ln(nullif(abs(x), 0))"),
    "abs_val": (6, "abs(x)"),
    "sign": (7, "sign(x)::DOUBLE"),
    "neg": (8, "-x"),
    "relu": (9, "CASE WHEN x < 0 THEN 0.0 ELSE x END"),
    "square": (10, "x * x"),
    "signed_sqrt": (11, "sign(x) * sqrt(abs(x))"),
    "cwise_max": (12, "CASE WHEN x > y THEN x ELSE y END"),
    "cwise_min": (13, "CASE WHEN x < y THEN x ELSE y END"),
    "greater": (14, "(x > y)::INT::DOUBLE"),
    "less": (15, "(x < y)::INT::DOUBLE"),
}


def _register_element(name: str) -> None:
    number, sql = _E[name]

    @query(f"e{number:02d}_{name}", f"{PANEL_W} SELECT date, symbol, {q6(sql)} AS value FROM (SELECT date, symbol, close - open AS x, high - low AS y FROM panel)")
    def run(spark, sf_dir) -> DataFrame:
        p = panel_w(spark, sf_dir).select("date", "symbol", (F.col("close") - F.col("open")).alias("x"), (F.col("high") - F.col("low")).alias("y"))
        fn = getattr(el, name)
        return p.select("date", "symbol", r6(fn(*map(F.col, "xy"[: fn.__code__.co_argcount]))).alias("value"))


for _name in _E:
    _register_element(_name)


def _cross(name: str, sql: str, column) -> None:
    @query(name, f"{PANEL_W} SELECT date, symbol, {q6(sql)} AS value FROM panel")
    def run(spark, sf_dir) -> DataFrame:
        return panel_w(spark, sf_dir).select("date", "symbol", r6(column()).alias("value"))


_C = "OVER (PARTITION BY date)"
_cross("v01_cs_rank", pct_rank_sql("num_trades"), lambda: cs.cs_rank(F.col("num_trades")))
_cross("v02_cs_zscore", f"(close - avg(close) {_C}) / nullif(stddev_samp(close) {_C}, 0)", lambda: cs.cs_zscore(F.col("close")))
_cross("v03_cs_winsorize", f"CASE WHEN close IS NOT NULL THEN least(greatest(close, quantile_cont(close, 0.01) {_C}), quantile_cont(close, 0.99) {_C}) END", lambda: cs.cs_winsorize(F.col("close")))
_cross("v04_normed_rank_diff", f"{pct_rank_sql('close')} - {pct_rank_sql('volume')}", lambda: cs.normed_rank_diff(F.col("close"), F.col("volume")))
_cross("v08_forward_returns", "forward_returns", lambda: F.col("forward_returns"))
_cross("v09_zscore_neutralize", f"(volume - avg(volume) {_C}) / nullif(stddev_samp(volume) {_C}, 0)", lambda: cs.cs_zscore(F.col("volume")))
_cross("v10_sector_neutralize", "CASE WHEN sector IS NOT NULL THEN close - avg(close) OVER (PARTITION BY date, sector) END", lambda: cs.group_demean(F.col("close"), F.col("sector")))
_cross("p02_mask", "CASE WHEN t % 2 = 0 THEN close END", lambda: el.mask(F.col("close"), F.col("t") % 2 == 0))
_cross("p08_clip_returns", "CASE WHEN returns IS NOT NULL THEN least(greatest(returns, -0.95), 1.0) END", lambda: el.clip(F.col("returns")))
_cross("p09_finite", "CASE WHEN t % 50 <> 0 THEN close END", lambda: el.finite(F.when(F.col("t") % 50 == 0, float("inf")).otherwise(F.col("close"))))


@query(
    "v05_quantile_bucket",
    f"""{PANEL_W}, k AS (SELECT date, symbol, num_trades AS x, row_number() OVER (PARTITION BY date ORDER BY num_trades NULLS LAST, symbol) - 1 AS k, count(num_trades) {_C} AS n FROM panel)
    SELECT date, symbol, {", ".join(f"CASE WHEN x IS NOT NULL THEN greatest(1, ceil(k * {q}.0 / greatest(n - 1, 1)))::INT END AS q{q}" for q in (2, 4, 5))} FROM k""",
)
def quantile_buckets(spark, sf_dir) -> DataFrame:
    return panel_w(spark, sf_dir).select("date", "symbol", *[cs.quantile_bucket(F.col("num_trades"), q).alias(f"q{q}") for q in (2, 4, 5)])


@query(
    "p10_neutralization_basis",
    f"""{PANEL_W} SELECT date, symbol, {q6("market_cap")} AS market_cap,
        {q6(f"CASE WHEN count(returns) {R.format(59)} >= 20 THEN stddev_samp(returns) {R.format(59)} END")} AS vol60, {q6(f"f / nullif(lag(f, 21) {P}, 0) - 1")} AS ret21 FROM panel""",
)
def neutralization_basis(spark, sf_dir) -> DataFrame:
    out, names = neutralize.neutralization_basis(panel_w(spark, sf_dir))
    return out.select("date", "symbol", *[r6(n).alias(n) for n in names])


@query(
    "g16_characteristic_neutralize",
    f"""{PANEL_W}, r AS (SELECT date, symbol, close AS y, coalesce({pct_rank_sql("volume")}, 0.5) AS x FROM panel),
    fit AS (SELECT date, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(y) AS n FROM r GROUP BY date)
    SELECT date, symbol, {q6("CASE WHEN n >= 20 THEN y - a - b * x END")} AS value FROM r JOIN fit USING (date)""",
)
def single_neutralize(spark, sf_dir) -> DataFrame:
    return neutralize.single_neutralize(panel_w(spark, sf_dir), "close", "volume").withColumn("value", r6("value"))


_RANKS = ("volume", "num_trades", "returns")


def _residuals_sql() -> str:
    """Least squares by turns: every rank, then the signal, less its projections on what is left of the ranks before it."""
    over, kept = "OVER (PARTITION BY date)", ["date", "symbol", "has"]
    ranks = [f"coalesce({pct_rank_sql(c)}, 0.5) AS x{i}" for i, c in enumerate(_RANKS)]
    names = [*(f"x{i}" for i in range(len(_RANKS))), "y"]
    steps = [f"r AS (SELECT date, symbol, close IS NOT NULL AS has, close AS y, count(close) {over} AS n, {', '.join(ranks)} FROM panel)", f"l0 AS (SELECT {', '.join(kept)}, n, {', '.join(f'{v} - avg({v}) FILTER (has) {over} AS {v}' for v in names)} FROM r)"]
    for k in range(len(_RANKS)):
        less = [f"{v} - x{k} * coalesce(sum({v} * x{k}) FILTER (has) {over} / nullif(sum(x{k} * x{k}) FILTER (has) {over}, 0), 0) AS {v}" if v == "y" or int(v[1:]) > k else v for v in names]
        steps.append(f"l{k + 1} AS (SELECT {', '.join(kept)}, n, {', '.join(less)} FROM l{k})")
    return f"{PANEL_W}, {', '.join(steps)} SELECT date, symbol, {q6('CASE WHEN n >= 20 AND has THEN y END')} AS value FROM l{len(_RANKS)}"


@query("g16_characteristic_neutralize_many", _residuals_sql())
def characteristic_neutralize(spark, sf_dir) -> DataFrame:
    return neutralize.characteristic_neutralize(panel_w(spark, sf_dir), "close", [*_RANKS]).withColumn("value", r6("value"))
