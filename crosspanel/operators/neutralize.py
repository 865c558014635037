"""Neutralisation of a signal: within sectors, or against characteristics by a regression per date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crosssection import cs_rank, cs_zscore, group_demean
from ..functions.timeseries import by_time, ts_returns, ts_std
from ..sources.readers import fields

# Trading data, which is no characteristic.
PRICE_FIELDS = ("open", "high", "low", "close", "volume", "returns", "bid", "ask", "dollar_volume", "num_trades", "price")

#: Share of a pivot's first value below which a characteristic counts as explained by those before it.
NO_PIVOT = 1e-9


def zscore_neutralize(df: DataFrame, signal: str) -> DataFrame:
    return df.withColumn(signal, cs_zscore(F.col(signal)))


def sector_neutralize(df: DataFrame, signal: str, sector: str = "sector") -> DataFrame:
    return df.withColumn(signal, group_demean(F.col(signal), F.col(sector)))


def neutralization_basis(panel: DataFrame) -> tuple[DataFrame, list[str]]:
    """panel with vol60 and ret21, and the names of the basis: every field but trading data, and those two."""
    enough = F.count("returns").over(by_time().rowsBetween(-59, 0)) >= 20
    out = panel.withColumns({"vol60": F.when(enough, ts_std(F.col("returns"), 60)), "ret21": ts_returns(F.col("close"), 21)})
    return out, [c for c in fields(panel) if c not in PRICE_FIELDS] + ["vol60", "ret21"]


def characteristic_neutralize(df: DataFrame, signal: str, characteristics: list[str], min_names: int = 20) -> DataFrame:
    """date, symbol, value: per date the residual of least squares on 1 and the characteristics' percentile ranks (missing: the middle).

    Dates with fewer than min_names names are missing throughout. The normal equations of a date are sums over its names, and are solved by elimination in the
    row of the date; the sums are about the middle of the ranks, and a characteristic that those before it explain (its pivot is next to nothing
    of what it was) gets no slope, so that dependent columns do no harm. A date's names are never gathered.
    """
    m = len(characteristics)
    xs = [f"_x{i}" for i in range(m)]
    ranks = df.select("date", "symbol", F.col(signal).alias("_y"), *[(F.coalesce(cs_rank(F.col(c)), F.lit(0.5)) - 0.5).alias(x) for c, x in zip(characteristics, xs, strict=True)])
    have = F.col("_y").isNotNull()
    means = ranks.groupBy("date").agg(F.count("_y").alias("_n"), F.avg("_y").alias("_my"), *[F.avg(F.when(have, F.col(x))).alias(f"_m{x}") for x in xs])
    centred = ranks.join(means, "date").select("date", "symbol", "_n", (F.col("_y") - F.col("_my")).alias("_y"), *[(F.col(x) - F.col(f"_m{x}")).alias(x) for x in xs])
    columns = [F.when(F.col("_y").isNotNull(), F.col(x)) for x in xs]
    table = [[F.sum(columns[i] * F.col(xs[j])) if j < m else F.sum(columns[i] * F.col("_y")) for j in range(m + 1)] for i in range(m)]
    sums = centred.groupBy("date").agg(F.array(*[F.array(*row) for row in table]).cast("array<array<double>>").alias("_a"))
    fit = sums.select("date", F.transform(_eliminated(F.col("_a"), m), lambda r: F.element_at(r, -1)).alias("_b"))
    explained = sum((F.col("_b")[i] * F.col(x) for i, x in enumerate(xs)), F.lit(0.0))
    return centred.join(fit, "date").select("date", "symbol", F.when(F.col("_n") >= min_names, F.col("_y") - explained).alias("value"))


def _eliminated(a: Column, m: int) -> Column:
    """Rows of m equations (coefficients and right side) after elimination: the last number of a row is its solution, 0 where the pivot has vanished."""
    if not m:
        return a
    first = F.transform(a, lambda r, i: F.get(r, i))  # what the pivots are at the start

    def step(rows: Column, k: Column) -> Column:
        own = F.get(rows, k)
        pivot = F.get(own, k)
        there = pivot > NO_PIVOT * F.get(first, k)
        scaled = F.transform(own, lambda v: F.when(there, v / pivot).otherwise(0.0))
        return F.transform(rows, lambda r, i: F.when(i == k, scaled).when(there, F.zip_with(r, scaled, lambda v, s: v - F.get(r, k) * s)).otherwise(r))

    return F.aggregate(F.sequence(F.lit(0), F.lit(m - 1)), a, step)


def single_neutralize(df: DataFrame, signal: str, characteristic: str, min_names: int = 20) -> DataFrame:
    """The same for one characteristic, as a plain aggregate and join by date."""
    ranks = df.select("date", "symbol", F.col(signal).alias("_y"), F.coalesce(cs_rank(F.col(characteristic)), F.lit(0.5)).alias("_x"))
    have = F.when(F.col("_y").isNotNull(), F.col("_x"))
    fit = ranks.groupBy("date").agg(F.regr_slope("_y", have).alias("_b"), F.regr_intercept("_y", have).alias("_a"), F.count("_y").alias("_n"))
    value = F.when(F.col("_n") >= min_names, F.col("_y") - F.col("_a") - F.col("_b") * F.col("_x"))
    return ranks.join(fit, "date").select("date", "symbol", value.alias("value"))
