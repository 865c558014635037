"""Sparse observations on the grid: as-of fills, span links, quarterly characteristics, monthly signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import drop_duplicates_keep_last
from ..sources.writers import materialized

#: Days of a stretch of time by which rows and spans meet.
SPAN_DAYS = 1024


def asof_fill(obs: DataFrame, grid: DataFrame, values: list[str], member: str | None = "member", carry: DataFrame | None = None) -> DataFrame:
    """grid with the last observation at or before each date, per symbol and value; never filled backwards.

    Observations off the calendar count, as they are put between the grid's rows before filling. Two phases: rows are filled within symbol and year, so no
    task sorts a symbol's whole history, and where a year has none so far, the last value of the years before comes from a table with a row per symbol and
    year. `carry` (symbol and values, as `carried` gives it) stands for all observations before those given: a new year's grid needs that year's
    observations and the carry, not the history.
    """
    year = F.year("date")
    rows = obs.select("date", "symbol", *values, F.lit(0).alias("_grid"), year.alias("_year"))
    empty = {v: F.lit(None).cast(obs.schema[v].dataType) for v in values}
    cells = grid.drop(*values).withColumns(empty | {"_grid": F.lit(1), "_year": year})
    both = cells.unionByName(rows, allowMissingColumns=True)
    order = Window.partitionBy("symbol", "_year").orderBy("date", "_grid").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumns({v: F.last(v, ignorenulls=True).over(order) for v in values}).where(F.col("_grid") == 1).drop("_grid")
    before = _before_years(obs, grid, values, carry)
    filled = filled.join(before, (F.col("symbol") == F.col("_of")) & (F.col("_year") == F.col("_into")), "left")
    known = {v: F.coalesce(F.col(v), F.col(f"_b{i}")) for i, v in enumerate(values)}
    return filled.withColumns({v: F.when(F.col(member), x) if member else x for v, x in known.items()}).select(*cells.drop("_grid", "_year").columns)


def _last_of_year(obs: DataFrame, values: list[str]) -> DataFrame:
    """symbol, year, values: the last of each value within the year; an aggregate, so most of it happens before rows move."""
    return obs.groupBy("symbol", F.year("date").alias("year")).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("date"))).alias(v) for v in values])


def _before_years(obs: DataFrame, grid: DataFrame, values: list[str], carry: DataFrame | None) -> DataFrame:
    """_of, _into, _b0, ...: what is known of a symbol when a year of the grid begins."""
    span = grid.agg(F.year(F.min("date")).alias("_lo"), F.year(F.max("date")).alias("_hi"))
    lasts = _last_of_year(obs.where(F.col("date").isNotNull()), values).join(F.broadcast(span), F.lit(True))
    if carry is not None:
        lasts = carry.select("symbol", F.lit(0).alias("year"), *values).join(F.broadcast(span), F.lit(True)).unionByName(lasts)
    line = Window.partitionBy("symbol").orderBy("year")
    so_far = {f"_b{i}": F.last(v, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)) for i, v in enumerate(values)}
    lasts = lasts.withColumns(so_far | {"_next": F.lead("year").over(line)})
    first, last = F.greatest(F.col("year") + 1, F.col("_lo")), F.least(F.coalesce("_next", "_hi"), "_hi")  # the years that begin with these values
    years = F.when(first <= last, F.sequence(first, last))
    return lasts.select(F.col("symbol").alias("_of"), F.explode(years).alias("_into"), *so_far)


def carried(obs: DataFrame, values: list[str], carry: DataFrame | None = None) -> DataFrame:
    """symbol, values: the last of each value after all observations given, and after those that an earlier carry stands for."""
    rows = obs.select("symbol", "date", *values)
    if carry is not None:
        rows = rows.unionByName(carry.select("symbol", F.to_date(F.lit("0001-01-01")).alias("date"), *values))
    return rows.groupBy("symbol").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("date"))).alias(v) for v in values])


def build_spans(facts: DataFrame, group: str, symbol: str, date: str) -> DataFrame:
    """Per pair of ids the first and last date that they were seen together."""
    return facts.where(F.col(group).isNotNull() & F.col(symbol).isNotNull()).groupBy(group, symbol).agg(F.min(date).alias("start"), F.max(date).alias("end"))


def link_by_span(rows: DataFrame, spans: DataFrame, group: str, date: str = "eff_date", slack: int = 400, days: int = SPAN_DAYS) -> DataFrame:
    """rows with every symbol whose span, widened by `slack` days, holds their date.

    Time is cut into stretches of `days`: a span stands in every stretch that it reaches into, a row in the one of its date, and they meet by group and
    stretch. So a group with very many rows and spans is shared by many tasks, each looking only at spans near in time; a row is in one stretch, so no
    pair is found twice.
    """
    names = [c for c in ("_stretch", "__stretch", "___stretch") if c not in rows.columns + spans.columns]
    stretch = lambda c: F.floor(F.unix_date(c) / days)
    lo, hi = F.date_sub("start", slack), F.date_add("end", slack)
    reached = spans.where(lo <= hi).withColumn(names[0], F.explode(F.sequence(stretch(lo), stretch(hi))))
    near = (F.col(date) >= lo) & (F.col(date) <= hi)
    return rows.withColumn(names[0], stretch(F.col(date).cast("date"))).join(reached, [group, names[0]]).where(near).drop(names[0])


def best_match(linked: DataFrame, keys: list[str], universe: DataFrame, symbol: str, date: str = "eff_date") -> DataFrame:
    """One symbol per key: within its span first, then in the universe, then nearest to the span's middle, then the smallest.

    An aggregate: of a key's candidates each task sends one.
    """
    known = universe.select(symbol).distinct().withColumn("in_universe", F.lit(True))
    out = linked.join(known, symbol, "left").withColumn("in_universe", F.coalesce("in_universe", F.lit(False)))
    out = out.withColumn("in_span", F.coalesce((F.col(date) >= F.col("start")) & (F.col(date) <= F.col("end")), F.lit(False)))
    twice = F.abs(2 * F.datediff(date, "start") - F.datediff("end", "start"))  # twice the distance to the middle, in whole days
    order = F.struct(~F.col("in_span"), ~F.col("in_universe"), twice, F.col(symbol))
    return out.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*out.columns), order).alias("_best")).select("_best.*")


def effective_date(report: Column, period: Column, days: int = 90) -> Column:
    return F.coalesce(report, F.date_add(period, days))


def lag_quarters(c: Column, k: int, symbol: str = "symbol", period: str = "datadate") -> Column:
    return F.lag(c, k).over(Window.partitionBy(symbol).orderBy(period))


def characteristics(q: DataFrame) -> DataFrame:
    """symbol, date (effective) and the 17 characteristics of linked quarterly rows; a zero denominator gives null."""
    c, d = F.col, F.try_divide
    cap = F.abs(c("prccq")) * c("cshoq")
    gross, capital = c("revtq") - c("cogsq"), (c("actq") - c("cheq")) - c("lctq")
    before = lag_quarters(c("ibq"), 4)
    found = {
        "cs_gp_at": d(gross, c("atq")),
        "cs_roa": d(c("niq"), c("atq")),
        "cs_roe": d(c("niq"), c("ceqq")),
        "cs_opmargin": d(c("oiadpq"), c("saleq")),
        "cs_gpmargin": d(gross, c("revtq")),
        "cs_leverage": d(c("ltq"), c("atq")),
        "cs_debt_at": d(c("dlttq"), c("atq")),
        "cs_current_ratio": d(c("actq"), c("lctq")),
        "cs_cash_at": d(c("cheq"), c("atq")),
        "cs_bm": d(c("ceqq"), cap),
        "cs_ep": d(c("ibq"), cap),
        "cs_sp": d(c("saleq"), cap),
        "cs_rd_sale": d(c("xrdq"), c("saleq")),
        "cs_asset_growth": d(c("atq"), lag_quarters(c("atq"), 4)) - 1,
        "cs_sales_growth": d(c("saleq"), lag_quarters(c("saleq"), 4)) - 1,
        "cs_earnings_growth": d(c("ibq") - before, F.abs(before)),
        "cs_accruals": d(capital - lag_quarters(capital, 1), c("atq")),
    }
    return q.select("symbol", c("eff_date").alias("date"), "datadate", *[v.alias(k) for k, v in found.items()])


def to_daily(obs: DataFrame, grid: DataFrame, values: list[str], sequence: str, member: str | None = "member") -> DataFrame:
    """Observations of symbols of the grid, the last per symbol and date, carried forward onto it."""
    known = obs.join(grid.select("symbol").distinct(), "symbol", "left_semi")
    return asof_fill(drop_duplicates_keep_last(known, ["symbol", "date"], sequence), grid, values, member)


def month_end_plus_one(yyyymm: Column) -> Column:
    """The day after the month's end, from yyyymm or anything that begins with yyyy-mm."""
    month = F.substring(F.regexp_replace(yyyymm.cast("string"), "-", ""), 1, 6)
    return F.date_add(F.last_day(F.try_to_timestamp(month, F.lit("yyyyMM")).cast("date")), 1)


def sanitize_name(name: Column, prefix: str = "osap_") -> Column:
    return F.concat(F.lit(prefix), F.lower(F.trim(F.regexp_replace(name, "[^0-9a-zA-Z]+", "_"), F.lit("_"))))


# Names of id and date columns.
ID_NAMES, DATE_NAMES = ("permno", "PERMNO", "symbol"), ("yyyymm", "date", "DATE", "eom")


def detect_columns(names: list[str]) -> tuple[str, str]:
    """The id and date columns of a monthly file."""
    symbol = next((c for c in ID_NAMES if c in names), None)
    date = next((c for c in DATE_NAMES if c in names), None)
    if symbol is None or date is None:
        raise ValueError(f"no id or date column among {names[:8]}")
    return symbol, date


def ingest_monthly(wide: DataFrame, grid: DataFrame, signals: list[str], sequence: str, min_coverage: float = 0.20, min_breadth: float = 100, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(grid with the qualifying signals carried forward, manifest of all: field, coverage, median_breadth, qualifies).

    All signals go through one fill. A monthly value counts from the day after its month's end on.
    """
    from .screen import coverage_report, qualifies

    symbol, date = detect_columns(wide.columns)
    span = grid.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    rows = wide.select(F.col(symbol).cast("bigint").alias("symbol"), month_end_plus_one(F.col(date)).alias("date"), F.col(sequence).alias("_seq"), *signals)
    rows = rows.join(F.broadcast(span), F.lit(True)).where((F.col("date") >= F.col("_lo")) & (F.col("date") <= F.date_add("_hi", 40))).drop("_lo", "_hi")
    filled = materialized(to_daily(rows, grid, signals, "_seq"), "filled")  # the manifest and the result read it
    manifest = coverage_report(filled, signals).withColumn("qualifies", qualifies(min_coverage, min_breadth))
    keep = [r["field"] for r in manifest.where("qualifies").orderBy(F.desc("coverage"), "field").select("field").collect()]  # names of columns
    keep = keep[:most] if most else keep
    return filled.select(*[c for c in filled.columns if c not in signals or c in keep]), manifest
