"""Who belongs to the panel when: eligibility, annual selection, masks, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What counts as eligible.
SHARE_TYPES = ("NS",)
SECURITY_TYPES = ("EQTY",)
ISSUER_TYPES = ("CORP",)
REIT_TYPES = ("REIT",)
EXCHANGES = ("N", "A", "Q")


def eligible(share: Column, security: Column, issuer: Column, exchange: Column, incorporated: Column, include_reits: bool = True) -> Column:
    """All five membership tests; a missing flag is no member."""
    issuers = ISSUER_TYPES + REIT_TYPES * include_reits
    tests = share.isin(*SHARE_TYPES) & security.isin(*SECURITY_TYPES) & issuer.isin(*issuers) & exchange.isin(*EXCHANGES) & (incorporated == "Y")
    return F.coalesce(tests, F.lit(False))


def year_aggregates(rows: DataFrame) -> DataFrame:
    """symbol, year, cap_sum, cap_count, any_eligible of daily rows with date, symbol, cap, eligible."""
    return rows.groupBy("symbol", F.year("date").alias("year")).agg(F.sum("cap").alias("cap_sum"), F.count("cap").alias("cap_count"), F.max("eligible").alias("any_eligible"))


def merge_aggregates(*parts: DataFrame) -> DataFrame:
    """Summaries of several extracts as one."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("symbol", "year").agg(F.sum("cap_sum").alias("cap_sum"), F.sum("cap_count").alias("cap_count"), F.max("any_eligible").alias("any_eligible"))


def select_universe(by_year: DataFrame, n: int) -> DataFrame:
    """year, symbol, place: the n largest eligible symbols by mean cap of the year before; a year without one before uses itself."""
    years = by_year.select("year").distinct()
    before = years.select((F.col("year") + 1).alias("year"), F.lit(True).alias("_has"))
    source = years.join(before, "year", "left").select("year", F.when(F.col("_has"), F.col("year") - 1).otherwise(F.col("year")).alias("source_year"))
    mean = by_year.where(F.col("any_eligible") & (F.col("cap_count") > 0)).select(F.col("year").alias("source_year"), "symbol", (F.col("cap_sum") / F.col("cap_count")).alias("mean_cap"))
    ranked = source.join(mean, "source_year").withColumn("place", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("mean_cap"), "symbol")))
    return ranked.where(F.col("place") <= n).select("year", "symbol", "place")


def year_mask(grid: DataFrame, universe: DataFrame) -> DataFrame:
    """grid with selected: the symbol is in the universe of the date's year."""
    chosen = universe.select(F.col("year").alias("_year"), "symbol", F.lit(True).alias("_in"))
    out = grid.withColumn("_year", F.year("date")).join(chosen, ["_year", "symbol"], "left")
    return out.withColumn("selected", F.coalesce("_in", F.lit(False))).drop("_year", "_in")


def finalize_membership(df: DataFrame) -> DataFrame:
    """member: selected and trading."""
    return df.withColumn("member", F.col("selected") & F.col("close").isNotNull())


def align_outer(membership: DataFrame, facts: DataFrame) -> DataFrame:
    """All cells of either side; a missing mask is false."""
    return membership.join(facts, ["date", "symbol"], "full_outer").withColumn("member", F.coalesce("member", F.lit(False)))


def price_floor(member: Column, close: Column, least: float = 5.0) -> Column:
    return F.coalesce(member & (close >= least), F.lit(False))


def forward_returns(panel: DataFrame, returns: str = "returns", member: str = "member") -> DataFrame:
    """The next row's raw return, masked by membership today only."""
    ahead = F.lead(returns).over(Window.partitionBy("symbol").orderBy("t"))
    return panel.withColumn("forward_returns", F.when(F.col(member), ahead))


def split(panel: DataFrame, is_end: str) -> tuple[DataFrame, DataFrame]:
    """(in-sample up to is_end, test after it); both filters reach a scan by date or year."""
    day = F.lit(is_end).cast("date")
    return panel.where(F.col("date") <= day), panel.where(F.col("date") > day)


def embargo(in_sample: DataFrame, label: str = "forward_returns") -> DataFrame:
    """The label of the last in-sample date is blanked: it looks into the test block."""
    last = in_sample.agg(F.max("date").alias("_last"))
    return in_sample.join(F.broadcast(last), F.lit(True)).withColumn(label, F.when(F.col("date") < F.col("_last"), F.col(label))).drop("_last")


def subsample_dates(panel: DataFrame, k: int) -> DataFrame:
    """Every k-th date, from the first of the panel on."""
    first = panel.agg(F.min("t").alias("_first"))
    return panel.join(F.broadcast(first), F.lit(True)).where((F.col("t") - F.col("_first")) % k == 0).drop("_first")
