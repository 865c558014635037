"""Which fields are good enough: coverage, breadth, univariate IC, and draws of field subsets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import dealt
from .metrics import rank_ic

# Families of fields; a draw takes one field of a family per round.
FAMILIES: dict[str, tuple[str, ...]] = {
    "price": ("close", "open", "high", "low", "price", "returns"),
    "volume": ("volume", "dollar_volume", "num_trades"),
    "spread": ("bid", "ask"),
    "size": ("market_cap", "shrout"),
    "value": ("bm", "ptb", "pe_exi", "pe_op_dil", "pcf", "ps", "capei", "cs_bm", "cs_ep", "cs_sp"),
    "profitability": ("roe", "roa", "roce", "npm", "gpm", "gprof", "opmbd", "cs_roa", "cs_roe", "cs_gp_at", "cs_gpmargin", "cs_opmargin"),
    "accruals": ("accrual", "cs_accruals"),
    "growth": ("cs_asset_growth", "cs_earnings_growth", "cs_sales_growth", "cs_rd_sale"),
    "leverage": ("de_ratio", "debt_at", "cs_debt_at", "cs_leverage"),
    "solvency": ("cash_ratio", "curr_ratio", "quick_ratio", "cs_current_ratio", "cs_cash_at"),
    "efficiency": ("inv_turn", "at_turn", "rect_turn"),
    "payout": ("divyield",),
}
DAILY_FAMILIES = ("price", "volume", "spread")


def coverage_report(panel: DataFrame, names: list[str], member: str | None = "member") -> DataFrame:
    """field, coverage (of member cells), median_breadth, mean_breadth, first_valid, last_valid, n_symbols; one pass over all fields.

    Days without any value count in the breadths.
    """
    inside = F.coalesce(F.col(member), F.lit(False)) if member else F.lit(True)
    cells = panel.select("date", "symbol", inside.alias("_in"), *[F.when(inside, F.col(n)).alias(n) for n in names]).unpivot(["date", "symbol", "_in"], names, "field", "_v")
    daily = cells.groupBy("field", "date").agg(F.count("_v").alias("_n"), F.sum(F.col("_in").cast("int")).alias("_cells"))
    out = daily.groupBy("field").agg(
        F.coalesce(F.round(F.try_divide(F.sum("_n"), F.sum("_cells")), 4), F.lit(0.0)).alias("coverage"),
        F.percentile("_n", F.lit(0.5)).alias("median_breadth"),
        F.round(F.avg("_n"), 1).alias("mean_breadth"),
        F.min(F.when(F.col("_n") > 0, F.col("date"))).alias("first_valid"),
        F.max(F.when(F.col("_n") > 0, F.col("date"))).alias("last_valid"),
    )
    return out.join(F.broadcast(panel.agg(F.countDistinct("symbol").alias("n_symbols"))), F.lit(True))


def qualifies(min_coverage: float = 0.20, min_breadth: float = 100) -> Column:
    return (F.col("coverage") >= min_coverage) & (F.col("median_breadth") >= min_breadth)


def field_ic(panel: DataFrame, names: list[str], label: str = "forward_returns", min_stocks: int = 20) -> DataFrame:
    """field, ic: mean daily rank IC of every field, all fields in one plan."""
    cells = panel.select("date", "symbol", label, *names).unpivot(["date", "symbol", label], names, "field", "_v")
    return rank_ic(cells, "_v", label, min_stocks, ("field",)).groupBy("field").agg(F.avg("ic").alias("ic"))


def select_fields(panel: DataFrame, candidates: list[str], core: list[str], min_breadth: float = 0, min_coverage: float = 0.0, rank_by_ic: bool = True, most: int | None = None, min_stocks: int = 20) -> DataFrame:
    """field, is_core: the core fields at hand, and the others that are broad and dense enough over the grid.

    With rank_by_ic, of these only the ones with the largest absolute IC up to `most` fields in all; otherwise all.
    """
    kept = [c for c in core if c in candidates]
    extras = [c for c in candidates if c not in kept]
    spark = panel.sparkSession
    out = spark.createDataFrame([(c, True) for c in kept], "field string, is_core boolean")
    if not extras:
        return out
    report = coverage_report(panel, extras, member=None)
    good = report.where((F.col("median_breadth") >= min_breadth) & (F.col("coverage") >= min_coverage)).select("field")
    if rank_by_ic:
        ranked = good.join(field_ic(panel, extras, min_stocks=min_stocks), "field").orderBy(F.desc(F.abs("ic")), F.desc("field"))
        good = ranked.limit(max(0, most - len(kept))) if most is not None else ranked
    return out.unionByName(good.select("field", F.lit(False).alias("is_core")))


#: Names of fields that may be sent to every task.
SMALL_MENU = 100_000


def ideas_by_fields(ideas: DataFrame, fields: DataFrame) -> DataFrame:
    """idea, field, family, members (fields of the family): every idea with every field on its menu."""
    family = F.coalesce(*[F.when(F.col("field").isin(*members), name) for name, members in FAMILIES.items()], F.lit("other"))
    menu = fields.select("field").distinct().withColumn("family", family)
    menu = menu.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("family")))
    few = menu.count() <= SMALL_MENU
    return ideas.select("idea").join(F.broadcast(menu) if few else menu, F.lit(True))


def default_subset_size(n: int) -> int:
    return max(3, round(math.sqrt(n)))


def draw_field_subset(ideas: DataFrame, fields: DataFrame, size: int | None = None, seed: int = 0) -> DataFrame:
    """idea, fields (sorted array): a subset per idea, spread over families, with at least one daily field.

    Families are in the order of u^(1/members), so every field comes up about equally often; a daily family leads, drawn with a
    number of its own; then one field per family and round. Draws are hashes of seed, idea and name.
    """
    menu = fields.select("field").distinct()
    n = menu.count()  # names of fields, not data
    size = default_subset_size(n) if size is None else size
    u = lambda *c: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *c), 11).cast("double") / F.lit(float(1 << 53))
    cells = ideas_by_fields(dealt(ideas.select("idea"), "idea", times=n), menu)  # ideas move, not their cells
    cells = cells.withColumn("key", F.pow(u("idea", F.lit("family"), "family"), 1 / F.col("members")))
    daily = F.col("family").isin(*DAILY_FAMILIES)
    cells = cells.withColumn("lead", F.when(daily, F.pow(u("idea", F.lit("lead"), "family"), 1 / F.col("members"))))
    cells = cells.withColumn("leads", daily & (F.col("lead") == F.max("lead").over(Window.partitionBy("idea"))))
    cells = cells.withColumn("round", F.row_number().over(Window.partitionBy("idea", "family").orderBy(u("idea", F.lit("field"), "field"), "field")))
    order = Window.partitionBy("idea").orderBy("round", F.desc(F.coalesce("leads", F.lit(False))), F.desc("key"), "family")
    picked = cells.withColumn("at", F.row_number().over(order)).where(F.col("at") <= size)
    return picked.groupBy("idea").agg(F.array_sort(F.collect_list("field")).alias("fields"))
