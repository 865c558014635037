"""Data-quality assertions on a panel, as one table of (check, ok, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import fields


def _ahead(panel: DataFrame) -> tuple[DataFrame, Column]:
    """panel with the next row's membership and return; the largest distance of the label to that return where both rows are members."""
    by_time = Window.partitionBy("symbol").orderBy("t")
    ahead = panel.withColumns({"_next_member": F.coalesce(F.lead("member").over(by_time), F.lit(False)), "_next": F.lead("returns").over(by_time)})
    return ahead, F.max(F.when(F.col("member") & F.col("_next_member"), F.abs(F.col("forward_returns") - F.col("_next"))))


def _aligned(shift: Column) -> Column:
    return F.coalesce(shift, F.lit(0.0)) < 1e-9


def forward_alignment(panel: DataFrame) -> DataFrame:
    """One row, ok: whether every label is the next row's return. The check of this name in panel_checks, by itself."""
    ahead, shift = _ahead(panel)
    return ahead.agg(_aligned(shift).alias("ok"))


def panel_checks(panel: DataFrame, universe: DataFrame, names: int = 800, moves: int = 50, breadth: float = 200, edge_days: int = 60, first_fundamental: DataFrame | None = None) -> DataFrame:
    """Eleven point-in-time checks; thresholds are parameters. universe: symbol. first_fundamental: one row, first_date, of quarterly values."""
    ahead, shift = _ahead(panel)
    cells = ahead.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("date").alias("n_dates"),
        F.countDistinct("symbol").alias("n_symbols"),
        shift.alias("shift"),
        F.max(F.when(F.col("member"), F.abs(F.col("forward_returns") - F.col("returns")))).alias("same_day"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    spans = panel.where(F.col("close").isNotNull()).groupBy("symbol").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).join(F.broadcast(panel.agg(F.min("date").alias("a"), F.max("date").alias("b"))), F.lit(True))
    moved = spans.agg(F.sum((F.col("hi") < F.date_sub("b", edge_days)).cast("bigint")).alias("exits"), F.sum((F.col("lo") > F.date_add("a", edge_days)).cast("bigint")).alias("entries"))
    strangers = panel.select("symbol").distinct().join(universe.select("symbol").distinct(), "symbol", "left_anti").agg(F.count(F.lit(1)).alias("strangers"))
    daily = panel.groupBy("date").agg(F.count("close").alias("_n")).agg(F.percentile("_n", F.lit(0.5)).alias("median_breadth"))
    typed = all(isinstance(panel.schema[c].dataType, T.DoubleType) for c in fields(panel))
    one = cells
    for part in (moved, strangers, daily):
        one = one.join(part, F.lit(True))
    one = one.join(first_fundamental, F.lit(True), "left") if first_fundamental is not None else one.withColumn("first_fundamental", F.col("first_date"))
    c = F.col
    checks = [
        ("shared_grid", c("n") == c("n_dates") * c("n_symbols"), c("n").cast("double")),
        ("ids_in_universe", c("strangers") == 0, c("strangers").cast("double")),
        ("double_fields", F.lit(typed), F.lit(None).cast("double")),
        ("sector_is_no_field", F.lit("sector" not in fields(panel)), F.lit(None).cast("double")),
        ("forward_is_next_return", _aligned(c("shift")), c("shift")),
        ("forward_is_not_same_day", c("same_day") > 1e-9, c("same_day")),
        ("exits", c("exits") > moves, c("exits").cast("double")),
        ("entries", c("entries") > moves, c("entries").cast("double")),
        ("names", c("n_symbols") > names, c("n_symbols").cast("double")),
        ("fundamentals_after_prices", F.coalesce(c("first_fundamental") >= c("first_date"), F.lit(True)), F.lit(None).cast("double")),
        ("median_breadth", c("median_breadth") >= breadth, c("median_breadth")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), d.alias("detail")) for n, ok, d in checks])
    return one.select(F.explode(rows).alias("r")).select("r.*")
