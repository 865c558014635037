"""Registered queries over the given tables, each thin over an operator, with SQL for comparison where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import rank_ic
from . import base, build, columns, records, scores  # noqa: F401  they register their queries


def flagship(spark: SparkSession, sf_dir: str, min_stocks: int = 20) -> DataFrame:
    """date, value: daily rank IC of the five-step price change."""
    p = base.panel_w(spark, sf_dir).withColumn("signal", F.round(F.col("close") - F.lag("close", 5).over(base.by_time()), 12))
    return rank_ic(p, "signal", "forward_returns", min_stocks).select("date", base.r6("ic").alias("value"))


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
