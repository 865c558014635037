"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), all in DataFrame operations.

Every step is a minimum per vertex, which aggregates before the shuffle, and a join, which adaptive execution splits where a
vertex has very many edges. The edges of each round are written to the shared folder, those of the round before deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """edges: a > b. Large: for every vertex, its larger neighbours link to its least one; small: so do its smaller ones and itself."""
    seen = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = seen.groupBy("a").agg(F.min("b").alias("m"))
    least = least if small else least.withColumn("m", F.least("m", "a"))
    joined = seen.join(least, "a")
    if small:
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """id, label (the least id that is reachable) for every vertex of the edges a, b (long). Loops and repeats do no harm."""
    now = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        before, now = now, materialize(_stars(_stars(now, small=False), small=True), "edges")
        forget(before)
        last, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return now.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
