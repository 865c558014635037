"""How different the signals of a set are, and what they are made of."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.writers import materialized

#: Signals of a side of a tile of the correlation matrix.
TILE = 64


def pairwise_rho(signals: DataFrame) -> DataFrame:
    """One row: rho, n: the mean correlation over pairs of signals, on cells where all of them are present; pairs with a constant side are skipped.

    The sum over all pairs is the square of a cell's sum of standardised values less the squares, so no pair is formed: the work is linear in the
    number of signals.
    """
    n_signals = signals.agg(F.countDistinct("signal_id").alias("_all"))
    full, stats = _full_cells(signals)
    moving = _moving()
    stats = stats.agg(F.sort_array(F.collect_list(F.struct("at", "mean", F.when(moving, F.col("sd")).alias("sd")))).alias("stats"), F.coalesce(F.sum(moving.cast("bigint")), F.lit(0)).alias("_n"))  # one row, a value per signal
    z = F.zip_with("v", "stats", lambda x, s: F.coalesce((x - s["mean"]) / s["sd"], F.lit(0.0)))
    total = F.aggregate(z, F.lit(0.0), lambda a, b: a + b)
    mean = full.join(F.broadcast(stats), F.lit(True)).agg(F.avg(total * total).alias("_m"), F.first("_n").alias("_n"))
    rho = F.when(F.col("_n") > 1, F.try_divide(F.col("_m") - F.col("_n"), F.col("_n") * (F.col("_n") - 1)))
    return mean.select(rho.alias("rho")).join(n_signals.select(F.col("_all").alias("n")), F.lit(True))


def _full_cells(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v: the values of a cell in the order of the signals, for cells where all are present, written; at, mean, sd of every signal over them)."""
    ids = [r[0] for r in signals.select("signal_id").where("signal_id IS NOT NULL").distinct().orderBy("signal_id").limit(TILE + 1).collect()]
    if 0 < len(ids) <= TILE:  # a sum of fixed size per cell, made before rows move
        own = F.array(*[F.max(F.when(F.col("signal_id") == i, F.col("value"))) for i in ids])
        cells = signals.groupBy("date", "symbol").agg(own.alias("v"), F.count("value").alias("_n"))
        full = materialized(cells.where((F.col("_n") == len(ids)) & F.forall("v", lambda x: x.isNotNull())).select("v"), "cells")
        return full, full.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    n_signals = signals.agg(F.countDistinct("signal_id").alias("_all"))
    cells = signals.where(F.col("value").isNotNull()).groupBy("date", "symbol").agg(F.sort_array(F.collect_list(F.struct("signal_id", "value"))).alias("v"))
    full = cells.join(F.broadcast(n_signals), F.lit(True)).where(F.size("v") == F.col("_all")).select(F.transform("v", lambda x: x["value"]).alias("v"))
    full = materialized(full, "cells")
    return full, full.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def _moving() -> Column:
    """Whether a signal has a spread."""
    return F.col("sd") > 1e-12 * (1 + F.abs("mean"))


def pair_correlations(signals: DataFrame, tile: int = TILE) -> DataFrame:
    """a, b, rho: the correlation of every pair of signals (a before b), on cells where all signals are present; null where a side is constant.

    A matrix product by tiles: a batch of cells is a matrix of standardised values, and each of its products of a block of `tile` signals with another is a row;
    the rows of a tile are added up as they stream through a task, which holds a tile at a time, however many signals or cells there are.
    """
    full, stats = _full_cells(signals)
    stats = materialized(stats.withColumn("sd", F.when(_moving(), F.col("sd"))), "stats")
    own = stats.agg(F.sort_array(F.collect_list(F.struct("at", "mean", "sd"))).alias("stats"))  # one row, a value per signal
    z = F.zip_with("v", "stats", lambda x, s: F.coalesce((x - s["mean"]) / s["sd"], F.lit(0.0)))
    ship(signals.sparkSession)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                for i in range(0, x.shape[1], tile):
                    for j in range(i, x.shape[1], tile):
                        product = x[:, i : i + tile].T @ x[:, j : j + tile]
                        yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "n": pa.array([batch.num_rows], pa.int64()), "wide": pa.array([product.shape[1]], pa.int32()), "p": pa.array([product.ravel()], pa.list_(pa.float64()))})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for batch in batches:
            for i, j, n, wide, p in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4), strict=True):
                if held is None or held[:2] != [i, j]:
                    if held:
                        yield _tile_rows(*held)
                    held = [i, j, 0, wide, 0.0]
                held[2] += n
                held[4] = held[4] + p.values.to_numpy()
        if held:
            yield _tile_rows(*held)

    tiles = full.join(F.broadcast(own), F.lit(True)).select(z.alias("z")).mapInArrow(products, "i int, j int, n bigint, wide int, p array<double>")
    pairs = tiles.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(added, "x int, y int, rho double")
    names = signals.select("signal_id").distinct().withColumn("at", F.row_number().over(Window.orderBy("signal_id")) - 1)  # a row per signal
    spread = stats.select("at", F.col("sd").isNotNull().alias("has"))
    side = lambda at, name: names.join(spread, "at").select(F.col("at").alias(at), F.col("signal_id").alias(name), F.col("has").alias(f"has_{name}"))
    out = pairs.join(side("x", "a"), "x").join(side("y", "b"), "y")
    return out.select("a", "b", F.when(F.col("has_a") & F.col("has_b"), F.col("rho")).alias("rho"))


def _tile_rows(i: int, j: int, n: int, wide: int, total: np.ndarray) -> pa.RecordBatch:
    """x, y, rho of the pairs of a tile, each once."""
    x, y = np.divmod(np.arange(len(total)), wide)
    x, y = x + i, y + j
    own = x < y
    return pa.RecordBatch.from_pydict({"x": pa.array(x[own], pa.int32()), "y": pa.array(y[own], pa.int32()), "rho": pa.array(total[own] / n)})


def effective_breadth(rho: DataFrame, mean_sharpe: DataFrame) -> DataFrame:
    """rho, n, n_eff, ceiling, realised, implied_sharpe. rho: from pairwise_rho; mean_sharpe: one row, column mean_sharpe."""
    out = rho.join(mean_sharpe, F.lit(True))
    r, n, infinite = F.col("rho"), F.col("n"), F.lit(float("inf"))
    out = out.withColumn("n_eff", F.when((n > 1) & (r > -1 / F.nullif(n - 1, F.lit(0))), n / (1 + (n - 1) * r)).when(n == 1, 1.0).otherwise(infinite))
    out = out.withColumn("ceiling", F.when(r > 0, 1 / r).otherwise(infinite))
    out = out.withColumn("realised", F.when(r > 0, F.col("n_eff") / F.col("ceiling")))
    return out.withColumn("implied_sharpe", F.col("mean_sharpe") * F.sqrt("n_eff")).drop("mean_sharpe")


def operator_mix(catalogue: DataFrame) -> DataFrame:
    """n_ts (rows that use any ts_ operator), n_ok, n_operators (distinct names) of rows with status ok."""
    names = catalogue.where(F.col("status") == "ok").select("expression", F.regexp_extract_all("expression", F.lit(r"([a-z_0-9]+)\("), 1).alias("ops"))
    counts = names.agg(F.sum(F.exists("ops", lambda o: o.startswith("ts_")).cast("bigint")).alias("n_ts"), F.count(F.lit(1)).alias("n_ok"))
    distinct = names.select(F.explode("ops").alias("o")).agg(F.countDistinct("o").alias("n_operators"))
    return counts.join(distinct, F.lit(True))


def terminal_exposure(survivors: DataFrame, offered: DataFrame) -> DataFrame:
    """field, offered (ideas that had it on their menu), used (survivors that use it), share of survivors."""
    field = F.regexp_extract_all("expression", F.lit(r"\b([A-Za-z_]\w*)\b(?!\s*\()"), 1)
    total = survivors.agg(F.count(F.lit(1)).alias("_n"))
    used = survivors.select(F.explode(F.array_distinct(field)).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("used"))
    menu = offered.select(F.explode("terminals").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("offered"))
    out = menu.join(used, "field", "full_outer").join(F.broadcast(total), F.lit(True))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("field", zero("offered").alias("offered"), zero("used").alias("used"), F.try_divide(zero("used"), F.col("_n")).alias("share"))


def catalogue_rates(candidates: DataFrame) -> DataFrame:
    """flip_rate (ok rows with a negative in-sample IC), valid_rate, duplicate_rate of all candidates tried."""
    ok, dup = F.col("status") == "ok", F.col("status") == "duplicate"
    share = lambda c: F.avg(c.cast("double"))
    return candidates.agg(F.avg(F.when(ok, (F.col("is_ic") < 0).cast("double"))).alias("flip_rate"), share(ok).alias("valid_rate"), share(dup).alias("duplicate_rate"))
