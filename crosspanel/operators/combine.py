"""Combining signals into one: equal, weighted, orthogonalised. Fits see in-sample frames only; applying takes the fit's numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.writers import materialized

CELL = ("date", "symbol")
#: Signals after which the running sums of a fit are written.
KEPT = 16
#: Numbers of all Gram matrices together up to which they are gathered, and numbers that a task holds.
MOST_ENTRIES, GRAM_ENTRIES = 20_000_000, 4_000_000


def combine_equal(signals: DataFrame) -> DataFrame:
    """date, symbol, value: the mean of the signals present in a cell."""
    return signals.groupBy(*CELL).agg(F.avg("value").alias("value"))


def mean_of(names: list[str]) -> Column:
    """The same of signals that are columns, a row per cell."""
    values = [F.col(f"`{n}`") for n in names]
    return F.try_divide(sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0)), sum((v.isNotNull().cast("double") for v in values), F.lit(0.0)))


def combine_weighted(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """The weighted mean over present cells; null where their weights add up to 0. weights: signal_id, weight (a row per signal)."""
    joined = signals.join(F.broadcast(weights), "signal_id")  # by an exchange, every row of a signal would be one task's
    have = F.when(F.col("value").isNotNull(), F.col("weight"))
    return joined.groupBy(*CELL).agg(F.try_divide(F.sum(F.col("weight") * F.col("value")), F.sum(have)).alias("value"))


def fit_orthogonal(signals: DataFrame, weights: dict[str, float], most_entries: int = MOST_ENTRIES) -> list[tuple[str, float | None]]:
    """(signal_id, beta) in order of absolute weight: each signal's slope on the running mean of the residuals before it; None for the first.

    A cell that the first signal lacks has no composite, so it stays out of all later residuals. In all cells where the same signals are present, every residual is the
    same linear combination of their values; so the sums of products of these values (a Gram matrix per pattern of presence) are all that the slopes depend on,
    and they follow from them in turn without another look at the cells. Three jobs, however many signals. Where patterns are so many that their matrices have
    more than `most_entries` numbers, the slopes are fitted in turn by a pass over the cells each.
    """
    order = sorted(weights, key=lambda i: (-abs(weights[i]), i))
    if not order:
        return []
    spark = signals.sparkSession
    places = spark.createDataFrame([(i, k) for k, i in enumerate(order)], "signal_id string, at int")  # a row per fitted signal
    present = signals.where(F.col("value").isNotNull()).join(F.broadcast(places), "signal_id")
    cells = present.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v"))

    def wide() -> DataFrame:
        return signals.where(F.col("signal_id").isin(order)).groupBy(*CELL).pivot("signal_id", order).agg(F.first("value"))

    return _fitted(cells, wide, order, most_entries)


def fit_columns(wide: DataFrame, weights: dict[str, float], most_entries: int = MOST_ENTRIES) -> list[tuple[str, float | None]]:
    """The same of signals that are columns, a row per cell: no cell moves."""
    order = sorted(weights, key=lambda i: (-abs(weights[i]), i))
    if not order:
        return []
    values = F.array(*[F.struct(F.lit(k).alias("at"), F.col(f"`{i}`").alias("value")) for k, i in enumerate(order)])
    cells = wide.select(*CELL, F.filter(values, lambda x: x["value"].isNotNull()).alias("v"))
    return _fitted(cells, lambda: wide, order, most_entries)


def _fitted(cells: DataFrame, wide: Callable[[], DataFrame], order: list[str], most_entries: int) -> list[tuple[str, float | None]]:
    """The slopes from cells with v, the places and values of the signals present, in order; wide: the same cells with a column per signal."""
    cells = cells.where(F.get("v", F.lit(0))["at"] == 0)
    at = F.transform("v", lambda x: x["at"])
    cells = materialized(cells.select(F.xxhash64(at).alias("h1"), F.xxhash64(F.lit(1), at).alias("h2"), at.alias("at"), F.transform("v", lambda x: x["value"]).alias("values")), "cells")
    patterns = cells.groupBy("h1", "h2").agg(F.first("at").alias("at"))
    n = F.size("at").cast("bigint")
    if (patterns.agg(F.sum(n * (n + 1) / 2)).first()[0] or 0) > most_entries:
        return _fit_in_turn(wide(), order)
    ship(cells.sparkSession)
    sums = cells.select("h1", "h2", "values").mapInArrow(_grams, "h1 bigint, h2 bigint, g array<double>")
    sums = sums.select("h1", "h2", F.posexplode("g").alias("place", "g")).groupBy("h1", "h2", "place").agg(F.sum("g").alias("g"))
    whole = sums.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("place", "g"))).alias("g")).join(patterns, ["h1", "h2"])
    found = whole.select("at", F.transform("g", lambda x: x["g"]).alias("g")).collect()  # at most most_entries numbers
    slopes = solve_in_turn([(np.array(r["at"]), _square(np.array(r["g"]), len(r["at"]))) for r in found], len(order))
    return [(i, None if k == 0 else slopes[k]) for k, i in enumerate(order)]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pattern the upper triangle of the sums of products, row by row; handed on whenever GRAM_ENTRIES numbers are held."""
    held: dict[tuple[int, int], np.ndarray] = {}

    def out() -> pa.RecordBatch:
        keys = [*held]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([g[np.triu_indices(len(g))] for g in held.values()], pa.list_(pa.float64()))], ["h1", "h2", "g"])

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, values = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        flat, sizes = values.flatten().to_numpy(), values.value_lengths().to_numpy()
        starts, order = np.cumsum(sizes) - sizes, np.lexsort([h2, h1])
        cuts = np.flatnonzero((np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)) + 1
        for rows in np.split(order, cuts):
            x = flat[starts[rows][:, None] + np.arange(sizes[rows[0]])]
            key = int(h1[rows[0]]), int(h2[rows[0]])
            held[key] = held[key] + x.T @ x if key in held else x.T @ x
            if sum(g.size for g in held.values()) > GRAM_ENTRIES:
                yield out()
                held.clear()
    if held:
        yield out()


def _square(upper: np.ndarray, n: int) -> np.ndarray:
    g = np.zeros((n, n))
    g[np.triu_indices(n)] = upper
    return g + np.triu(g, 1).T


def solve_in_turn(patterns: list[tuple[np.ndarray, np.ndarray]], n_signals: int) -> list[float]:
    """The slope of every signal (0 for the first) from (present signals, Gram matrix) per pattern; the first signal is present in all.

    Of a pattern, u holds the coefficients of the sum of residuals so far, w its products with every signal, m their number.
    """
    places = [{int(s): i for i, s in enumerate(at)} for at, _ in patterns]
    u, w, m = [np.eye(len(at))[0] for at, _ in patterns], [g[0].copy() for _, g in patterns], [1] * len(patterns)
    slopes = [0.0]
    for k in range(1, n_signals):
        own = [p for p, at in enumerate(places) if k in at]
        above, below = sum(w[p][places[p][k]] / m[p] for p in own), sum(u[p] @ w[p] / m[p] ** 2 for p in own)
        slopes.append(float(above / below) if below else 0.0)
        for p in own:  # the residual is the signal less slope times u / m
            i, rest = places[p][k], 1 - slopes[k] / m[p]
            u[p], w[p], m[p] = u[p] * rest, w[p] * rest + patterns[p][1][i], m[p] + 1
            u[p][i] += 1
    return slopes


def _fit_in_turn(wide: DataFrame, order: list[str]) -> list[tuple[str, float | None]]:
    """The same slopes by one aggregate per signal over a written frame with one row per cell, whose running sums are written anew every KEPT signals."""
    wide = wide.select(*CELL, F.lit(0.0).alias("num"), F.lit(0.0).alias("cnt"), *[F.col(f"`{i}`").alias(f"s{k}") for k, i in enumerate(order)])
    wide, done = materialized(wide, "combine"), 0
    betas: list[tuple[str, float | None]] = []
    for k, i in enumerate(order):
        if k == 0:
            betas.append((i, None))
            continue
        if k - done > KEPT:  # so that no signal's work starts from the first again
            x = _running([b for _, b in betas], done, k - 1)
            wide, done = materialized(wide.select(*CELL, x["num"].alias("num"), x["cnt"].alias("cnt"), *[f"s{j}" for j in range(k - 1, len(order))]), "combine"), k - 1
        x = _running([b for _, b in betas], done, k)
        composite = F.try_divide(x["num"], F.nullif(x["cnt"], F.lit(0.0)))
        s = F.col(f"s{k}")
        sums = wide.select(s.alias("s"), composite.alias("c")).where("s IS NOT NULL AND c IS NOT NULL").agg(F.sum(F.col("s") * F.col("c")), F.sum(F.col("c") * F.col("c"))).first()
        betas.append((i, float(sums[0] / sums[1]) if sums[1] else 0.0))
    return betas


def _running(betas: list[float | None], done: int, k: int):
    """The running sum and count of residuals before signal k, from the columns num and cnt, which hold those before signal `done`."""
    start, step = _folded(betas[done:k], done)
    return F.aggregate(F.array(*[F.col(f"s{j}") for j in range(done, k)]), F.struct(F.col("num").alias("num"), F.col("cnt").alias("cnt"), start["at"].alias("at")), step)


def _folded(betas: list[float | None], first: int = 0):
    """(start, step) of a fold over a cell's signal values in order from the one with number `first` on, with a running sum and count of residuals."""
    start = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("cnt"), F.lit(0).alias("at"))
    known = F.array(*[F.lit(b).cast("double") for b in betas])

    def step(a, v):
        beta = F.get(known, a["at"])
        res = F.when(beta.isNull() | ((a["at"] == 0) & F.lit(first == 0)), v).otherwise(v - beta * F.try_divide(a["num"], F.nullif(a["cnt"], F.lit(0.0))))
        return F.struct((a["num"] + F.coalesce(res, F.lit(0.0))).alias("num"), (a["cnt"] + res.isNotNull().cast("double")).alias("cnt"), (a["at"] + 1).alias("at"))

    return start, step


def apply_orthogonal(signals: DataFrame, betas: list[tuple[str, float | None]], present: list[str] | None = None) -> DataFrame:
    """date, symbol, value: the composite by fixed betas, in the order of the fit; ids that are absent are skipped. One pass over the signals."""
    if present is None:  # of the fitted ones, so at most as many
        present = [r[0] for r in signals.where(F.col("signal_id").isin([i for i, _ in betas])).select("signal_id").distinct().collect()]
    used = [(i, b) for i, b in betas if i in present]
    if not used:
        raise ValueError("none of the fitted signals is at hand")
    at = F.create_map(*[F.lit(x) for k, (i, _) in enumerate(used) for x in (i, k)])
    cells = signals.where(F.col("signal_id").isin([i for i, _ in used])).groupBy(*CELL).agg(F.map_from_entries(F.collect_list(F.struct(at[F.col("signal_id")].alias("k"), "value"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(len(used) - 1)), lambda k: F.try_element_at(F.col("m"), k))
    x = F.aggregate(values, *_folded([b for _, b in used]))
    return cells.select(*CELL, F.try_divide(x["num"], F.nullif(x["cnt"], F.lit(0.0))).alias("value"))


def apply_columns(wide: DataFrame, betas: list[tuple[str, float | None]]) -> DataFrame:
    """The same of signals that are columns, a row per cell: no cell moves."""
    used = [(i, b) for i, b in betas if i in wide.columns]
    if not used:
        raise ValueError("none of the fitted signals is at hand")
    x = F.aggregate(F.array(*[F.col(f"`{i}`") for i, _ in used]), *_folded([b for _, b in used]))
    return wide.select(*CELL, F.try_divide(x["num"], F.nullif(x["cnt"], F.lit(0.0))).alias("value"))
