"""Rolling functions made together, and scores without a long table, against pandas and the plain paths."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.functions import timeseries as ts
from crosspanel.functions.orders import ORDERS, Wavelet
from crosspanel.functions.rolling import EXTREMES, MOMENTS, Ask, with_rolling
from crosspanel.operators import gate
from crosspanel.plans.evaluate import evaluate_signals
from crosspanel.plans.registry import REGISTRY
from crosspanel.plans.score import score_batch


def day(i):
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=i)


def panel(spark, columns, first=0):
    """columns: name -> [t][symbol]; t starts at `first`."""
    names = list(columns)
    rows = [(day(t), first + t, s, *[columns[n][t][s] for n in names]) for t in range(len(columns[names[0]])) for s in range(len(columns[names[0]][0]))]
    return spark.createDataFrame(rows, "date date, t int, symbol long" + "".join(f", {n} double" for n in names))


@pytest.mark.parametrize(("offset", "first"), [(0.0, 0), (1e9, 0), (-3e6, 37)])
def test_moments_against_pandas_with_a_large_offset(spark, offset, first):
    """Values are multiples of 1/8 (exact under the offset); pandas sees them without it where the figure doesn't depend on it."""
    rng = random.Random(2)
    raw = [[None if rng.random() < 0.08 or 40 <= t < 110 and s == 1 else rng.randrange(-200, 200) / 8 for s in range(4)] for t in range(300)]
    other = [[None if rng.random() < 0.1 else rng.randrange(-50, 50) / 8 for _ in range(4)] for _ in range(300)]
    shifted = [[None if v is None else v + offset for v in row] for row in raw]
    df = panel(spark, {"x": shifted, "y": other}, first)
    p, q = pd.DataFrame(raw, dtype=float), pd.DataFrame(other, dtype=float)
    want = {(n, w): getattr(p.rolling(w, min_periods=least), fn)() for n, fn, least in (("ts_std", "std", 2), ("ts_skew", "skew", 3), ("ts_kurt", "kurt", 4)) for w in (5, 20, 60, 64)}
    want |= {("ts_mean", w): p.rolling(w, min_periods=1).mean() for w in (5, 20, 60, 64, 100)}
    want |= {("ts_cov", 20): p.rolling(20, min_periods=3).cov(q), ("ts_corr", 20): p.rolling(20, min_periods=3).corr(q), ("ts_cov", 70): p.rolling(70, min_periods=3).cov(q)}
    slope = lambda v: np.polyfit(np.arange(20), v, 1)[0]
    want[("ts_linear_reg", 20)] = p.rolling(20).apply(slope, raw=True)
    want[("ts_decayed_linear", 20)] = p.rolling(20).apply(lambda v: v @ np.arange(1, 21) / 210, raw=True)
    asks = [Ask(f"{n}_{w}", n, w, ("x", "y") if n in ("ts_corr", "ts_cov") else ("x",)) for n, w in want]
    found = with_rolling(df, asks).collect()
    for (n, w), frame in want.items():
        base = offset if n in ("ts_mean", "ts_decayed_linear") else 0.0
        if n in ("ts_kurt", "ts_skew") and w == 5:
            continue  # of windows with nearly equal values the figure itself is ill-conditioned
        for r in found:
            e, v = frame.iloc[r["t"] - first, r["symbol"]], r[f"{n}_{w}"]
            assert (v is None) == (e != e), (n, w, r)
            assert v is None or abs(v - base - e) <= 1e-9 * max(1.0, abs(e)) + abs(offset) * 4e-16, (n, w, v, e)


def test_constant_windows_have_no_spread(spark):
    """Equal values in a block of other values: the spread is 0, not a rest of rounding, so ratios to it are missing."""
    x = [[0.1 * (t % 13) + 7.3 if t < 30 or t > 60 else 0.3] for t in range(100)]
    df = with_rolling(panel(spark, {"x": x}), [Ask("sd", "ts_std", 10, ("x",)), Ask("z", "ts_zscore", 10, ("x",)), Ask("k", "ts_kurt", 10, ("x",))])
    got = {r["t"]: (r["sd"], r["z"], r["k"]) for r in df.collect()}
    assert all(got[t] == (0.0, None, None) for t in range(39, 61)) and all(got[t][0] > 0.1 for t in range(12, 30))


@pytest.mark.parametrize("w", [1, 2, 5, 8, 20, 60])
def test_extremes_equal_plain_windows(spark, w):
    rng = random.Random(w)
    x = [[None if rng.random() < 0.2 else float(rng.randrange(6)) for _ in range(3)] for _ in range(150)]
    df = panel(spark, {"x": x}, 11)
    got = with_rolling(df, [Ask(b, b, w, ("x",)) for b in EXTREMES])
    assert "collect_list" not in got._jdf.queryExecution().toString()
    want = df.select("t", "symbol", *[getattr(ts, b)(F.col("x"), w).alias(b) for b in EXTREMES])
    assert {tuple(r) for r in got.select(*want.columns).collect()} == {tuple(r) for r in want.collect()}


def ragged(spark):
    rng = random.Random(9)
    draw = lambda gap, f: [[None if rng.random() < gap else f() for _ in range(12)] for _ in range(90)]
    return panel(spark, {"x": draw(0.15, lambda: round(rng.gauss(0, 2), 1)), "y": draw(0.1, lambda: rng.gauss(5, 1)), "forward_returns": draw(0.1, lambda: rng.gauss(0, 0.6))}, 5)


def test_batch_scores_equal_those_of_the_long_table(spark):
    """All registered operators, ended across dates or not, and formulas of several levels."""
    df = ragged(spark).cache()
    signals = {n: ("cs_rank", (n, "x", "y")[: REGISTRY[n][0] + 1]) if i % 3 else (n, "x", "y")[: REGISTRY[n][0] + 1] for i, n in enumerate(sorted(REGISTRY))}
    signals |= {"deep": ("cs_zscore", ("ts_mean_5", ("cs_rank", ("ts_delta_5", "x")))), "bad": ("ts_mean_5", "nope"), "winsor": ("cs_winsorize", ("mul", "x", "y")), "number": ("add", "x", 1.0)}
    long = evaluate_signals(df, signals, ("date", "t", "symbol", "forward_returns"))
    want = {r["signal_id"]: r.asDict() for r in gate.score_signals(long, 3, min_stocks=5).collect()}
    got = {r["signal_id"]: r.asDict() for r in score_batch(df, signals, 3, min_stocks=5).collect()}
    assert set(got) == set(want) == set(signals)
    for k, w in want.items():
        for c, v in w.items():
            assert v == got[k][c] or abs(v - got[k][c]) <= 1e-9 * max(1, abs(v)), (k, c, v, got[k][c])
    large = {r["signal_id"]: r["is_ic"] for r in score_batch(df, {"deep": signals["deep"]}, 3, min_stocks=5, most_names=5).collect()}
    assert math.isclose(large["deep"], want["deep"]["is_ic"], rel_tol=1e-9)


def test_every_moment_and_extreme_is_registered():
    assert all(any(n.startswith(f"{b}_") for n in REGISTRY) for b in (*MOMENTS, *EXTREMES, *ORDERS))


@pytest.mark.parametrize("batch_rows", [7, 10_000])
def test_ranks_and_medians_equal_plain_windows(spark, batch_rows):
    """Ties, gaps, stretches without a value, infinities and NaN, windows longer than the symbol, batches that end within a symbol; other columns stay."""
    rng = random.Random(batch_rows)
    odd = [None, math.inf, -math.inf, math.nan, -0.0, 0.0, 1e300]
    x = [[None if 20 <= t < 95 and s == 1 or s == 2 and t > 0 else rng.choice(odd) if rng.random() < 0.2 else float(rng.randrange(6)) for s in range(4)] for t in range(130)]
    y = [[None if rng.random() < 0.1 else rng.gauss(0, 1) for _ in range(4)] for _ in range(130)]
    df = panel(spark, {"x": x, "y": y}, 11).withColumn("symbol", F.format_string("s%d", "symbol")).withColumn("note", F.when(F.col("t") % 3 > 0, F.array("symbol")))
    asks = [Ask(f"{b}_{c}_{w}", b, w, (c,)) for b in ORDERS for c in "xy" for w in (1, 2, 5, 20, 60, 200)]
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, str(batch_rows))
    try:
        got = with_rolling(df, asks)
        assert got.columns == [*df.columns, *[a.name for a in asks]]
        plan = got._jdf.queryExecution().toString()
        assert "collect_list" not in plan and "lag(" not in plan and "percentile" not in plan
        found = {(r["t"], r["symbol"]): r for r in got.collect()}
    finally:
        spark.conf.set(key, before)
    want = df.select("*", *[getattr(ts, a.base)(F.col(a.args[0]), a.w).alias(a.name) for a in asks]).collect()
    assert len(found) == len(want) == 520
    same = lambda u, v: u == v or u is not None and v is not None and u != u and v != v
    for r in want:
        other = found[r["t"], r["symbol"]]
        assert r["note"] == other["note"] and r["date"] == other["date"]
        for a in asks:
            assert same(r[a.name], other[a.name]), (a, r["t"], r["symbol"], r[a.name], other[a.name])


def test_ranks_and_medians_of_nothing(spark):
    none = panel(spark, {"x": [[1.0]]}).where("t < 0")
    assert with_rolling(none, [Ask("r", "ts_rank", 5, ("x",)), Ask("m", "ts_median", 5, ("x",))]).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_wavelet_counts_and_selects(seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, [1, 2, 9, 1000][seed], 257).astype(float)
    lo = rng.integers(0, 256, 400)
    hi = rng.integers(lo + 1, 258)
    at, wavelet = rng.integers(0, 257, 400), Wavelet(values)
    below, equal = wavelet.below_and_equal(lo, hi, wavelet.of[at])
    k = rng.integers(0, hi - lo)
    picked = wavelet.smallest(lo, hi, k)
    for i in range(400):
        part = values[lo[i] : hi[i]]
        assert (below[i], equal[i]) == ((part < values[at[i]]).sum(), (part == values[at[i]]).sum())
        assert picked[i] == np.sort(part)[k[i]]


def test_few_signals_share_a_plan_and_blocks_rarely_repeat_a_date(spark):
    """Five signals of three kinds read the panel once; a wide date isn't a block of its own, which would move every row twice."""
    from crosspanel.plans import evaluate, score
    from crosspanel.queries.base import SIGNALS

    formulas = {k: f for k, (f, _) in SIGNALS.items()}
    assert [len(p) for p in evaluate.parts(formulas, {"close", "volume", "high", "low", "num_trades"})] == [5]
    assert score._span(60_000, 5) >= 8 and score._span(360_000, 5) >= 4 and score._span(1_000_000, 24) == 1
