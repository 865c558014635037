"""Cases of the operators on small frames: known answers, invariants, edges."""

import datetime
import gc
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from py4j.finalizer import ThreadSafeFinalizer
from pyspark.sql import functions as F

from crosspanel.functions import crosssection as cs
from crosspanel.functions import timeseries as ts
from crosspanel.operators import asof, backtest, combine, diversity, gate, metrics, neutralize, runs, screen, text, universe
from crosspanel.plans.evaluate import evaluate_signals, signal_columns
from crosspanel.plans.registry import REGISTRY
from crosspanel.sources import readers, writers

DAY = datetime.date(2020, 1, 1)


def day(i):
    return DAY + datetime.timedelta(days=i)


def frame(spark, wide, **more):
    """wide[t][symbol] -> panel rows."""
    rows = [(day(t), t, s, float(v) if v is not None else None, *[float(m[t][s]) if m[t][s] is not None else None for m in more.values()]) for t, row in enumerate(wide) for s, v in enumerate(row)]
    return spark.createDataFrame(rows, "date date, t int, symbol long, x double" + "".join(f", {n} double" for n in more))


@pytest.fixture(scope="module")
def ragged(spark):
    rng = random.Random(0)
    wide = [[None if (t < 5 and s < 3) or (20 <= t < 26 and s in (4, 5)) else round(rng.gauss(0, 2), 1) for s in range(10)] for t in range(70)]
    other = [[None if rng.random() < 0.1 else rng.gauss(5, 1) for _ in range(10)] for _ in range(70)]
    return frame(spark, wide, y=other).cache(), wide, other


def values(df, column):
    return {(r["t"], r["symbol"]): r[column] for r in df.select("t", "symbol", column).collect()}


def test_registry_has_all_names(spark):
    assert len(REGISTRY) == 72 and sum(n == 1 for n, _ in REGISTRY.values()) == 60


def test_every_operator_is_null_safe_and_finite(spark, ragged):
    df, _, _ = ragged
    names = sorted(REGISTRY)
    signals = {n: (n, "x", "y")[: REGISTRY[n][0] + 1] for n in names}
    out = evaluate_signals(df, signals)
    got = out.groupBy("signal_id").agg(F.count("value").alias("n"), F.sum(F.when(F.isnan("value") | (F.abs("value") == float("inf")), 1).otherwise(0)).alias("odd"), F.count(F.lit(1)).alias("cells")).collect()
    assert {r["signal_id"] for r in got} == set(names)
    assert all(r["odd"] == 0 and r["n"] > 0 and r["cells"] == 700 for r in got)


def test_against_pandas(spark, ragged):
    df, wide, other = ragged
    p, q = pd.DataFrame(wide, dtype=float), pd.DataFrame(other, dtype=float)
    want = {
        "ts_mean_5": p.rolling(5, min_periods=1).mean(),
        "ts_std_5": p.rolling(5, min_periods=2).std(),
        "ts_rank_10": p.rolling(10, min_periods=1).rank(pct=True),
        "ts_skew_60": p.rolling(60, min_periods=3).skew(),
        "ts_kurt_60": p.rolling(60, min_periods=4).kurt(),
        "ts_ema_10": p.ewm(span=10).mean(),
        "ts_median_20": p.rolling(20, min_periods=1).median(),
        "cs_rank": p.rank(axis=1, pct=True),
    }
    out = signal_columns(df, {n: (n, "x") for n in want} | {"ts_cov_20": ("ts_cov_20", "x", "y")})
    want["ts_cov_20"] = p.rolling(20, min_periods=3).cov(q)
    for name, w in want.items():
        got = values(out, name)
        for (t, s), v in got.items():
            e = w.iloc[t, s]
            assert (v is None) == (e != e), (name, t, s)
            assert v is None or abs(v - e) < 1e-8, (name, t, s)


def test_ema_over_blocks(spark):
    x = [math.sin(i) + i % 7 for i in range(3000)]
    out = frame(spark, [[v] for v in x]).select("t", ts.ts_ema(F.col("x"), 60).alias("e"))
    got = [r["e"] for r in out.orderBy("t").collect()]
    want = pd.Series(x).ewm(span=60).mean()
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-9


def test_golden_backtest(spark):
    wide = [list(range(10))] * 3
    label = [[0.0] * 8 + [r, r] for r in (0.10, -0.05, 0.03)]
    df = frame(spark, wide, y=label)
    daily = backtest.long_short(df, "x", "y", 5)
    assert [round(r["ret"], 9) for r in daily.orderBy("date").collect()] == [0.10, -0.05, 0.03]
    s = metrics.return_summary(daily).first()
    assert round(s["sharpe"], 4) == 5.6401 and round(s["max_drawdown"], 9) == -0.05


def test_buckets_break_ties_by_symbol(spark):
    df = frame(spark, [[1.0] * 12])
    got = {r["symbol"]: r["b"] for r in df.select("symbol", cs.quantile_bucket(F.col("x"), 5).alias("b")).collect()}
    assert [list(got.values()).count(b) for b in range(1, 6)] == [3, 2, 2, 2, 3] and got[0] == 1 and got[11] == 5


def test_rank_ic_edges(spark):
    up, down, flat = list(range(30)), list(range(30, 0, -1)), [1] * 30
    gaps = [v if i < 25 else None for i, v in enumerate(up)]
    df = frame(spark, [up, up, flat, gaps, [1.0] + [None] * 29], y=[up, down, up, up, up])
    got = {r["date"]: round(r["ic"], 9) for r in metrics.rank_ic(df, "x", "y", 20).collect()}
    assert got == {day(0): 1.0, day(1): -1.0, day(3): 1.0}
    monotone = df.withColumn("x", F.exp(F.col("x") / 10))
    assert {r["date"]: round(r["ic"], 9) for r in metrics.rank_ic(monotone, "x", "y", 20).collect()} == got


def test_summary_edges(spark):
    r = lambda *v: spark.createDataFrame([(day(i), x) for i, x in enumerate(v)], "date date, ret double")
    assert metrics.return_summary(r(0.01, 0.01)).first()["sharpe"] == 0.0
    assert metrics.return_summary(r(0.5, -1.0)).first()["annual_return"] == -1.0
    empty = metrics.return_summary(r(0.1).limit(0)).first()
    assert (empty["sharpe"], empty["annual_return"]) == (0.0, 0.0)
    assert metrics.ic_summary(spark.createDataFrame([(0.1,), (0.1,)], "ic double")).first()["icir"] == 0.0


def test_asof_keeps_weekend_observations_and_never_fills_back(spark):
    grid = spark.createDataFrame([(datetime.date(2020, 1, d), 1, True) for d in (3, 6, 7)] + [(datetime.date(2020, 1, 8), 1, False)], "date date, symbol long, member boolean")
    obs = spark.createDataFrame([(datetime.date(2020, 1, 4), 1, 5.0)], "date date, symbol long, v double")
    got = {r["date"].day: r["v"] for r in asof.asof_fill(obs, grid, ["v"]).collect()}
    assert got == {3: None, 6: 5.0, 7: 5.0, 8: None}


def test_asof_by_years_equals_one_fill(spark):
    """Sparse observations over years, some years and symbols without any; a year appended with the carry table equals the whole."""
    rng = random.Random(7)
    dates = [day(9 * i) for i in range(200)]
    grid = spark.createDataFrame([(d, s, rng.random() > 0.1) for d in dates for s in range(6)], "date date, symbol long, member boolean")
    seen = [(day(rng.randrange(-400, 1790)), s, rng.choice([None, rng.random()]), rng.choice([None, None, rng.random()])) for s in range(5) for _ in range(2 if s < 2 else 14)]
    seen = [*{(d, s): (d, s, v, w) for d, s, v, w in seen}.values()]
    obs = spark.createDataFrame(seen, "date date, symbol long, v double, w double")
    want = {}
    for r in grid.collect():
        for i, c in ((2, "v"), (3, "w")):
            past = [(o[0], o[i]) for o in seen if o[1] == r["symbol"] and o[0] <= r["date"] and o[i] is not None]
            want[r["date"], r["symbol"], c] = max(past)[1] if past and r["member"] else None
    rows = lambda df: {(r["date"], r["symbol"], c): r[c] for r in df.collect() for c in ("v", "w")}
    whole = asof.asof_fill(obs, grid, ["v", "w"])
    assert whole.columns == ["date", "symbol", "member", "v", "w"] and rows(whole) == want
    carry, got = None, {}
    for year in range(2018, 2025):
        of = lambda df, y=year: df.where(F.year("date") == y)
        got |= rows(asof.asof_fill(of(obs), of(grid), ["v", "w"], carry=carry))
        carry = spark.createDataFrame(asof.carried(of(obs), ["v", "w"], carry).collect(), "symbol long, v double, w double")
    assert got == want


def test_spans_of_a_hot_group(spark):
    """Ten thousand pairs of one group meet in as many stretches as the dates need; each pair once."""
    rng = random.Random(10)
    spans = [(1, p, day(a := rng.randrange(9000)), day(a + rng.randrange(700))) for p in range(300)] + [(2, 900, day(5), day(3)), (3, 901, day(0), day(10))]
    rows = [(1, i, day(rng.randrange(-500, 10000))) for i in range(300)] + [(2, 1000, day(4)), (4, 1001, day(5)), (3, 1002, None)]
    s = spark.createDataFrame(spans, "gvkey long, permno long, start date, end date")
    r = spark.createDataFrame(rows, "gvkey long, k long, eff_date date")
    near = datetime.timedelta(days=400)
    want = sorted((k, p) for g, k, d in rows for h, p, a, b in spans if d and g == h and a - near <= d <= b + near)
    for days in (30, 1024, 100_000):
        linked = asof.link_by_span(r, s, "gvkey", days=days)
        assert linked.columns == ["gvkey", "k", "eff_date", "permno", "start", "end"]
        assert sorted((x["k"], x["permno"]) for x in linked.collect()) == want
    stretches = asof.link_by_span(r, s, "gvkey")._jdf.queryExecution().toString()
    assert "hashpartitioning(gvkey" in stretches or "_stretch" in stretches


def test_universe_uses_the_year_before(spark):
    d = lambda y: datetime.date(y, 6, 1)
    rows = [(d(2000), 1, 10.0, True), (d(2000), 2, 20.0, True), (d(2000), 3, 99.0, False), (d(2001), 1, 50.0, True), (d(2001), 2, 1.0, True), (d(2003), 2, 5.0, True)]
    by_year = universe.year_aggregates(spark.createDataFrame(rows, "date date, symbol long, cap double, eligible boolean"))
    got = {(r["year"], r["symbol"]) for r in universe.select_universe(by_year, 1).collect()}
    assert got == {(2000, 2), (2001, 2), (2003, 2)}


def test_eligibility_one_bad_flag_at_a_time(spark):
    good = ["NS", "EQTY", "CORP", "N", "Y"]
    rows = [good, *[good[:i] + [b] + good[i + 1 :] for i in range(5) for b in ("bad", None)], [*good[:2], "REIT", *good[3:]]]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    flags = lambda reits: [r[0] for r in df.select(universe.eligible(*map(F.col, "abcde"), include_reits=reits)).collect()]
    assert flags(True) == [True] + [False] * 10 + [True] and flags(False) == [True] + [False] * 11


def test_best_match_prefers_the_span(spark):
    spans = spark.createDataFrame([(1, 10, day(0), day(100)), (1, 20, day(300), day(400))], "gvkey long, permno long, start date, end date")
    rows = spark.createDataFrame([(1, day(20), day(50)), (1, day(200), day(350)), (1, day(900), day(5000))], "gvkey long, datadate date, eff_date date")
    linked = asof.link_by_span(rows, spans, "gvkey")
    best = asof.best_match(linked, ["gvkey", "datadate"], spark.createDataFrame([(20,)], "permno long"), "permno")
    assert {r["datadate"]: r["permno"] for r in best.collect()} == {day(20): 10, day(200): 20}


def test_growth_sign_survives_a_loss(spark):
    items = "revtq cogsq atq niq ceqq oiadpq saleq ltq dlttq actq lctq cheq prccq cshoq xrdq ibq".split()
    rows = [(1, day(90 * q), day(90 * q + 60), *[1.0] * (len(items) - 1), ibq) for q, ibq in enumerate((-10.0, 1.0, 1.0, 1.0, 5.0))]
    q = spark.createDataFrame(rows, "symbol long, datadate date, eff_date date, " + ", ".join(f"{c} double" for c in items))
    got = asof.characteristics(q).orderBy("datadate").collect()
    assert got[4]["cs_earnings_growth"] == 1.5 and got[3]["cs_earnings_growth"] is None


def test_neutralisation_is_orthogonal(spark):
    rng = random.Random(3)
    c1, c2 = ([[rng.random() for _ in range(40)] for _ in range(4)] for _ in range(2))
    x = [[3 * a + rng.gauss(0, 0.1) for a in row] for row in c1]
    x[3] = [v if s < 10 else None for s, v in enumerate(x[3])]
    df = frame(spark, x, c1=c1, c2=c2)
    out = neutralize.characteristic_neutralize(df, "x", ["c1", "c2"]).join(df.select("date", "symbol", cs.cs_rank(F.col("c1")).alias("r")), ["date", "symbol"])
    got = {r["date"]: r for r in out.groupBy("date").agg(F.sum(F.col("value") * F.col("r")).alias("dot"), F.sum("value").alias("total"), F.count("value").alias("n")).collect()}
    assert all(abs(got[day(t)]["dot"]) < 1e-8 and abs(got[day(t)]["total"]) < 1e-8 for t in range(3)) and got[day(3)]["n"] == 0


@pytest.mark.parametrize("tile", [2, 3, 64])
def test_correlation_of_every_pair(spark, tile):
    rng = random.Random(12)
    x = np.array([[rng.gauss(0, 1) for _ in range(60)] for _ in range(7)])
    x[3], x[5] = x[1] * 2 + 0.1 * x[3] + 1e6, 4.0  # nearly equal under an offset; constant
    rows = [(f"s{i}", day(c // 6), c % 6, float(x[i, c])) for i in range(7) for c in range(60) if not (i == 2 and c < 5)]
    long = spark.createDataFrame(rows, "signal_id string, date date, symbol long, value double")
    got = {(r["a"], r["b"]): r["rho"] for r in diversity.pair_correlations(long, tile).collect()}
    assert len(got) == 21
    for (a, b), rho in got.items():
        i, j = int(a[1]), int(b[1])
        assert (rho is None) == (5 in (i, j)) and (rho is None or abs(rho - np.corrcoef(x[i, 5:], x[j, 5:])[0, 1]) < 1e-9)
    known = [r for r in got.values() if r is not None]
    assert abs(diversity.pairwise_rho(long).first()["rho"] - sum(known) / len(known)) < 1e-9


def test_neutralisation_with_dependent_characteristics(spark):
    """A characteristic that repeats another, and one that is constant, change nothing; the residual is numpy's."""
    rng = random.Random(8)
    draw = lambda: [[rng.random() if rng.random() > 0.1 else None for _ in range(50)] for _ in range(3)]
    c1, c2, c3, x = draw(), draw(), draw(), [[rng.gauss(1e6, 1) if rng.random() > 0.1 else None for _ in range(50)] for _ in range(3)]
    df = frame(spark, x, c1=c1, c2=c2, c3=c3).withColumns({"again": 2 * F.col("c2"), "flat": F.lit(1.0)})
    rank = lambda rows: pd.DataFrame(rows, dtype=float).rank(axis=1, pct=True).fillna(0.5)
    want = {}
    for t in range(3):
        have = [s for s in range(50) if x[t][s] is not None]
        a = np.column_stack([np.ones(len(have)), *[rank(c).iloc[t, have] for c in (c1, c2, c3)]])
        y = np.array([x[t][s] for s in have])
        want |= {(day(t), s): v for s, v in zip(have, y - a @ np.linalg.lstsq(a, y, rcond=None)[0], strict=True)}
    for names in (["c1", "c2", "c3"], ["c1", "c2", "again", "flat", "c3"]):
        got = {(r["date"], r["symbol"]): r["value"] for r in neutralize.characteristic_neutralize(df, "x", names).collect() if r["value"] is not None}
        assert got.keys() == want.keys() and all(abs(v - want[k]) < 1e-7 for k, v in got.items()), names
    assert neutralize.characteristic_neutralize(df, "x", []).where("value IS NOT NULL").count() == len(want)


def test_orthogonal_slopes_from_gram_matrices(spark):
    """Many signals with gaps of their own: as the passes in turn give them, in a number of jobs that doesn't grow."""
    rng = random.Random(6)
    rows = [(f"s{i:02d}", day(t), s, rng.gauss(0, 1) + t) for i in range(12) for t in range(8) for s in range(9) if rng.random() > (0.3 if i % 4 == 1 else 0.05)]
    long = spark.createDataFrame(rows, "signal_id string, date date, symbol long, value double").cache()
    weights = {f"s{i:02d}": (i * 7 % 5 - 2.0) for i in range(12)}
    one, turn = combine.fit_orthogonal(long, weights), combine.fit_orthogonal(long, weights, most_entries=0)
    assert [i for i, _ in one] == [i for i, _ in turn] and one[0][1] is None
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(one[1:], turn[1:], strict=True))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("gram"))
    spark.sparkContext.setJobGroup("gram", "")
    seen = []
    for n in (4, 12):
        before = jobs()
        combine.fit_orthogonal(long, {k: weights[k] for k in sorted(weights)[:n]})
        seen.append(jobs() - before)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen[0] == seen[1] > 0
    assert combine.fit_orthogonal(long.limit(0), {"s00": 1.0, "s01": 0.5}) == [("s00", None), ("s01", 0.0)]


def test_orthogonal_fit_and_apply(spark):
    rng = random.Random(4)
    cells = [(day(t), s) for t in range(6) for s in range(8)]
    a = {c: rng.gauss(0, 1) for c in cells}
    b = {c: 2 * a[c] + rng.gauss(0, 1) for c in cells}
    c3 = {c: rng.gauss(0, 1) for c in cells}
    del a[cells[0]]
    rows = [(i, *c, v) for i, x in (("a", a), ("b", b), ("c", c3)) for c, v in x.items()]
    long = spark.createDataFrame(rows, "signal_id string, date date, symbol long, value double")
    betas = combine.fit_orthogonal(long, {"a": 3.0, "b": -2.0, "c": 1.0})
    both = [c for c in cells if c in a]
    beta = sum(b[c] * a[c] for c in both) / sum(a[c] ** 2 for c in both)
    assert [i for i, _ in betas] == ["a", "b", "c"] and betas[0][1] is None and abs(betas[1][1] - beta) < 1e-9
    got = {(r["date"], r["symbol"]): r["value"] for r in combine.apply_orthogonal(long, betas).collect()}
    assert got[cells[0]] is None  # the first signal lacks it, so it never recovers
    for c in both:
        r2 = b[c] - beta * a[c]
        r3 = c3[c] - betas[2][1] * (a[c] + r2) / 2
        assert abs(got[c] - (a[c] + r2 + r3) / 3) < 1e-9
    two = {(r["date"], r["symbol"]): r["value"] for r in combine.apply_orthogonal(long.where("signal_id <> 'a'"), betas).collect()}
    assert abs(two[cells[1]] - (b[cells[1]] + c3[cells[1]] - betas[2][1] * b[cells[1]]) / 2) < 1e-9


def test_gate_statuses(spark):
    n = 30
    rows = [("ok", t, s, float(s * (t + 1))) for t in range(10) for s in range(n)] + [("flat", t, s, 1.0) for t in range(10) for s in range(n)]
    rows += [("none", t, s, None) for t in range(10) for s in range(n)] + [("thin", t, s, float(s) if s < 3 else None) for t in range(10) for s in range(n)]
    df = spark.createDataFrame([(i, day(t), t, s, v) for i, t, s, v in rows], "signal_id string, date date, t int, symbol long, value double")
    assert {r["signal_id"]: r["status"] for r in gate.quality_gate(df).collect()} == {"ok": "ok", "flat": "constant", "none": "all_nan", "thin": "sparse"}


def test_subset_draw(spark):
    menu = spark.createDataFrame([(f,) for m in screen.FAMILIES.values() for f in m], "field string")
    ideas = spark.range(3000).withColumnRenamed("id", "idea")
    size = screen.default_subset_size(menu.count())
    got = [r["fields"] for r in screen.draw_field_subset(ideas, menu).collect()]
    daily = {f for name in screen.DAILY_FAMILIES for f in screen.FAMILIES[name]}
    assert all(len(set(x)) == size and set(x) & daily and x == sorted(x) for x in got)
    seen = pd.Series([f for x in got for f in x]).value_counts()
    assert len(seen) == menu.count() and seen.max() < 8 * seen.min()
    assert screen.draw_field_subset(ideas.limit(2), menu, 100).first()["fields"] == sorted(r[0] for r in menu.collect())


def test_expressions(spark):
    say = ["cs_rank(ts_delta(close, 5))", "rank(returns)", "ts_mean(ts_std(x, 7), 20)", "ts_corr(a, b, 10)", "ts_mean_5(x)", "ts_sum(x, 7)", "corr(a, b)", None, "add(cs_rank(a),neg(cs_rank(b)))"]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(say)], "i int, e string")
    got = [r[0] for r in df.orderBy("i").select(text.normalize_expression(F.col("e"))).collect()]
    assert got == ["cs_rank(ts_delta_5(close))", "cs_rank(returns)", "ts_mean_20(ts_std_20(x))", "ts_corr_10(a, b)", "ts_mean_5(x)", "ts_sum(x, 7)", "ts_corr_20(a, b)", None, say[8]]
    last = df.where("i = 8").select(text.n_terminals(F.col("e")), text.depth(F.col("e"))).first()
    assert tuple(last) == (2, 3)


def test_deep_formulas(spark):
    """Windows are curried at every depth; equal arguments are found whatever they hold."""
    deep = "close"
    for _ in range(20):
        deep = f"ts_mean({deep}, 5)"
    rows = {
        deep: (deep.replace("ts_mean(", "ts_mean_5(").replace(", 5)", ")"), None),
        f"neg({deep})": (None, "too_deep"),
        "sub(add(a, b), add(a, b))": (None, "degenerate"),
        "sub(add(a, b), add(b, a))": (None, None),
        "cs_rank(safe_div( ts_cov_20(a,b) ,ts_cov_20( a, b )))": (None, "degenerate"),
        "neg(ts_corr_10(sub(a, b), sub(a, c)))": (None, None),
        "mul(sub(a, mul(b, sub(c, d))), sub(a, mul(b, sub(c, d))))": (None, None),
        "add(x, subtract(a, a))": (None, "degenerate"),
        "sign( abs_val(add(a, b)))": (None, "degenerate"),
        "sign(neg(abs_val(a)))": (None, None),
        "sub(sub(a, b), sub(a,b)": (None, None),
        "a)), b((": (None, None),
        " ": (None, "empty"),
    }
    df = spark.createDataFrame(list(enumerate(rows)), "i int, e string").orderBy("i")
    got = df.select(text.normalize_expression(F.col("e")).alias("n"), text.structural_reject(F.col("e")).alias("r")).collect()
    for (e, (curried, reason)), r in zip(rows.items(), got, strict=True):
        assert r["r"] == reason and (curried is None or r["n"] == curried), (e, tuple(r))


def test_torn_idea_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"idea": "x", "expressions": ["f(a)", "g(b)", "h(c)"], "prompt_tokens": 10}\n\n{"idea": "y", "expr\n{"idea": "z", "expressions": []}\n[1, 2\n')
    good, bad = readers.read_ideas(spark, str(tmp_path))
    assert sorted(r["idea"] for r in good.collect()) == ["x", "z"] and sorted(r["line"] for r in bad.collect()) == ["[1, 2", '{"idea": "y", "expr']
    assert [(r["at"], r["expression"], r["prompt_tokens"]) for r in readers.idea_expressions(good).orderBy("at").collect()] == [(0, "f(a)", 3), (1, "g(b)", 3), (2, "h(c)", 3)]


def test_jdbc_by_year_keeps_the_last_day_and_missing_dates(spark):
    rows = [(i, x) for i, x in enumerate(["1999-12-31 23:59:59", "2000-01-01 00:00:00", "2000-12-31 18:30:00", None, "2001-06-01 00:00:00", "2002-01-01 00:00:00"])]
    df = spark.createDataFrame(rows, "id int, said string").select("id", F.col("said").cast("timestamp").alias("at"))
    url, driver = "jdbc:derby:memory:years;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df.write.jdbc(url, "moments", mode="overwrite", properties=driver)
    got = readers.read_jdbc_yearly(spark, url, "moments", '"at"', 2000, 2001, driver, timestamps=True)
    assert got.rdd.getNumPartitions() == 3 and sorted(r[0] for r in got.select("id").collect()) == [1, 2, 3, 4]


def test_json_payloads(spark):
    say = ['[1, 2]', 'So:\n```json\n{"a": 1}\n```\nbye', '```\n[3]\n```', 'text {"b": [1]} end', "none {here", "", None, '  {"c": 2} ']
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(say)], "i int, s string").orderBy("i").select(text.extract_json_payload(F.col("s"))).collect()]
    assert got[0] == "[1, 2]" and got[1] == '{"a": 1}' and got[2] == "[3]" and got[4:7] == [None, None, None] and got[7] == '{"c": 2}'
    assert got[3] in ("[1]", '{"b": [1]}')


def test_catalogue_filters(spark):
    rows = [("a", "ok", 0.05, -3.0), ("b", "ok", -0.02, 1.0), ("c", "ok", None, 9.0), ("d", "reject", 0.5, 9.0)]
    df = writers.evolve_schema(spark.createDataFrame(rows, "hash string, status string, is_ic double, is_tstat double"))
    assert [r["hash"] for r in runs.catalogue_filter(df, min_ic=0.01, order_by="is_tstat").collect()] == ["b", "a"]
    assert runs.catalogue_filter(df, min_coverage=0.1).count() == 0
    with pytest.raises(ValueError):
        runs.catalogue_filter(df, order_by="hash; drop")


def test_effective_breadth_guards(spark):
    one = spark.createDataFrame([(1.0,)], "mean_sharpe double")
    at = lambda rho, n: diversity.effective_breadth(spark.createDataFrame([(rho, n)], "rho double, n long"), one).first()
    assert round(at(0.5, 10)["n_eff"], 6) == round(10 / 5.5, 6) and at(-0.2, 6)["n_eff"] == float("inf") and at(-0.1, 3)["ceiling"] == float("inf")


def test_contract(spark):
    df = spark.createDataFrame([("7", 1.0)], "PERMNO string, cap double")
    out = readers.enforce_contract(df, ["symbol"], ["bid"], {"PERMNO": "symbol"}, ["symbol"])
    assert out.schema["symbol"].dataType.simpleString() == "bigint" and out.first()["bid"] is None
    with pytest.raises(ValueError, match="missing"):
        readers.enforce_contract(df, ["nope"])
    years = readers.yearly_predicates("d", 2000, 2001)
    assert years == ["d >= {d '2000-01-01'} AND d < {d '2001-01-01'}", "d >= {d '2001-01-01'} AND d < {d '2002-01-01'}", "d IS NULL"]


def test_unknown_signals_are_missing(spark, ragged):
    df, _, _ = ragged
    out = signal_columns(df, {"a": ("ts_mean_5", "nope"), "b": ("no_op", "x"), "c": ("add", "x"), "d": ("add", "x", 1.0)})
    assert out.agg(F.count("a"), F.count("b"), F.count("c"), F.count("d")).first()[:3] == (0, 0, 0)


def test_year_partitions_prune(spark, tmp_path):
    df = frame(spark, [[1.0]] * 800)
    writers.write_panel(df, str(tmp_path / "p"))
    plan = spark.read.parquet(str(tmp_path / "p")).where("year = 2021")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_run_documents_stay_small(spark, tmp_path):
    """A source with many runs makes more documents, not a larger one; equal runs are all kept."""
    path = str(tmp_path / "runs")
    rows = spark.range(20_000).selectExpr("""concat('{"params":{"source":"', if(id < 19000, 'a', 'b'), '"},"n_survivors":', id % 7, '}') AS run""")
    writers.write_documents(rows, "run", path, 1_000)
    texts = [len(r[0]) for r in spark.read.option("wholetext", True).text(f"{path}/*.txt").collect()]
    assert 15 <= len(texts) <= 20 and max(texts) < 1_500 * 50
    back = readers.read_run_json(spark, f"{path}/*.txt").groupBy("params.source").agg(F.count(F.lit(1)), F.sum("n_survivors"))
    assert sorted(map(tuple, back.collect())) == [("a", 19_000, sum(i % 7 for i in range(19_000))), ("b", 1_000, sum(i % 7 for i in range(19_000, 20_000)))]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_grid_of_odd_facts_moves_rows_once(spark):
    """Gaps before, between and after facts, repeats, facts without date or symbol: as by a join with all cells. Facts dealt out by symbol don't move again."""
    days = [datetime.date(2020, 1, d) for d in (1, 3, 4, 8, 9)]
    rows = [(days[1], 1, 1.0), (days[3], 1, 2.0), (days[3], 1, 2.5), (days[0], 2, 3.0), (days[4], 2, 4.0), (None, 2, 9.0), (None, 3, 5.0), (None, 3, 6.0), (days[2], None, 7.0), (days[2], None, 7.5), (days[4], 4, None), (days[2], 5, 8.0)]
    facts = spark.createDataFrame(rows, "date date, symbol long, x double").repartition("symbol")
    calendar = spark.createDataFrame([(d,) for d in [*days, None, days[0]]], "date date")
    want = []
    for s in {r[1] for r in rows}:
        for t, d in enumerate(days):
            want += [(d, s, t, x) for x in ([r[2] for r in rows if r[0] == d and r[1] == s] if s is not None else []) or [None]]
    for out in (readers.densify(facts), readers.densify(facts, days=calendar)):
        assert out.columns == ["date", "symbol", "t", "x"]
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    with_window = readers.densify(facts, days=calendar).withColumn("past", F.lag("x").over(ts.by_time()))
    plan = _plan(with_window)
    assert plan.count("Exchange hashpartitioning(symbol") == 1 and "SortMergeJoin" not in plan
    assert readers.densify(facts.limit(0)).count() == 0


def test_combining_moves_no_row_by_signal(spark):
    """Weights and z-scores reach the cells where they are: no exchange by signal alone, which would make a signal one task's, and none by signal and date."""
    rows = [(s, datetime.date(2020, 1, 1 + d), i, float((i * 7 + d * 3 + k) % 5)) for k, s in enumerate("ab") for d in range(3) for i in range(6)]
    long = spark.createDataFrame([*rows, ("a", datetime.date(2020, 1, 9), 1, 2.0), ("b", None, 1, 2.0)], "signal_id string, date date, symbol int, value double")
    z = gate.standardised(long)
    frame = long.toPandas()
    groups = frame.groupby(["signal_id", "date"], dropna=False)["value"]
    frame["z"] = (frame["value"] - groups.transform("mean")) / groups.transform("std")
    got, key = z.toPandas(), ["signal_id", "date", "symbol"]
    both = got.merge(frame, on=key)
    assert len(both) == len(frame) and np.allclose(both["value_x"].astype(float), both["z"], equal_nan=True)
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "signal_id string, weight double")
    plan = _plan(combine.combine_weighted(z, weights))
    assert "hashpartitioning(signal_id" not in plan and "Window" not in plan


def test_wide_panels_in_blocks_of_columns(spark, tmp_path):
    rows = [(datetime.date(2020, 1, 1 + d), s, None if (s + d) % 7 == 0 else float(s * d), float("nan") if s == 5 else float(s)) for s in [*range(25), -3, 2**40] for d in range(4)]
    facts = spark.createDataFrame([*rows, (datetime.date(2020, 1, 2), None, 1.0, 1.0)], "date date, symbol long, x double, y double")
    paths = writers.write_wide_panels(facts, str(tmp_path / "wide"), {"x": "x", "y": "y", "_hidden": "x", "sector": "y"}, most=10)
    assert len(paths) == 12 and max(len(spark.read.parquet(p).columns) for p in paths) == 11
    assert sorted(sum(([int(c) for c in spark.read.parquet(p).columns if c != "date"] for p in paths if p.endswith("/x.parquet")), [])) == sorted({r[1] for r in rows})
    got = sorted(map(tuple, readers.read_wide_panels(spark, paths).select("date", "symbol", "x", "y").collect()), key=lambda r: r[:2])
    want = sorted(((d, s, x, None if y != y else y) for d, s, x, y in rows if x is not None or y == y), key=lambda r: r[:2])
    assert got == want


def test_wide_panel_of_mixed_types(spark, tmp_path):
    path = str(tmp_path / "z.parquet")
    spark.createDataFrame([("2020-01-01", 1, "2.5", 3.0), ("2020-01-02", None, "n/a", float("nan"))], "date string, `1` int, `2` string, `3` double").write.parquet(path)
    got = readers.read_wide_panels(spark, [path]).orderBy("symbol").collect()
    assert [(str(r["date"]), r["symbol"], r["z"]) for r in got] == [("2020-01-01", 1, 1.0), ("2020-01-01", 2, 2.5), ("2020-01-01", 3, 3.0)]


def test_wide_files_beyond_a_plan_are_read_a_few_at_a_time(spark, tmp_path):
    """Five files of 1,000 symbols each are more columns than a plan may have: what comes back reads written cells, not 5,000 columns; few files stay one plan."""
    for k, name in enumerate("abcde"):
        cells = {"date": [datetime.date(2020, 1, 1), datetime.date(2020, 1, 2)]} | {str(s): [float(s + k), None if s % 2 else float(-s)] for s in range(1000)}
        pq.write_table(pa.table(cells), tmp_path / f"{name}.parquet")
    paths = [f"{tmp_path}/{name}.parquet" for name in "abcde"]
    out = readers.read_wide_panels(spark, paths)
    assert _plan(out).count("FileScan parquet") == 1 and "Union" not in _plan(out)
    assert _plan(readers.read_wide_panels(spark, paths[:2])).count("FileScan parquet") == 2
    got = {(r["date"].day, r["symbol"]): tuple(r[c] for c in "abcde") for r in out.collect()}
    assert got == {(1, s): tuple(float(s + k) for k in range(5)) for s in range(1000)} | {(2, s): (float(-s),) * 5 for s in range(0, 1000, 2)}


def test_wide_writes_leave_no_plans_with_the_driver(spark, tmp_path):
    """Without Python's own search for cycles, four times the files leave as many proxies of the JVM's objects, not four times as many; plan texts name a symbol a few times; gaps stay null."""
    first = 7_000_000_000
    rows = [(datetime.date(2020, 1, 1 + d), first + s, float(s + d)) for s in range(80) for d in range(4) if (s * 7 + d * 5) % 11 > 5]
    facts = spark.createDataFrame(rows, "date date, symbol long, x double")
    status, kept = spark._jsparkSession.sharedState().statusStore(), []
    begun = status.executionsCount()
    try:
        gc.disable()
        for most in (40, 10):
            gc.collect()
            before = len(ThreadSafeFinalizer.finalizers)
            paths = writers.write_wide_panels(facts, str(tmp_path / f"wide{most}"), {"x": "x", "y": "x", "z": "x"}, most=most)
            kept.append(len(ThreadSafeFinalizer.finalizers) - before)
    finally:
        gc.enable()
    assert len(paths) == 24 and kept[1] < 2 * kept[0] + 50
    wide = writers.write_wide_panels(facts, str(tmp_path / "wide"), {"x": "x"})
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    texts = [status.executionsList(i, 1).head().physicalPlanDescription() for i in range(begun, status.executionsCount())]
    assert len(texts) > 24 and 0 < max(t.count(f"{first + 70}") for t in texts) < 10
    cells = [(d, int(s), v) for d, *vs in spark.read.parquet(*wide).collect() for s, v in zip(spark.read.parquet(*wide).columns[1:], vs, strict=True)]
    assert sorted(c for c in cells if c[2] is not None) == sorted(rows) and len(cells) == 4 * 80


def test_cells_of_an_idea_stay_where_the_idea_is(spark):
    """Only ideas move by exchange, not each with every field."""
    ideas, fields = spark.range(50).withColumnRenamed("id", "idea"), spark.createDataFrame([(f,) for m in screen.FAMILIES.values() for f in m], "field string")
    plan = _plan(screen.draw_field_subset(ideas, fields))
    assert plan.count("Exchange hashpartitioning(idea") == 1


def test_full_cells_of_few_signals_need_no_lists(spark):
    """Cells with a value of every signal, each in its place; a cell with one twice and another missing isn't whole."""
    d = datetime.date(2020, 1, 1)
    rows = [("b", d, 1, 2.0), ("a", d, 1, 1.0), ("a", d, 2, 3.0), ("b", d, 2, None), ("a", d, 3, 4.0), ("a", d, 3, 5.0), ("b", d, 4, 7.0), ("a", d, 4, 6.0)]
    long = spark.createDataFrame(rows, "signal_id string, date date, symbol int, value double")
    full, _ = diversity._full_cells(long)
    assert sorted(r["v"] for r in full.collect()) == [[1.0, 2.0], [6.0, 7.0]]
    many = long.unionByName(long.where("symbol = 99"))
    assert diversity._full_cells(many.limit(0))[0].count() == 0


def test_best_match_carries_what_is_asked_for(spark):
    from crosspanel.queries import queries

    assert "rdq" in (plan := _plan(queries()["j06_best_match"](spark, "/root/testdata/sf0.001"))) and "l_extendedprice" not in plan


def test_tasks_become_more_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(writers, "TASK_ROWS", 100)
    assert [writers.dealt(spark.range(n), "id").rdd.getNumPartitions() for n in (10, 1_000, 5_000)] == [4, 10, 50]
    assert writers.dealt(spark.range(100), "id", times=20).rdd.getNumPartitions() == 20


def test_signals_as_columns_give_what_long_tables_give(spark):
    """Standardising, combining, fitting and diagnosing signals that are columns: the same numbers, and combining moves no cell."""
    from crosspanel.plans.score import diagnose_columns

    rng, names = np.random.default_rng(8), ["a", "b", "c"]
    cells = [(datetime.date(2020, 1, 1) + datetime.timedelta(t), t, s, 0.1, *[round(float(x), 1) if rng.random() > 0.2 else None for x in rng.normal(size=2)], 3.3 if s < 4 else None) for t in range(40) for s in range(6)]
    wide = spark.createDataFrame(cells, "date date, t int, symbol long, forward_returns double, a double, b double, c double")
    long = wide.unpivot(["date", "t", "symbol", "forward_returns"], names, "signal_id", "value")
    rows = lambda df: {(r["date"], r["symbol"]): r["value"] for r in df.collect()}
    same = lambda x, y: x.keys() == y.keys() and all((x[k] is None) == (y[k] is None) and (x[k] is None or abs(x[k] - y[k]) < 1e-9) for k in x)
    z, zl = gate.standardised_columns(wide, names), gate.standardised(long)
    mean = z.select("date", "symbol", combine.mean_of(names).alias("value"))
    assert same(rows(mean), rows(combine.combine_equal(zl)))
    assert "hashpartitioning" not in mean._jdf.queryExecution().executedPlan().toString()
    weights = {"a": 2.0, "b": -1.0, "c": 0.5}
    betas = combine.fit_orthogonal(zl, weights)
    for most in (0, 1000):
        assert all(x == y and (b is None) == (c is None) and (b is None or abs(b - c) < 1e-9) for (x, b), (y, c) in zip(betas, combine.fit_columns(z, weights, most), strict=True))
    assert same(rows(combine.apply_columns(z, betas)), rows(combine.apply_orthogonal(zl, betas)))
    want = {r["signal_id"]: r.asDict() for r in gate.signal_diagnostics(long).collect()}
    for most in (0, 1000):
        got = {r["signal_id"]: r.asDict() for r in diagnose_columns(wide, names, most_names=most).collect()}
        assert got.keys() == want.keys() and all(got[k][c] == pytest.approx(want[k][c], abs=1e-9) for k in want for c in want[k] if c != "signal_id")


def test_all_of_the_exponential_mean_runs_in_those_tasks(spark, monkeypatch):
    from crosspanel.queries import queries

    small = "/root/testdata/sf0.001"
    monkeypatch.setattr(writers, "TASK_ROWS", 100)
    n = -(-spark.read.parquet(f"{small}/lineitem.parquet").count() // 100)
    assert queries()["w14_ts_ema"](spark, small).rdd.getNumPartitions() == n > 40
