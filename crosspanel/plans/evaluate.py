"""Many signals in few plans.

A signal is a nested tuple: ("cs_rank", ("ts_delta_5", "close")); a string is a field, a number a constant. Signals of a batch share equal
sub-formulas: every distinct node becomes one column, level by level, and nodes along time are put before nodes across dates within a
level, so a batch costs at most two exchanges per level, however many signals it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crosssection import cs_rank, cs_winsorize, cs_zscore
from ..functions.elementwise import finite
from ..functions.orders import ORDERS
from ..functions.rolling import EXTREMES, MOMENTS, Ask, with_rolling
from ..sources.writers import materialized
from .registry import IS_CROSS_SECTION, REGISTRY, WINDOWS

Formula = str | float | tuple
#: Most signals per plan.
BATCH = 24
#: Signals up to which kinds share a plan: reading the panel once more costs more than the wider rows.
FEW = 8
#: Digits that derived columns keep before they are ranked, so that equal values tie.
DIGITS = 12
#: Registered functions whose windows are made together, with base name and window.
ROLLING = {f"{base}_{w}": (base, w) for base in (*MOMENTS, *EXTREMES, *ORDERS) for w in WINDOWS[base]}
#: Functions of one column across the symbols of a date, which can be keyed by signal too.
ACROSS = {"cs_rank": cs_rank, "cs_zscore": cs_zscore, "cs_winsorize": lambda x, keys: cs_winsorize(x, keys=keys)}


def text(f: Formula) -> str:
    return f"{f[0]}({', '.join(map(text, f[1:]))})" if isinstance(f, tuple) else str(f)


def level(f: Formula) -> int:
    return 1 + max(map(level, f[1:])) if isinstance(f, tuple) else 0


def _nodes(f: Formula, found: dict[str, tuple]) -> None:
    if isinstance(f, tuple):
        for x in f[1:]:
            _nodes(x, found)
        found.setdefault(text(f), f)


def _valid(f: Formula, columns: set[str]) -> bool:
    if isinstance(f, tuple):
        return f[0] in REGISTRY and REGISTRY[f[0]][0] == len(f) - 1 and all(_valid(x, columns) for x in f[1:])
    return not isinstance(f, str) or f in columns


def signal_columns(panel: DataFrame, signals: dict[str, Formula]) -> DataFrame:
    """panel with a column per signal. An unknown field, operator or number of arguments makes the whole signal missing."""
    columns = set(panel.columns)
    good = {k: f for k, f in signals.items() if _valid(f, columns)}
    nodes: dict[str, tuple] = {}
    for f in good.values():
        _nodes(f, nodes)
    names = {key: f"_node{i}" for i, key in enumerate(nodes)}
    at = lambda f: F.col(names[text(f)]) if isinstance(f, tuple) else F.col(f) if isinstance(f, str) else F.lit(float(f))

    def column(f: tuple):
        ranked = f[0].startswith("ts_rank") or f[0] in ("cs_rank", "normed_rank_diff")
        args = [F.round(at(x), DIGITS) if ranked and isinstance(x, tuple) else at(x) for x in f[1:]]
        return REGISTRY[f[0]][1](*args)

    for depth in range(1, max(map(level, good.values()), default=0) + 1):
        now = [f for f in nodes.values() if level(f) == depth]
        together = [f for f in now if f[0] in ROLLING and not any(isinstance(x, int | float) for x in f[1:])]
        if together:
            rounded = {f"{names[text(x)]}_r": F.round(at(x), DIGITS) for f in together if f[0].startswith("ts_rank") for x in f[1:] if isinstance(x, tuple)}
            panel = panel.withColumns(rounded)
            of = lambda f, x: x if not isinstance(x, tuple) else names[text(x)] + "_r" * f[0].startswith("ts_rank")
            panel = with_rolling(panel, [Ask(names[text(f)], *ROLLING[f[0]], tuple(of(f, x) for x in f[1:])) for f in together]).drop(*rounded)
            now = [f for f in now if f not in together]
        for across in (False, True):
            if some := {names[text(f)]: column(f) for f in now if (f[0] in IS_CROSS_SECTION) == across}:
                panel = panel.withColumns(some)
    out = panel.withColumns({k: finite(at(good[k])) if k in good else F.lit(None).cast("double") for k in signals})
    return out.drop(*names.values())


def _outer(f: Formula) -> str | None:
    """The function across dates that a formula ends with, if it is one of a single column."""
    return f[0] if isinstance(f, tuple) and f[0] in ACROSS and len(f) == 2 else None


def parts(signals: dict[str, Formula], columns: set[str], most: int = BATCH) -> Iterator[dict[str, Formula]]:
    """The signals in plans of at most `most`, like with like: rows grow with every column that a plan makes, so functions that share none go apart."""
    if 0 < len(signals) <= min(FEW, most):
        yield dict(signals)
        return
    kinds: dict[int, dict[str, Formula]] = {}
    for k, f in signals.items():
        own = inner(f, columns)[1]
        name = ROLLING.get(own[0], ("",))[0] if isinstance(own, tuple) else ""
        kinds.setdefault(next((i for i, some in enumerate((MOMENTS, EXTREMES, ORDERS), 1) if name in some), 0), {})[k] = f
    for kind in sorted(kinds):
        n = -(-len(kinds[kind]) // most)
        for part in batched(kinds[kind].items(), -(-len(kinds[kind]) // n)):
            yield dict(part)


def inner(f: Formula, columns: set[str]) -> tuple[str, Formula, bool]:
    """The function across dates that a formula ends with ("" for none), what it is applied to, and whether that is derived."""
    end = _outer(f) if _valid(f, columns) else None
    return (end, f[1], isinstance(f[1], tuple)) if end else ("", f, isinstance(f, tuple))


def _long(wide: DataFrame, signals: dict[str, str], keep: tuple[str, ...]) -> DataFrame:
    """signal_id, the kept columns, value; signals: per id the function across dates that its column still has to go through ("" for none, "+" behind it where the argument is derived)."""
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("_at"))
    long = wide.select(*keep, F.posexplode(F.array(*[F.col(f"`{k}`") for k in signals])).alias("_at", "value"))
    long = long.select(of([*signals]).alias("signal_id"), *keep, "value", of([*signals.values()]).alias("_kind"))
    kind, value = F.col("_kind"), F.col("value")
    for name in sorted({k.rstrip("+") for k in signals.values()} - {""}):
        x = F.when(kind == name, F.col("value")).when(kind == f"{name}+", F.round("value", DIGITS) if name == "cs_rank" else F.col("value"))
        value = F.when(kind.isin(name, f"{name}+"), finite(ACROSS[name](x, ("signal_id", "date")))).otherwise(value)
    return long.withColumn("value", value).drop("_kind")


def evaluate_signals(panel: DataFrame, signals: dict[str, Formula], keep: tuple[str, ...] = ("date", "t", "symbol")) -> DataFrame:
    """signal_id, the kept columns, value: a long table of all signals, BATCH signals per plan.

    A function across dates at the end of formulas is applied to the long table, by signal and date: one exchange and one sort for all signals
    instead of a sort of the wide table for each.
    """
    out = None
    if len(signals) > BATCH:  # read by more than one plan
        panel = materialized(panel, "panel")
    columns = set(panel.columns)
    for part in parts(signals, columns):
        ends = {k: inner(f, columns) for k, f in part.items()}
        wide = signal_columns(panel, {k: f for k, (_, f, _) in ends.items()})
        long = _long(wide, {k: end + "+" * derived if end else "" for k, (end, _, derived) in ends.items()}, keep)
        out = long if out is None else out.unionByName(long)
    if out is None:
        raise ValueError("no signals")
    return out
