"""The operator registry: every registered name with its arity, and how to apply it to columns.

Adding a name here makes it available to `evaluate`; an operator is a function from columns to a column.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column

from ..functions import crosssection as cs
from ..functions import elementwise as el
from ..functions import timeseries as ts

# The registered windows of each time-series operator.
WINDOWS: dict[str, tuple[int, ...]] = {
    "ts_mean": (5, 10, 20, 60),
    "ts_std": (5, 10, 20, 60),
    "ts_delta": (5, 10, 20),
    "ts_rank": (5, 10, 20),
    "ts_min": (5, 10, 20),
    "ts_max": (5, 10, 20),
    "ts_returns": (1, 5, 20),
    "ts_corr": (10, 20),
    "ts_shift": (1, 5, 20),
    "ts_sum": (5, 20),
    "ts_median": (20,),
    "ts_skew": (60,),
    "ts_kurt": (60,),
    "ts_ema": (10, 60),
    "ts_zscore": (20, 60),
    "ts_ir": (20, 60),
    "ts_maxmin_scale": (20, 60),
    "ts_max_diff": (20, 60),
    "ts_min_diff": (20, 60),
    "ts_delta_ratio": (5, 20),
    "ts_decayed_linear": (5, 20),
    "ts_linear_reg": (20,),
    "ts_cov": (20,),
    "ts_argmax": (20,),
    "ts_argmin": (20,),
}
CROSS_SECTION = ("cs_rank", "cs_zscore", "cs_winsorize", "normed_rank_diff")
ELEMENT_WISE = ("add", "sub", "mul", "safe_div", "log_abs", "abs_val", "sign", "neg", "relu", "square", "signed_sqrt", "cwise_max", "cwise_min", "greater", "less")


def _columns(fn: Callable) -> int:
    return sum(p.name in ("x", "y") for p in inspect.signature(fn).parameters.values())


def registry() -> dict[str, tuple[int, Callable[..., Column]]]:
    """name -> (number of column arguments, function of that many columns)."""
    out: dict[str, tuple[int, Callable[..., Column]]] = {}
    for base, windows in WINDOWS.items():
        fn = getattr(ts, base)
        for w in windows:
            out[f"{base}_{w}"] = (_columns(fn), lambda *c, fn=fn, w=w: fn(*c, w))
    for module, names in ((cs, CROSS_SECTION), (el, ELEMENT_WISE)):
        for name in names:
            out[name] = (_columns(getattr(module, name)), getattr(module, name))
    return out


REGISTRY = registry()
#: Operators that work across a date; the others work along a symbol or on single cells.
IS_CROSS_SECTION = frozenset(CROSS_SECTION)
