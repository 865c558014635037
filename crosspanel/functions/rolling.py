"""Rolling functions of many windows at once, at a cost that doesn't depend on their length.

Moments: rows are cut into blocks of consecutive t. Within a block, running sums of powers of the distance to the block's first value; a window that ends in a block is the
difference of two running sums, or, where it begins in the block before, that block's total less a running sum, moved to the same centre. So every
window of a field comes from the same few running sums and one lag for each length. Distances to a value nearby keep their digits where the values have
a large offset. Whether a window is constant is not left to rounding: the last place where a value differs from the next one is carried along.

Extremes: a table of the extremes of spans of 1, 2, 4, ... rows, each from two of the span before; two overlapping spans make up any window. With
positions, the older span wins ties.

Ranks and medians: see `orders`.

Windows count rows of a dense grid: t rises by one from row to row of a symbol. All but the ranks and medians shares a single sort by symbol, block and t.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .orders import ORDERS, with_orders

#: Rows of a block, at least; a window is no longer than a block.
BLOCK = 64
MOMENTS = ("ts_mean", "ts_std", "ts_sum", "ts_zscore", "ts_ir", "ts_skew", "ts_kurt", "ts_decayed_linear", "ts_linear_reg", "ts_corr", "ts_cov")
EXTREMES = ("ts_min", "ts_max", "ts_maxmin_scale", "ts_max_diff", "ts_min_diff", "ts_argmax", "ts_argmin")
#: Powers of the distance that a function needs; "q" is the distance times the place in the block.
_POWERS = {"ts_mean": (1,), "ts_sum": (1,), "ts_skew": (1, 2, 3), "ts_kurt": (1, 2, 3, 4), "ts_decayed_linear": (1, "q"), "ts_linear_reg": (1, "q")}
_SPREAD = ("ts_std", "ts_zscore", "ts_ir", "ts_skew", "ts_kurt", "ts_corr")


@dataclass(frozen=True)
class Ask:
    """A column `name` for function `base` with window w of the columns `args`."""

    name: str
    base: str
    w: int
    args: tuple[str, ...]


@dataclass
class _Source:
    """A column whose sums are kept, under a prefix."""

    prefix: str
    value: str
    powers: set = field(default_factory=set)
    lengths: set[int] = field(default_factory=set)
    spread: bool = False


def with_rolling(panel: DataFrame, asks: list[Ask]) -> DataFrame:
    """panel with a column for every ask."""
    columns = panel.columns
    asks = list(asks)
    for size in sorted({_block(a.w) for a in asks if a.base in MOMENTS}):
        panel = _moments(panel, [a for a in asks if a.base in MOMENTS and _block(a.w) == size], size)
    if some := [a for a in asks if a.base in EXTREMES]:
        panel = _extremes(panel, some)
    if some := [(a.name, a.base, a.w, a.args[0]) for a in asks if a.base in ORDERS]:
        panel = with_orders(panel, some)
    return panel.select(*columns, *[a.name for a in asks])


def _block(w: int) -> int:
    return max(BLOCK, 1 << (w - 1).bit_length())


def _with(panel: DataFrame, columns: dict[str, str]) -> DataFrame:
    """panel with columns from SQL: there are hundreds of them, and a text is one call each."""
    return panel.selectExpr("*", *[f"{sql} AS {name}" for name, sql in columns.items()])


_OWN = "OVER (PARTITION BY symbol, _at ORDER BY t ROWS UNBOUNDED PRECEDING)"
_LINE = "OVER (PARTITION BY symbol ORDER BY _at, t)"
_PAST = "OVER (PARTITION BY symbol ORDER BY _at, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_UPTO = "OVER (PARTITION BY symbol ORDER BY _at, t ROWS UNBOUNDED PRECEDING)"
_BEFORE = "OVER (PARTITION BY symbol ORDER BY _at RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"


def _power(d: str, p: int) -> str:
    return " * ".join([d] * p) if p else "1D"


def _moments(panel: DataFrame, asks: list[Ask], size: int) -> DataFrame:
    kept = panel.columns
    singles: dict[str, _Source] = {}
    pairs: dict[tuple[str, str], tuple[_Source, _Source]] = {}
    for a in asks:
        if len(a.args) == 1:
            own = [singles.setdefault(a.args[0], _Source(f"_m{len(singles)}", f"`{a.args[0]}`"))]
        else:  # both sides where both are present
            x, y = (f"`{c}`" for c in a.args)
            own = pairs.setdefault(a.args, tuple(_Source(f"_p{len(pairs)}{i}", f"if({v} IS NULL, NULL, {u})") for i, (u, v) in enumerate(((x, y), (y, x)))))
        for s in own:
            s.powers |= {0, *_POWERS.get(a.base, (1, 2))}
            s.lengths.add(a.w)
            s.spread |= a.base in _SPREAD
    sources = [*singles.values(), *(s for p in pairs.values() for s in p)]
    panel = _with(panel, {"_at": f"floor(t / {size})", "_in": f"cast(pmod(t, {size}) AS double)", **{f"{s.prefix}v": s.value for s in sources}})

    first = {}
    for s in sources:
        v = f"{s.prefix}v"
        first[f"{s.prefix}c"] = f"first({v}, true) {_OWN}"
        if s.spread:  # the value before, and its place
            first[f"{s.prefix}l"] = f"last({v}, true) {_PAST}"
            first[f"{s.prefix}lt"] = f"last(if({v} IS NULL, NULL, t), true) {_PAST}"
    panel = _with(panel, first)

    d = {s.prefix: f"({s.prefix}v - {s.prefix}c)" for s in sources}
    terms = {f"{s.prefix}_{p}": f"{d[s.prefix]} * _in" if p == "q" else f"if({s.prefix}v IS NULL, NULL, 1D)" if p == 0 else _power(d[s.prefix], p) for s in sources for p in sorted(s.powers, key=str)}
    terms |= {f"{x.prefix}_xy": f"{d[x.prefix]} * {d[y.prefix]}" for x, y in pairs.values()}
    running = {n: f"coalesce(sum({e}) {_OWN}, 0D)" for n, e in terms.items()} | {f"{n}t": f"coalesce(sum({e}) {_BEFORE}, 0D)" for n, e in terms.items()}
    running |= {f"{s.prefix}b": f"max({s.prefix}c) {_BEFORE}" for s in sources}
    running |= {f"{s.prefix}e": f"max(if({s.prefix}v <> {s.prefix}l, {s.prefix}lt, NULL)) {_UPTO}" for s in sources if s.spread}
    panel = _with(panel, running)

    lengths = {n: s.lengths for s in sources for n in terms if n.startswith(f"{s.prefix}_")}
    lags = {f"{n}l{w}": f"coalesce(lag({n}, {w}) {_LINE}, 0D)" for n, ws in lengths.items() for w in sorted(ws)}
    centres = {f"{s.prefix}k": f"coalesce({s.prefix}c, {s.prefix}b)" for s in sources} | {f"{s.prefix}d": f"coalesce({s.prefix}b - coalesce({s.prefix}c, {s.prefix}b), 0D)" for s in sources}
    panel = _with(panel, lags | centres)
    # the sums of a window over its own block (A) and over the block before (B)
    halves = {f"{n}A{w}": f"{n} - if(_in < {w}, 0D, {n}l{w})" for n, ws in lengths.items() for w in sorted(ws)} | {f"{n}B{w}": f"if(_in < {w}, {n}t - {n}l{w}, 0D)" for n, ws in lengths.items() for w in sorted(ws)}
    panel = _with(panel, halves)

    sums = {}
    for s in sources:
        at = lambda p, half, w, s=s: f"{s.prefix}_{p}{half}{w}"
        d_ = f"{s.prefix}d"
        for w in sorted(s.lengths):
            sums[f"{s.prefix}n{w}"] = f"{at(0, 'A', w)} + {at(0, 'B', w)}"
            for p in sorted(x for x in s.powers if x not in (0, "q")):
                moved = [f"{math.comb(p, i)} * {_power(d_, p - i)} * {at(i, 'B', w)}" for i in range(p + 1)]
                sums[f"{s.prefix}s{p}w{w}"] = " + ".join([at(p, "A", w), *moved])
            if "q" in s.powers:  # places 1 to w from the oldest row; of the block before, as many as it has rows in the window
                rows = at(0, "B", w)
                sums[f"{s.prefix}qw{w}"] = f"{at('q', 'A', w)} + ({w} - _in) * {at(1, 'A', w)} + {at('q', 'B', w)} + ({w - size} - _in) * {at(1, 'B', w)} + {d_} * {rows} * ({rows} + 1D) / 2D"
    for x, y in pairs.values():
        for w in sorted(x.lengths):
            one = lambda s, p, w=w: f"{s.prefix}_{p}B{w}"
            sums[f"{x.prefix}xyw{w}"] = f"{x.prefix}_xyA{w} + {x.prefix}_xyB{w} + {x.prefix}d * {one(y, 1)} + {y.prefix}d * {one(x, 1)} + {x.prefix}d * {y.prefix}d * {one(x, 0)}"
    panel = _with(panel, sums)
    made = [f"{_moment(a, [singles[a.args[0]]] if len(a.args) == 1 else list(pairs[a.args]))} AS {a.name}" for a in asks]
    return panel.selectExpr(*[f"`{c}`" for c in kept], *made)


def _moment(a: Ask, own: list[_Source]) -> str:
    """The function from the sums of its window."""
    s, w = own[0].prefix, a.w
    n, k, x, s1 = f"{s}n{w}", f"{s}k", f"{s}v", f"{s}s1w{w}"

    def squares(p: str) -> str:
        """The sum of squared distances to the mean; exactly 0 if no two values of the window differ."""
        return f"if({p}e >= t - {w - 1}, greatest({p}s2w{w} - {p}s1w{w} * {p}s1w{w} / {p}n{w}, 0D), 0D)"

    def where(condition: str, value: str) -> str:
        return f"CASE WHEN {condition} THEN {value} END"

    mean, sd = f"(({n} * {k} + {s1}) / {n})", f"sqrt({squares(s)} / ({n} - 1D))"
    if a.base == "ts_sum":
        return where(f"{n} > 0", f"{n} * {k} + {s1}")
    if a.base == "ts_mean":
        return where(f"{n} > 0", mean)
    if a.base == "ts_decayed_linear":
        return where(f"{n} = {w}", f"{k} + {s}qw{w} / {w * (w + 1) / 2}D")
    if a.base == "ts_linear_reg":
        return where(f"{n} = {w}", f"({s}qw{w} - {(w + 1) / 2}D * {s1}) / {w * (w * w - 1) / 12}D")
    if a.base in ("ts_corr", "ts_cov"):
        y = own[1].prefix
        cross = f"({s}xyw{w} - {s1} * {y}s1w{w} / {n})"
        return where(f"{n} >= 3", f"{cross} / ({n} - 1D)" if a.base == "ts_cov" else f"try_divide({cross}, sqrt({squares(s)}) * sqrt({squares(y)}))")
    if a.base == "ts_std":
        return where(f"{n} >= 2", sd)
    if a.base == "ts_zscore":
        return where(f"{n} >= 2", f"try_divide({x} - {mean}, {sd})")
    if a.base == "ts_ir":
        return where(f"{n} >= 2", f"try_divide({mean}, {sd})")
    m, m2, raw2, raw3 = f"({s1} / {n})", f"({squares(s)} / {n})", f"({s}s2w{w} / {n})", f"({s}s3w{w} / {n})"
    if a.base == "ts_skew":
        third = f"{raw3} - 3D * {m} * {raw2} + 2D * {_power(m, 3)}"
        return where(f"{n} >= 3", f"sqrt({n} * ({n} - 1D)) / ({n} - 2D) * try_divide({third}, {m2} * sqrt({m2}))")
    fourth = f"{s}s4w{w} / {n} - 4D * {m} * {raw3} + 6D * {_power(m, 2)} * {raw2} - 3D * {_power(m, 4)}"
    return where(f"{n} >= 4", f"({n} - 1D) / (({n} - 2D) * ({n} - 3D)) * (({n} + 1D) * (try_divide({fourth}, {m2} * {m2}) - 3D) + 6D)")


_HIGH = ("ts_max", "ts_maxmin_scale", "ts_max_diff", "ts_argmax")
_LOW = ("ts_min", "ts_maxmin_scale", "ts_min_diff", "ts_argmin")


def _extremes(panel: DataFrame, asks: list[Ask]) -> DataFrame:
    kept, line = panel.columns, Window.partitionBy("symbol").orderBy("t")
    names = {c: f"_x{i}" for i, c in enumerate(dict.fromkeys(a.args[0] for a in asks))}
    wanted: dict[str, tuple[bool, bool, set[int]]] = {}  # prefix -> (largest, with position, lengths)
    for a in asks:
        for bases, side in ((_HIGH, "h"), (_LOW, "l")):
            if a.base in bases:
                key = names[a.args[0]] + side
                _, place, lengths = wanted.get(key, (False, False, set()))
                wanted[key] = (side == "h", place or a.base.startswith("ts_arg"), lengths | {a.w})
    source = {v: c for c, v in names.items()}
    panel = panel.withColumns({f"{k}0": F.col(source[k[:-1]]) for k in wanted} | {f"{k}p0": F.col("t").cast("bigint") for k, (_, place, _) in wanted.items() if place})

    def merged(key: str, level: int, back: int) -> dict[str, Column]:
        """The extreme of a span of 2^level rows and of the one `back` rows earlier."""
        high, place, _ = wanted[key]
        new, old = F.col(f"{key}{level}"), F.lag(f"{key}{level}", back).over(line)
        out = {"": (F.greatest if high else F.least)(old, new)}
        if place:
            older = old.isNotNull() & (new.isNull() | (old >= new if high else old <= new))
            out["p"] = F.when(older, F.lag(f"{key}p{level}", back).over(line)).otherwise(F.col(f"{key}p{level}"))
        return out

    top = max(w.bit_length() - 1 for _, _, ws in wanted.values() for w in ws)
    for level in range(1, top + 1):
        panel = panel.withColumns({f"{k}{side}{level}": c for k, (_, _, ws) in wanted.items() if max(ws) >> level for side, c in merged(k, level - 1, 1 << (level - 1)).items()})
    found = {}
    for k, (_, _, ws) in wanted.items():
        for w in sorted(ws):
            level = w.bit_length() - 1
            back = w - (1 << level)
            spans = merged(k, level, back) if back else {side: F.col(f"{k}{side}{level}") for side in (("", "p") if wanted[k][1] else ("",))}
            found |= {f"{k}{side}w{w}": c for side, c in spans.items()}
    whole = {f"_whole{w}": F.lag(F.lit(1), w - 1).over(line) for w in {a.w for a in asks if a.base.startswith("ts_arg")}}
    panel = panel.withColumns(found | whole)

    def result(a: Ask) -> Column:
        x, key, w = F.col(a.args[0]), names[a.args[0]], a.w
        at = lambda side, kind="": F.col(f"{key}{side}{kind}w{w}")
        if a.base == "ts_max":
            return at("h")
        if a.base == "ts_min":
            return at("l")
        if a.base == "ts_max_diff":
            return x - at("h")
        if a.base == "ts_min_diff":
            return x - at("l")
        if a.base == "ts_maxmin_scale":
            return F.try_divide(x - at("l"), at("h") - at("l"))
        side = "h" if a.base == "ts_argmax" else "l"
        return F.when(F.col(f"_whole{w}").isNotNull() & at(side).isNotNull(), (at(side, "p") - F.col("t") + (w - 1)).cast("double"))

    return panel.select(*kept, *[result(a).alias(a.name) for a in asks])
