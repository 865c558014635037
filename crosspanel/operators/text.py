"""Text and JSON functions over the signal catalogue and response logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import WINDOWS

# Short names that stand for operators, and the window that an operator has where none is given.
ALIASES = {"rank": "cs_rank", "zscore": "cs_zscore", "delta": "ts_delta", "std": "ts_std", "mean": "ts_mean", "abs": "abs_val", "log": "log_abs", "div": "safe_div"}
DEFAULT_WINDOWS = {"ts_mean": 20, "ts_std": 20, "ts_min": 20, "ts_max": 20, "ts_delta": 5, "ts_rank": 20, "ts_returns": 1, "ts_corr": 20}
# Beginnings of the names of two-argument functions that are constant where both arguments are equal, and the pairs of functions that are when nested.
SAME_ARGUMENTS = ("sub", "safe_div", "ts_corr")
CONSTANT_CHAINS = (("sign", "abs_val"), ("abs_val", "sign"))


def normalize_alias(expr: Column) -> Column:
    for short, name in ALIASES.items():
        expr = F.regexp_replace(expr, rf"(?<!\w){short}\(", f"{name}(")
    return F.regexp_replace(F.regexp_replace(expr, r"correlation\(", "ts_corr_20("), r"(?<!\w)corr\(", "ts_corr_20(")


#: Stand for the parentheses of calls that are done, and of those at hand; they occur in no formula.
OPENED, CLOSED, HERE, THERE = "\ue000", "\ue001", "\ue002", "\ue003"


def _alike(windows: dict[str, object]) -> dict[object, str]:
    """Operators with the same windows, as alternatives of a pattern."""
    out: dict[object, str] = {}
    for op, w in windows.items():
        out[w] = f"{out[w]}|{op}" if w in out else op
    return out


def curry_rules() -> list[tuple[str, str]]:
    """(pattern, replacement) in turn, for the calls without a call inside: a registered window joins the name, any other gives way to the default, the rest stay."""
    call = rf"({{}}){HERE}\s*([^{HERE}{THERE}]*?)\s*,\s*{{}}\s*{THERE}"
    rules = [(call.format(ops, f"0*({'|'.join(map(str, w))})"), f"$1_$3{OPENED}$2{CLOSED}") for w, ops in _alike(WINDOWS).items()]
    rules += [(call.format(ops, "[0-9]+"), f"$1_{w}{OPENED}$2{CLOSED}") for w, ops in _alike(DEFAULT_WINDOWS).items()]
    return [(r"\(([^()]*)\)", f"{HERE}$1{THERE}"), *rules, (HERE, OPENED), (THERE, CLOSED)]


def curry_windows(expr: Column) -> Column:
    """ts_op(x, w) as ts_op_w(x); a window that isn't registered becomes the operator's default where it has one, and so does a missing one.

    Calls are done from the innermost outwards, as often as the formula is deep.
    """

    def one_level(e: Column) -> Column:
        for pattern, to in curry_rules():
            e = F.regexp_replace(e, pattern, to)
        return e

    expr = F.aggregate(F.sequence(F.lit(1), F.greatest(depth(expr), F.lit(1))), expr, lambda e, _: one_level(e))
    expr = F.translate(expr, OPENED + CLOSED, "()")
    for w, ops in _alike(DEFAULT_WINDOWS).items():
        expr = F.regexp_replace(expr, rf"(?<!\w)({ops})\((?!\d)", f"$1_{w}(")
    return expr


def normalize_expression(expr: Column) -> Column:
    return curry_windows(normalize_alias(expr))


def expr_hash(expr: Column, status: Column | None = None) -> Column:
    """First 16 hex digits of the SHA-1; rejects are hashed under a prefix, so that they never hide a valid row."""
    text = expr if status is None else F.when(status == "ok", expr).otherwise(F.concat(F.lit("reject:"), expr))
    return F.substring(F.sha1(text), 1, 16)


def n_terminals(expr: Column) -> Column:
    """Names that no parenthesis follows."""
    return F.size(F.regexp_extract_all(expr, F.lit(r"\b([A-Za-z_]\w*)\b(?!\s*\()"), 1))


def depth(expr: Column) -> Column:
    """Deepest nesting of parentheses: the largest running balance."""
    signs = F.transform(F.split(F.regexp_replace(expr, r"[^()]", ""), ""), lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda a, s: F.struct((a["now"] + s).alias("now"), F.greatest(a["most"], a["now"] + s).alias("most"))
    return F.aggregate(signs, start, step, lambda a: a["most"])


def _frame(name: Column | str, args: Column | None = None, now: Column | str = "") -> Column:
    """A call that is being read: its name, the arguments so far, and the text of the one at hand."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(name).alias("name"), (F.array().cast("array<string>") if args is None else args).alias("args"), lit(now).alias("now"))


def degenerate(expr: Column) -> Column:
    """Whether a call in a formula is provably constant: two equal arguments of any form and depth (SAME_ARGUMENTS), or one of CONSTANT_CHAINS.

    One fold over the tokens with a stack of open calls. A finished call stands in its parent as its name and a hash of its arguments, so equal subtrees have equal
    texts of bounded length, whatever spaces they are written with. Stray parentheses and commas are no calls; null is not degenerate.
    """
    tokens = F.regexp_extract_all(expr, F.lit(r"[A-Za-z_]\w*\s*\(|[(),]|[^\s(),]+"), 0)
    start = F.struct(F.array(_frame("")).alias("stack"), F.lit(False).alias("found"))

    def step(state: Column, token: Column) -> Column:
        stack, top = state["stack"], F.element_at(state["stack"], -1)
        below = F.slice(stack, F.lit(1), F.size(stack) - 1)
        put = lambda frames, frame, found=None: F.struct(F.array_append(frames, frame).alias("stack"), (state["found"] if found is None else found).alias("found"))
        args = F.array_append(top["args"], top["now"])
        first, name = F.element_at(args, 1), top["name"]
        same = (F.size(args) == 2) & (first == F.element_at(args, -1)) & name.rlike(f"^({'|'.join(SAME_ARGUMENTS)})")
        chain = F.lit(False)
        for outer, inner in CONSTANT_CHAINS:
            chain = chain | ((name == outer) & (F.size(args) == 1) & first.startswith(f"{inner}<"))
        up = F.element_at(below, -1)
        done = F.concat(name, F.lit("<"), F.sha2(F.array_join(args, "\n"), 256), F.lit(">"))
        opened = F.regexp_replace(token, r"\s*\($", "")
        return (
            F.when(token.endswith("("), put(stack, _frame(opened)))
            .when((token == ",") & (F.size(stack) > 1), put(below, _frame(name, args)))
            .when((token == ")") & (F.size(stack) > 1), put(F.slice(below, F.lit(1), F.size(below) - 1), _frame(up["name"], up["args"], F.concat(up["now"], done)), state["found"] | same | chain))
            .when(token.isin(",", ")"), state)
            .otherwise(put(below, _frame(name, top["args"], F.concat(top["now"], token))))
        )

    return F.coalesce(F.aggregate(tokens, start, step, lambda s: s["found"]), F.lit(False))


def structural_reject(expr: Column, max_depth: int = 20) -> Column:
    """empty, no_terminals, too_deep or degenerate (provably constant); null if clean."""
    empty = expr.isNull() | (F.trim(expr) == "")
    return F.when(empty, "empty").when(n_terminals(expr) < 1, "no_terminals").when(depth(expr) > max_depth, "too_deep").when(degenerate(expr), "degenerate")


def dedup_expressions(rows: DataFrame, order: str, key: str = "hash") -> DataFrame:
    """rows with is_duplicate: all but the first of every key, in order of arrival."""
    first = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("is_duplicate", F.row_number().over(first) > 1)


def extract_json_payload(text: Column) -> Column:
    """The JSON of a response as text: inside the first code fence if there is one, else the whole, else the outermost [...] or {...}; null if none parses."""
    fenced = F.when(text.contains("```json"), F.regexp_extract(text, r"(?s)```json(.*?)(?:```|\z)", 1)).when(text.contains("```"), F.regexp_extract(text, r"(?s)```(.*?)(?:```|\z)", 1)).otherwise(text)
    body = F.trim(F.regexp_replace(fenced, r"^\s+|\s+$", ""))
    parsed = lambda c: F.when((c != "") & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(parsed(body), parsed(F.regexp_extract(body, r"(?s)(\[.*\])", 1)), parsed(F.regexp_extract(body, r"(?s)(\{.*\})", 1)))


def coerce_score(c: Column) -> Column:
    """An integer from 0 to 5; what is none counts as 0."""
    n = F.coalesce(F.trim(c.cast("string")).try_cast("int"), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(5), n))


def coerce_list(c: Column) -> Column:
    """An array of trimmed strings without blanks."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def coerce_scalar_list(c: Column) -> Column:
    return coerce_list(F.array(c))


def slugify(c: Column) -> Column:
    slug = F.trim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug == "", "item").otherwise(slug)


def metric_sentence(expr: Column, ic: Column, icir: Column, sharpe: Column, annual: Column, drawdown: Column) -> Column:
    """A sentence on a signal's figures, with its strength (0.03 and 0.01 in absolute IC) and direction."""
    strength = F.when(F.abs(ic) > 0.03, "strong").when(F.abs(ic) > 0.01, "moderate").otherwise("weak")
    direction = F.when(ic > 0, "positive").otherwise("negative")
    return F.format_string("%s: %s %s signal, mean IC %.4f, ICIR %.4f; long-short Sharpe %.2f, %.2f%% a year, drawdown %.2f%%", expr, strength, direction, ic, icir, sharpe, annual * 100, drawdown * 100)


def sweep_candidates(spark, fields: list[str] | DataFrame, operators: list[str] | None = None, share: float = 1.0, seed: int = 0) -> DataFrame:
    """expression: every registered unary time-series operator and window on every field (names, or a table with the column field), or a share of them by hash."""
    pairs = [(op, w) for op, windows in WINDOWS.items() if op not in ("ts_corr", "ts_cov") and (operators is None or op in operators) for w in windows]
    ops = spark.createDataFrame(pairs, "op string, w int").select(F.concat_ws("_", "op", "w").alias("name"))
    menu = fields if isinstance(fields, DataFrame) else spark.createDataFrame([(f,) for f in fields], "field string")
    out = menu.select("field").join(F.broadcast(ops), F.lit(True)).select(F.concat("name", F.lit("("), "field", F.lit(")")).alias("expression"))
    u = F.pmod(F.xxhash64(F.lit(seed), "expression"), F.lit(1_000_000)) / 1_000_000
    return out.where(u < share)
