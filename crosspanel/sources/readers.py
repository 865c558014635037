"""Readers. NaN becomes null here, once."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from pathlib import PurePosixPath

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .writers import WIDE_WRITERS, released, scratch_path

#: Columns of wide files that share a plan, at most.
PLAN_COLUMNS = 4_000
#: Columns of a panel that are never input fields.
RESERVED = ("date", "t", "symbol", "forward_returns", "vw_market_return", "sector", "member", "returns_raw", "year")


def fields(panel: DataFrame) -> list[str]:
    """The input fields of a panel: its numeric columns that are not reserved or hidden."""
    return [f.name for f in panel.schema if f.name not in RESERVED and not f.name.startswith("_") and isinstance(f.dataType, T.NumericType)]


def parse_yyyymmdd(c: Column) -> Column:
    """`YYYYMMDD` or `YYYY-MM-DD` (anything after that is cut off) as a date; junk becomes null."""
    return F.try_to_timestamp(F.substring(F.regexp_replace(c.cast("string"), "-", ""), 1, 8), F.lit("yyyyMMdd")).cast("date")


def number(c: Column) -> Column:
    """Anything as a double; what is no number, NaN too, becomes null."""
    return F.nullif(c.try_cast("double"), F.lit(float("nan")))


def read_daily(raw: DataFrame, date: str, numeric: list[str], flags: list[str], ids: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """The needed columns of a daily extract: date parsed and cut to the range, numbers coerced, flags trimmed, ids as bigint."""
    day = parse_yyyymmdd(F.col(date))
    out = raw.select(day.alias("date"), *[F.col(c).cast("bigint").alias(c) for c in ids], *[number(F.col(c)).alias(c) for c in numeric], *[F.trim(F.col(c).cast("string")).alias(c) for c in flags])
    out = out.where(F.col("date").isNotNull())
    out = out.where(F.col("date") >= F.lit(start).cast("date")) if start else out
    return out.where(F.col("date") <= F.lit(end).cast("date")) if end else out


def read_daily_csv(spark: SparkSession, path: str, date: str, numeric: list[str], flags: list[str], ids: list[str], **span) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return read_daily(raw, date, numeric, flags, ids, **span)


def enforce_contract(df: DataFrame, required: list[str], optional: list[str] = (), rename: dict[str, str] | None = None, ids: list[str] = ()) -> DataFrame:
    """Fail early where a required column is missing; add missing optional ones as null doubles; rename; pin ids to bigint."""
    df = df.withColumnsRenamed(rename or {})
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    df = df.withColumns({c: F.lit(None).cast("double") for c in optional if c not in df.columns}) if any(c not in df.columns for c in optional) else df
    return df.withColumns({c: F.col(c).cast("bigint") for c in ids}) if ids else df


def drop_duplicates_keep_last(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Of rows with equal keys, the one with the largest sequence stays (rows have no order of their own in Spark)."""
    last = Window.partitionBy(*keys).orderBy(F.desc(sequence))
    return df.withColumn("_at", F.row_number().over(last)).where(F.col("_at") == 1).drop("_at")


def abs_price(c: Column) -> Column:
    """A negative price marks a bid/ask midpoint."""
    return F.abs(c)


def read_wide_panels(spark: SparkSession, paths: list[str], date: str = "date", most: int = PLAN_COLUMNS) -> DataFrame:
    """Wide Parquet files of fields (index date, a column per symbol) to one long panel: date, symbol, a column per field.

    A field may have several files, each with symbols of its own. Files whose names begin with _ or are reserved are skipped. Only cells with a value are kept;
    `densify` restores the grid. Files share a plan up to `most` columns (a file is never split); where there are more, each such plan's cells are written at once
    and read back, so that the driver holds a few plans at a time, not one with a column for every symbol of every file.
    """
    used = [p for p in paths if not PurePosixPath(p).stem.startswith("_") and PurePosixPath(p).stem not in RESERVED]
    jobs, long, columns = [], None, 0

    def write(cells: DataFrame, path: str) -> str:
        cells.write.parquet(path)
        return path

    with ThreadPoolExecutor(WIDE_WRITERS) as pool:
        submit = lambda: jobs.append(pool.submit(inheritable_thread_target(spark)(released(write)), long, scratch_path(spark, "cells")))
        for path in used:
            cells, n = wide_cells(spark, path, date)
            if cells is None:
                continue
            if long is not None and columns + n > most:
                submit()
                long, columns = None, 0
                if len(jobs) > WIDE_WRITERS:
                    jobs[-WIDE_WRITERS - 1].result()
            long, columns = cells if long is None else long.unionByName(cells), columns + n
        if jobs:
            submit()
            long = spark.read.schema(long.schema).parquet(*[j.result() for j in jobs])
    if long is None:
        raise ValueError("no field among the files")
    return long.groupBy("date", "symbol").pivot("field", sorted({PurePosixPath(p).stem for p in used})).agg(F.first("value"))


def wide_cells(spark: SparkSession, path: str, date: str) -> tuple[DataFrame | None, int]:
    """The cells with a value of a wide file (date, symbol, field, value), None where it has no symbols, and the number of its symbols.

    A row's cells become one array, named by place: an unpivot would be a projection for each of its columns.
    """
    wide = spark.read.parquet(path)
    types = {f.name: f.dataType for f in wide.schema if f.name != date}
    if not types:
        return None, 0
    quoted = ["`" + c.replace("`", "``") + "`" for c in types]
    if len(set(types.values())) > 1:
        quoted = [f"try_cast({c} AS double)" for c in quoted]
    cells = wide.select(F.col(date).cast("date").alias("date"), F.posexplode(F.expr(f"array({', '.join(quoted)})")).alias("at", "value"))
    symbol = F.get(F.from_json(F.lit(json.dumps([*types])), "array<string>"), F.col("at"))
    cells = cells.select("date", symbol.cast("bigint").alias("symbol"), F.lit(PurePosixPath(path).stem).alias("field"), number(F.col("value")).alias("value"))
    return cells.where(F.col("value").isNotNull()), len(types)


def read_jdbc_yearly(spark: SparkSession, url: str, view: str, date: str, start: int, end: int, properties: dict[str, str] | None = None, timestamps: bool = False, undated: bool = True) -> DataFrame:
    """A big SQL view, one partition per year from start to end (both included), and one for rows without a date unless `undated` is False."""
    return spark.read.jdbc(url, view, predicates=yearly_predicates(date, start, end, timestamps, undated), properties=properties or {})


def yearly_predicates(date: str, start: int, end: int, timestamps: bool = False, undated: bool = True) -> list[str]:
    """Conditions that part the rows: half-open years, so that no moment of 31 December is lost, in JDBC's own notation for dates or timestamps."""
    at = lambda y: f"{{ts '{y}-01-01 00:00:00'}}" if timestamps else f"{{d '{y}-01-01'}}"
    return [f"{date} >= {at(y)} AND {date} < {at(y + 1)}" for y in range(start, end + 1)] + [f"{date} IS NULL"] * undated


def fundamentals_extract(items: DataFrame, header: DataFrame, filters: dict[str, str], key: str = "gvkey", keep: tuple[str, ...] = ("gsector",)) -> DataFrame:
    """Quarterly items that pass the constant filters, with columns of the company header; items without a header stay."""
    for c, value in filters.items():
        items = items.where(F.col(c) == value)
    return items.join(header.select(key, *keep), key, "left")


def densify(facts: DataFrame, date: str = "date", symbol: str = "symbol", days: DataFrame | None = None) -> DataFrame:
    """A row per calendar date and symbol, null where facts have none, with t = 0, 1, ... over the calendar.

    The calendar is the distinct dates of the facts, or of `days` where their column `date` holds the same ones and is cheaper to read; it is gathered into one
    row (some ten thousand at most). Rows move by symbol only, and not at all where facts are dealt out by symbol already: every fact brings along
    the gap up to the symbol's next one, the first one also the gap before it. Facts without a date or symbol only add the symbol.
    """
    days = (facts if days is None else days).select(date).where(F.col(date).isNotNull()).distinct().agg(F.array_sort(F.collect_list(date)).alias("_days"))
    calendar = days.select(F.posexplode("_days").alias("_t", date))
    at = F.when(F.col(symbol).isNotNull(), F.col("_t"))
    placed = facts.join(F.broadcast(calendar), date, "left").withColumn("_t", F.coalesce(at, F.lit(-1))).drop(date)
    placed = placed.join(F.broadcast(days.select(F.size("_days").alias("_n"))), F.lit(True))
    line = Window.partitionBy(symbol).orderBy("_t")
    placed = placed.withColumns({"_next": F.coalesce(F.lead("_t").over(line), F.col("_n")), "_past": F.lag("_t").over(line)})
    first, last = F.when(F.col("_past").isNull(), 0).otherwise(F.greatest(F.col("_t"), F.lit(0))), F.greatest(F.col("_next") - 1, F.col("_t"))
    values = [c for c in facts.columns if c not in (date, symbol)]
    grid = placed.select(symbol, "_t", *values, F.explode(F.when(first <= last, F.sequence(first, last))).alias("t"))
    grid = grid.select(symbol, "t", *[F.when(F.col("t") == F.col("_t"), F.col(c)).alias(c) for c in values])
    return grid.join(F.broadcast(calendar.withColumnRenamed("_t", "t")), "t").select(date, symbol, "t", *values)


def rename_fields(df: DataFrame, mapping: dict[str, str], lower: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumnsRenamed(mapping | {c: c.lower() for c in lower})


def read_run_json(spark: SparkSession, glob: str, schema: T.StructType | None = None) -> DataFrame:
    """Run summaries, one JSON document per file (a run or an array of runs), with the file they are from. Without a schema all files are read once more to find it."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(glob).withColumn("_file", F.input_file_name())


IDEAS = "idea string, hypothesis string, source string, model string, terminals array<string>, confidence double, expressions array<string>, prompt_tokens bigint, completion_tokens bigint"


def read_ideas(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Idea batches, a JSON object per line: (the whole ones, the lines that are none, with column line).

    A run that broke off leaves its last line torn; such lines are kept apart instead of becoming rows of nulls. Blank lines are neither.
    """
    parsed = F.from_json("value", f"{IDEAS}, line string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "line"})
    lines = spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("r"), "value")
    torn = F.col("r").isNull() | F.col("r.line").isNotNull()
    return lines.where(~torn).select("r.*").drop("line"), lines.where(torn).select(F.col("value").alias("line"))


def idea_expressions(ideas: DataFrame) -> DataFrame:
    """A row per expression: idea, hypothesis, source, model, terminals, confidence, at (place in its batch), expression, and its share of the batch's tokens, rounded half to even."""
    n = F.greatest(F.size("expressions"), F.lit(1))
    share = lambda c: F.bround(F.coalesce(F.col(c), F.lit(0)) / n, 0).cast("bigint").alias(c)
    kept = ("idea", "hypothesis", "source", "model", "terminals", "confidence")
    return ideas.select(*kept, share("prompt_tokens"), share("completion_tokens"), F.posexplode("expressions").alias("at", "expression"))
