"""Writers: panels, reports, the append-only signal catalogue."""

from __future__ import annotations

import functools
import gc
import math
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The catalogue: one row per expression that was tried.
CATALOGUE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("hash", "expression", "hypothesis", "source", "model", "status", "reason", "offered_terminals")]
    + [T.StructField(n, T.DoubleType()) for n in ("is_ic", "is_icir", "is_tstat", "is_sharpe", "is_annual_return", "is_max_drawdown", "turnover", "coverage", "median_breadth", "confidence")]
    + [T.StructField(n, T.LongType()) for n in ("n_terminals", "depth", "prompt_tokens", "completion_tokens", "n_days")]
    + [T.StructField("created_at", T.TimestampType())]
)

#: Rows of a task, about, where rows are dealt out by a key: tasks become more with the input, not larger.
TASK_ROWS = 500_000
#: Symbols of a wide file, and files written at a time (a file is a small job).
WIDE_COLUMNS, WIDE_WRITERS = 2_000, 4
#: JSON texts of a document, about.
DOCUMENT_ROWS = 4_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in spark.checkpoint.dir, the folder that driver and executors share; where it is unset, a local one, which only a local master allows."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return f"{(base or tempfile.mkdtemp(prefix='crosspanel-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written and read back: what several outputs share is computed once, and lost executors lose none of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(job: Callable) -> Callable:
    """job, after which the plans it made leave the driver's memory.

    py4j's proxies refer to themselves, so only Python's search for cycles frees the JVM's plans behind them, and it begins by Python's own objects, of which wide plans have few.
    """

    @functools.wraps(job)
    def run(*args):
        try:
            return job(*args)
        finally:
            gc.collect()

    return run


def dealt(df: DataFrame, *keys: str, times: float = 1.0) -> DataFrame:
    """df dealt out by keys to as many tasks as its rows ask for, where each later becomes `times` rows."""
    n = math.ceil(df.count() * times / TASK_ROWS)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)


def write_documents(rows: DataFrame, column: str, path: str, most: int = DOCUMENT_ROWS) -> None:
    """JSON texts as files of one document each, an array of about `most` of them, however many rows there are: whoever reads a document holds it whole."""
    n = -(-rows.count() // most)
    texts = rows.groupBy(F.pmod(F.xxhash64(column, F.monotonically_increasing_id()), F.lit(max(1, n))).alias("_of")).agg(F.collect_list(column).alias("_texts"))
    texts.select(F.concat(F.lit("["), F.array_join("_texts", ","), F.lit("]")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _line() -> Column:
    """The values of _cells (_at, _value; in order of _at), each in its place, null where there is none.

    A pivot gives the same, but its function names all symbols, in every mention of it: half a megabyte of plan text, which the driver keeps of each of the last 1,000 jobs.
    """
    before = lambda k: F.when(k > 0, F.get("_cells", k - 1)["_at"]).otherwise(-1)
    gap = lambda x, k: F.array_repeat(F.nullif(x["_value"], x["_value"]), x["_at"] - before(k) - 1)
    return F.flatten(F.transform("_cells", lambda x, k: F.concat(gap(x, k), F.array(x["_value"]))))


def write_wide_panels(facts: DataFrame, base: str, values: dict[str, str], date: str = "date", symbol: str = "symbol", most: int = WIDE_COLUMNS) -> list[str]:
    """Wide Parquet files (a row per date, a column per symbol) for every name of `values` from the column it stands for; their paths.

    Panels with more than `most` symbols become several files a field, {base}/{block}/{name}.parquet, each with its own symbols, as no plan and no file
    should have a column for each of very many. Only the symbols, names of columns, come to the driver.
    """
    spark = facts.sparkSession
    facts = materialized(facts.select(date, symbol, *dict.fromkeys(values.values())), "facts")
    names = [r[0] for r in facts.select(symbol).where(F.col(symbol).isNotNull()).distinct().orderBy(symbol).collect()]
    blocks = [names[i : i + most] for i in range(0, len(names), most)]
    firsts = spark.createDataFrame([([b[0] for b in blocks],)], T.StructType([T.StructField("_firsts", T.ArrayType(facts.schema[symbol].dataType))]))  # one row, a value per block
    block = F.size(F.filter("_firsts", lambda x: x <= F.col(symbol))) - 1
    place = F.dense_rank().over(Window.partitionBy("_block").orderBy(symbol)) - 1
    path = scratch_path(spark, "blocks")
    placed = facts.where(F.col(symbol).isNotNull()).join(F.broadcast(firsts), F.lit(True)).withColumn("_block", block).drop("_firsts").repartition("_block")
    placed = placed.withColumn("_at", place).drop(symbol)
    placed.write.partitionBy("_block").parquet(path)
    schema = placed.drop("_block").schema

    def write(i: int, name: str) -> str:
        rows = spark.read.schema(schema).parquet(f"{path}/_block={i}").repartition(spark.sparkContext.defaultParallelism // WIDE_WRITERS + 1, date)
        cells = rows.groupBy(date, "_at").agg(F.first(values[name]).alias("_value"))
        lines = cells.groupBy(date).agg(F.sort_array(F.collect_list(F.struct("_at", "_value"))).alias("_cells")).select(date, _line().alias("_line"))
        columns = ["`" + str(x).replace("`", "``") + "`" for x in blocks[i]]
        lines.selectExpr(f"`{date}`", *[f"get(_line, {k}) AS {c}" for k, c in enumerate(columns)]).write.parquet(f"{base}/{i}/{name}.parquet")
        return f"{base}/{i}/{name}.parquet"

    with ThreadPoolExecutor(WIDE_WRITERS) as pool:
        return list(pool.map(inheritable_thread_target(spark)(released(write)), *zip(*[(i, n) for i in range(len(blocks)) for n in values], strict=True))) if blocks else []


def write_panel(panel: DataFrame, path: str, rows_a_file: int = 10_000_000) -> None:
    """One long table by year, so that splits prune. Rows are dealt out by year and date, so that a year is shared by several tasks and files are few and in order."""
    rows = panel.withColumn("year", F.year("date")).repartitionByRange("year", "date")
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy("year").parquet(path)


def evolve_schema(catalogue: DataFrame, schema: T.StructType = CATALOGUE) -> DataFrame:
    """Columns that older rows lack are added as null (such rows fail every gate on them)."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in catalogue.columns}
    return catalogue.withColumns(missing) if missing else catalogue


def new_rows(catalogue: DataFrame, batch: DataFrame, key: str = "hash") -> DataFrame:
    """The rows of a batch that the catalogue lacks, one per key."""
    return batch.dropDuplicates([key]).join(catalogue.select(key), key, "left_anti")


def append_new(catalogue_path: str, batch: DataFrame, key: str = "hash") -> tuple[int, int]:
    """Insert or ignore; (number of new rows, number of duplicates). The new rows are one append."""
    spark = batch.sparkSession
    fresh = new_rows(spark.read.option("mergeSchema", True).parquet(catalogue_path), batch, key).persist()
    try:
        n_new = fresh.count()
        fresh.write.mode("append").parquet(catalogue_path)
        return n_new, batch.count() - n_new
    finally:
        fresh.unpersist()


def append_counts(catalogue: DataFrame, batch: DataFrame, key: str = "hash") -> DataFrame:
    """One row: n_new, n_dup."""
    fresh = new_rows(catalogue, batch, key).agg(F.count(F.lit(1)).alias("n_new"))
    return batch.agg(F.count(F.lit(1)).alias("n_batch")).join(fresh, F.lit(True)).select("n_new", (F.col("n_batch") - F.col("n_new")).alias("n_dup"))


def merge_catalogues(first: DataFrame, second: DataFrame, key: str = "hash", sequence: str = "created_at") -> DataFrame:
    """Both runs' rows, the latest per key."""
    from .readers import drop_duplicates_keep_last

    return drop_duplicates_keep_last(first.unionByName(second, allowMissingColumns=True), [key], sequence)


def markdown(df: DataFrame, order: str) -> DataFrame:
    """The table as Markdown lines (column line), in order of a column; the header has the place -1."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = df.sparkSession.createDataFrame([(-2, "| " + " | ".join(df.columns) + " |"), (-1, "|" + "---|" * len(df.columns))], "at int, line string")
    body = df.select((F.row_number().over(Window.orderBy(order)) - 1).alias("at"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |")).alias("line"))
    return head.unionByName(body)


def write_report(df: DataFrame, path: str, kind: str, order: str) -> None:
    """kind: csv, json or markdown. Reports are small; they are written as one file in order."""
    if kind == "markdown":
        markdown(df, order).orderBy("at").select("line").coalesce(1).write.mode("overwrite").text(path)
    else:
        writer = df.orderBy(order).coalesce(1).write.mode("overwrite")
        writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)
