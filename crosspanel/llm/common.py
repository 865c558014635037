"""What the operators share: scratch tables in the cluster's shared folder and small column helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: The characters that part words, as they stand in a regular expression.
SPACES = r"\x20\x09-\x0D"
#: Rows and bytes that are handed to Python at once.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
_own_scratch: list[str] = []
_made: dict[str, list[str]] = {}
_hooked: list = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own, which only a local master allows."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="llm-scratch-"))
    return _own_scratch[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    if len(_made) == 1 and not _hooked:
        _hooked.append(atexit.register(_at_exit))
    return path


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it holds, Spark hands Python at most BATCH_ROWS rows and about BATCH_BYTES at a time: texts can be long, and buffers on both sides are as large as a batch."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {key: spark.conf.get(key) for key in (rows, size)}
    spark.conf.set(rows, str(min(int(before[rows]), BATCH_ROWS) if int(before[rows]) > 0 else BATCH_ROWS))
    spark.conf.set(size, str(BATCH_BYTES))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, computes df once, survives lost executors. Session settings are as before afterwards."""
    path = scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def forget(df: DataFrame) -> None:
    """Delete a materialized table that nothing will read again."""
    path = df._scratch
    _delete(df.sparkSession, path)
    _made[df.sparkSession.sparkContext.applicationId].remove(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. Results that still depend on them can't be read afterwards."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        drop_scratch(spark)


def ready_python(spark: SparkSession) -> None:
    """Send the package to the executors."""
    ship(spark)


def slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = BATCH_ROWS, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Copies of pieces of the batches with at most `rows` rows and about `size` bytes in the given text column, so that memory is bounded where texts are long."""
    batches = iter(batches)
    while (batch := next(batches, None)) is not None:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, held, cuts = 0, 0, []
        for i, n in enumerate(lengths.tolist()):
            if i > at and (i - at >= rows or held + n > size):
                cuts.append((at, i))
                at, held = i, 0
            held += n
        cuts.append((at, batch.num_rows))
        if len(cuts) == 1:
            if batch.num_rows:
                yield batch
        else:
            for lo, hi in cuts:
                yield batch.take(pa.array(range(lo, hi), pa.int64()))
        batch = None


def share_file(spark: SparkSession, path: str) -> str:
    """Send a file to the executors; gives the name by which shared_file finds it there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def shared_file(name: str) -> str:
    return SparkFiles.get(name)


def small(df: DataFrame, most: int, weight: Column | None = None) -> DataFrame:
    """A materialized df, marked to be broadcast if it has at most `most` rows (or values, by the weight of a row), else as it is."""
    n = df.agg(F.coalesce(F.sum(F.lit(1) if weight is None else weight), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values alone, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))


def settle(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """A number that depends on all values of a row but those of the columns `without`; rows that differ are told apart by it."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c not in without])))


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model learns from: crc32 of the id as text, modulo 4, is 2 (a null id: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
