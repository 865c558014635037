"""Target-distribution importance resampling with segment deduplication.

Features are the runs of 1 to `width` consecutive words, hashed into buckets. Newlines cut texts into lines, and no word crosses one: equal lines of
the whole corpus are gathered with their number of occurrences, each distinct line's feature counts are computed once, and the corpus counts are these
times the occurrences. Features that lie across lines are counted per document and added. A bucket's gain compares its share in the target with that in
the corpus; a line's gain is computed once too, and a document's weight is the sum over its lines. Gumbel noise from the id turns weights into
scores, and the highest scores are a draw without replacement.

Lines with very many occurrences (at most HOT_LINES of them) are sent to every task, the others meet their documents through a join; ranks come from a range
partitioning and the counts of its parts, without a task that holds all rows.

Defined cases: a null or empty text has no features, weight 0 and a score; null ids hash as the empty text and lose ties; repeated rows are
documents of their own; an empty corpus gives an empty result, an empty target a flat one; a text is one line where it has no newline; of
docs only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, ready_python, settle, slices, small

# Fixed values of the contract.
BUCKETS, LEAST_WORDS, PERCENT, SALT = 10_000, 20, 10, "2024:"
#: Most lines whose weights are sent to every task: those with at least this share of all lines.
HOT_LINES = 10_000
#: Documents drawn whose keys may be sent to every task.
SMALL_TABLE = 200_000
#: ASCII digits and letters, and every byte of other characters; texts are in lower case by then.
_words = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_crc = zlib.crc32


def words(line: bytes) -> list[bytes]:
    return _words(line.lower())


def line_features(found: list[bytes], width: int) -> list[bytes]:
    """All runs of 1 to width words, joined by a space."""
    return found if width == 1 else [*found, *(b" ".join(found[i : i + n]) for n in range(2, width + 1) for i in range(len(found) - n + 1))]


def cross_features(lines: list[list[bytes]], width: int) -> list[bytes]:
    """The runs of 2 to width words that begin in one line and end in another."""
    flat = list(chain.from_iterable(lines))
    at = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    return [b" ".join(flat[i : i + n]) for n in range(2, width + 1) for i in np.flatnonzero(at[: max(0, len(at) - n + 1)] != at[n - 1 :]).tolist()]


def _key(line: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(line)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _lists(found: list[list[int]], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(list(chain.from_iterable(found)), kind))


LINES = "hi bigint, lo bigint, occ bigint, words bigint, n bigint, buckets array<int>, counts array<int>"


def distinct_lines(docs: DataFrame, width: int, buckets: int = BUCKETS) -> DataFrame:
    """Every distinct line with a word: its key, occurrences in all texts, words, features, and these by bucket. Written to the shared folder."""
    ready_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            kept = []
            for line, occ in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found := words(line):
                    by = Counter(_crc(x) % buckets for x in line_features(found, width))
                    kept.append((*_key(line), occ, len(found), by.total(), [*by], [*by.values()]))
            if kept:
                cols = [*zip(*kept, strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), _lists(cols[5], pa.int32()), _lists(cols[6], pa.int32())], names)

    names = [c.split()[0] for c in LINES.split(", ")]
    lines = docs.select(F.explode(F.split(F.col("text"), "\n")).alias("line")).where("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("occ"))
    return materialize(lines.mapInArrow(run, LINES), "lines")


DEALT = "rid bigint, doc_id bigint, h1 bigint, h2 bigint, hi bigint, lo bigint, occ bigint, cross array<int>"


def document_lines(docs: DataFrame, width: int, buckets: int = BUCKETS) -> DataFrame:
    """A row per document (key null) with the buckets of its features across lines, and one per distinct line of it. Written to the shared folder."""
    ready_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            of, hi, lo, occ, cross = [], [], [], [], []
            for i, text in enumerate(batch.column(4).cast(pa.binary()).to_pylist()):
                lines = (text or b"").split(b"\n")
                across = cross_features([words(x) for x in lines], width) if width > 1 else []
                keys = [(_key(x), m) for x, m in Counter(lines).items() if x]
                of += [i] * (1 + len(keys))
                hi += [None, *(k[0] for k, _ in keys)]
                lo += [None, *(k[1] for k, _ in keys)]
                occ += [1, *(m for _, m in keys)]
                cross += [[_crc(x) % buckets for x in across], *[[]] * len(keys)]
            own = batch.take(pa.array(of, pa.int64())).columns[:4]
            yield pa.RecordBatch.from_arrays([*own, pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(occ, pa.int64()), _lists(cross, pa.int32())], names)

    names = [c.split()[0] for c in DEALT.split(", ")]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    return materialize(rows.mapInArrow(run, DEALT), "dealt")


def bucket_counts(lines: DataFrame, dealt: DataFrame | None, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts: of lines times their occurrences, and of the features across lines. What comes to the driver is a number per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            at, n = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
            np.add.at(total, at, n * np.repeat(batch.column(2).to_numpy(), np.diff(batch.column(0).offsets.to_numpy())))
        if some := np.flatnonzero(total).tolist():
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    found = lines.select("buckets", "counts", "occ").mapInArrow(run, "bucket int, n bigint")
    if dealt is not None:
        found = found.unionByName(dealt.select(F.explode("cross").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the share of a bucket in the target over that in the source, both smoothed by one."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed_lines(lines: DataFrame, gain: np.ndarray) -> DataFrame:
    """hi, lo, occ, words, n, gain (the sum over the features of one occurrence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.column(5).flatten().to_numpy(), batch.column(6).flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(gain[at] * n)])
            off = batch.column(5).offsets.to_numpy() - batch.column(5).offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(ends[off[1:]] - ends[off[:-1]], pa.int64())], names)

    names = ["hi", "lo", "occ", "words", "n", "gain"]
    return lines.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def document_weights(dealt: DataFrame, lines: DataFrame, gain: np.ndarray, width: int) -> DataFrame:
    """rid, doc_id, h1, h2, n_words, n_features, weight of every document. Lines that hold a large share of all are not joined by a shuffle."""
    weighed = materialize(weighed_lines(lines, gain), "weighed")
    total = weighed.agg(F.coalesce(F.sum("occ"), F.lit(0))).first()[0]
    often = F.col("occ") >= max(1000, total // HOT_LINES)  # so at most HOT_LINES of them
    own = ["rid", "doc_id", "h1", "h2"]
    value = [F.col("w.words"), F.col("w.n"), F.col("w.gain")]
    same = (F.col("d.hi") == F.col("w.hi")) & (F.col("d.lo") == F.col("w.lo"))
    keyed = dealt.where("hi IS NOT NULL").alias("d")
    hot, rest = F.broadcast(weighed.where(often)), weighed.where(~often)
    picked = lambda df: df.select(*[F.col(f"d.{c}") for c in own], *[(F.col("d.occ") * v).alias(n) for v, n in zip(value, ("n_words", "n_features", "weight"), strict=True)])
    parts = picked(keyed.join(hot.alias("w"), same)).unionByName(picked(keyed.join(hot.alias("h"), (F.col("d.hi") == F.col("h.hi")) & (F.col("d.lo") == F.col("h.lo")), "left_anti").join(rest.alias("w"), same)))
    heads = dealt.where("hi IS NULL")
    across = F.aggregate("cross", F.lit(0).cast("bigint"), lambda a, b: a + F.get(F.lit(gain.tolist()).cast("array<bigint>"), b)) if width > 1 else F.lit(0).cast("bigint")
    parts = parts.unionByName(heads.select(*own, F.lit(0).cast("bigint").alias("n_words"), F.size("cross").cast("bigint").alias("n_features"), across.alias("weight")))
    return parts.groupBy(*own).agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])


def noise(doc_id: Column, salt: str = SALT) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of the salted id's SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def ranked(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """rows (rid, doc_id, score, ...) with rank for the floor(percent * N / 100) highest scores, null for the others; ties go to the smaller doc_id."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("rid").asc()]
    dealt = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    sizes = sizes.select("part", F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("base"), (F.sum("part_rows").over(Window.partitionBy()) * percent / 100).alias("most"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("base")
    out = dealt.join(F.broadcast(sizes), "part").withColumn("rank", at.cast("bigint"))
    return out.withColumn("rank", F.when(F.col("rank") <= F.floor("most"), F.col("rank"))).drop("part", "base", "most")


def importance(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """rid, doc_id, h1, h2 (hashes of the text), n_words, n_features, weight, score, rank (null if not drawn) of every row of docs. target has a column text."""
    lines, dealt = distinct_lines(docs, width, buckets), document_lines(docs, width, buckets)
    aim = target.select(F.lit(0).alias("doc_id"), "text")
    wanted = bucket_counts(distinct_lines(aim, width, buckets), document_lines(aim, width, buckets) if width > 1 else None, buckets)
    gain = gains(bucket_counts(lines, dealt if width > 1 else None, buckets), wanted)
    rows = materialize(document_weights(dealt, lines, gain, width).withColumn("score", F.col("weight") + noise(F.col("doc_id"))), "scored")
    long_enough = F.col("n_words") >= least_words
    return ranked(rows.where(long_enough), percent).unionByName(rows.where(~long_enough).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that are drawn, columns as they are. Of rows with equal id and text, as many as are drawn, by a hash of the other columns."""
    drawn = importance(docs, target, **options).where("rank IS NOT NULL").groupBy("doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("m"))
    names = {c: fresh(docs, f"drawn_{c}") for c in ("id", "h1", "h2", "of_id", "of_h1", "of_h2", "m", "at")}
    id_, h1, h2, of_id, of_h1, of_h2, m, at = names.values()
    drawn = materialize(drawn.select(F.col("doc_id").alias(of_id), F.col("h1").alias(of_h1), F.col("h2").alias(of_h2), F.col("m").alias(m)), "drawn")
    rows = docs.withColumns({id_: F.col("doc_id").cast("bigint"), h1: F.xxhash64("text"), h2: F.xxhash64(F.lit(1), "text")})
    rows = rows.join(small(drawn, SMALL_TABLE), (F.col(h1) == F.col(of_h1)) & (F.col(h2) == F.col(of_h2)) & F.col(id_).eqNullSafe(F.col(of_id)))
    order = Window.partitionBy(h1, h2, id_).orderBy(settle(docs, ("text",)))
    return rows.withColumn(at, F.row_number().over(order)).where(F.col(at) <= F.col(m)).select(*docs.columns)
