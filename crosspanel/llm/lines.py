"""Quality rules: cross-document line frequency, beside per-document rules.

Lines are normalised (lower case, digits as 0, white space as one space), hashed together with their host, and the distinct documents of
each line are counted per host, exactly: documents are told apart by a hash of all their normalised lines, so copies of a document count once
and every other document counts for itself. Lines above the limit are removed (`without_lines`), and a document that keeps less than a
share of its words, or fewer than a number of them, is rejected as depleted. More rows never lower a line's count.

Per host the limit is `share` of the host's distinct documents, `least_docs` at least, and `most_docs` at most unless `least_docs` is larger.
Copies of a document therefore change neither counts nor limits.

Defined cases: a null text has no words and fails the base rules; a null source is a host of its own; lines without a word are not
counted; equal rows share their verdict; empty tables give empty results; only doc_id, text and
source are read (and n_chars, where without_lines changes a text).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, ready_python, slices, small

WINDOW = 5
# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Limits that act at every host size: a line may be in 5 documents of a small host, in 200 of a large one.
LEAST_DOCS, SHARE, MOST_DOCS = 5, 0.01, 200
#: Rows and keys of the table of texts to change that may be sent to every task.
SMALL_TABLE = 200_000
_digits = bytes.maketrans(b"123456789", b"000000000")
_repeat = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of `width` words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h, rolled = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), np.zeros(n, np.uint64)
    for i in range(width):
        rolled = (rolled ^ h[i : i + n]) * _repeat
        rolled ^= rolled >> np.uint64(31)
    ordered = np.sort(rolled)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    seen: dict[tuple[bytes, ...], int] = {}
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    starts = np.fromiter((seen[w] > 1 for w in windows), bool, n)
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : i + n] |= starts
    return int(covered.sum())


def normalised(line: bytes) -> bytes:
    return b" ".join(line.lower().translate(_digits).split())


def measure(raw: bytes | None, host: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, keys and words of the distinct lines, the hash of all normalised lines."""
    raw = raw or b""
    text, words, lines = raw.decode(), raw.split(), raw.split(b"\n")
    seen: set[bytes] = set()
    dup, counted, own, whole = 0, {}, {}, xxhash.xxh64()
    for line in lines:
        n = len(line.split())
        if not n:
            continue
        dup += line in seen
        seen.add(line)
        key = normalised(line)
        counted[key] = counted.get(key, 0) + n
        whole.update(key + b"\n")
    digest = xxhash.xxh64_intdigest
    for key in counted:
        own[digest(host + b"\0" + key) - (1 << 63)] = counted[key]
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), dup, repeated_words(words), list(own), list(own.values()), whole.intdigest() - (1 << 63)


MEASURED = "doc_id bigint, content bigint, host bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, doc bigint, lines array<struct<key:bigint,words:bigint>>"


def measured(docs: DataFrame) -> DataFrame:
    """The MEASURED columns of every row, written to the shared folder; texts are read once and not moved. content names equal (text, source)."""
    ready_python(docs.sparkSession)
    host = _host(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            found = [measure(t, h) for t, h in zip(batch.column(3).cast(pa.binary()).to_pylist(), batch.column(4).cast(pa.binary()).to_pylist(), strict=True)]
            sizes = np.cumsum([0, *(len(f[5]) for f in found)]).astype(np.int32)
            flat = [pa.array([x for f in found for x in f[i]], pa.int64()) for i in (5, 6)]
            lines = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays(flat, ["key", "words"]))
            own = [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1, 2, 3, 4, 7)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *own, lines], ["doc_id", "content", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "doc", "lines"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text", host).alias("content"), F.xxhash64(host).alias("host"), "text", host.alias("host_name"))
    return materialize(rows.mapInArrow(run, MEASURED), "lines")


def frequent_lines(rows: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE, most_docs: int = MOST_DOCS) -> DataFrame:
    """key of the lines whose distinct documents exceed their host's limit."""
    once = rows.select("host", "doc", "lines").dropDuplicates(["host", "doc"])
    sizes = rows.groupBy("host").agg(F.countDistinct("doc").alias("docs"))
    limits = sizes.select("host", F.greatest(F.lit(float(least_docs)), F.least(F.lit(float(most_docs)), F.lit(share) * F.col("docs"))).alias("limit"))
    counts = once.select("host", F.explode("lines.key").alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("distinct_docs"))
    return counts.where(F.col("distinct_docs") > least_docs).join(limits, "host").where(F.col("distinct_docs") > F.col("limit")).select("key")


def judged(docs: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE, least_left: float = 0.3, most_docs: int = MOST_DOCS) -> DataFrame:
    """The measures of every row, base_failed, n_left (words outside frequent lines) and kept."""
    return _verdicts(docs, least_docs, share, least_left, most_docs).drop("gone_keys")


def _verdicts(docs: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE, least_left: float = 0.3, most_docs: int = MOST_DOCS) -> DataFrame:
    """The columns of judged, and gone_keys: the frequent lines of the text, null where it has none."""
    rows = measured(docs)
    frequent = materialize(frequent_lines(rows, least_docs, share, most_docs), "frequent")
    lines = rows.select("content", F.explode("lines").alias("l")).select("content", "l.key", "l.words")
    gone = lines.join(frequent, "key").groupBy("content", "key").agg(F.first("words").alias("words")).groupBy("content").agg(F.sum("words").alias("gone"), F.collect_list("key").alias("gone_keys"))
    out = rows.drop("lines", "host", "doc").join(gone, "content", "left").withColumn("n_left", F.col("n_words") - F.coalesce("gone", F.lit(0)))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    depleted = (F.col("n_left") < F.col("n_words")) & ((F.col("n_left") < MIN_WORDS) | (F.col("n_left") < least_left * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("gone")


def _host(docs: DataFrame):
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that the rules keep; columns stay as they are. Texts move only where very many contents are rejected."""
    rejected = materialize(judged(docs, **limits).where(~F.col("kept")).select("content").distinct(), "rejected")
    name = fresh(docs, "content")
    return docs.withColumn(name, F.xxhash64("text", _host(docs))).join(small(rejected.withColumnRenamed("content", name), SMALL_TABLE), name, "left_anti").select(*docs.columns)


def _cut(text: bytes, host: bytes, gone: set[int]) -> bytes:
    return b"\n".join(x for x in text.split(b"\n") if not x.split() or xxhash.xxh64_intdigest(host + b"\0" + normalised(x)) - (1 << 63) not in gone)


def without_lines(docs: DataFrame, **limits) -> DataFrame:
    """The rows that keep_good keeps, their texts without the frequent lines that judged leaves out of n_left; n_chars follows the text.

    Lines without a word stay. Texts are joined against the contents that change only, and only those go through Python; texts move only where
    very many contents change.
    """
    found = _verdicts(docs, **limits).where(~F.col("kept") | F.col("gone_keys").isNotNull())
    found = materialize(found.groupBy("content").agg(F.first("kept").alias("kept"), F.first(F.when(F.col("kept"), F.col("gone_keys"))).alias("gone_keys")), "cut")
    key, keys, host_name, ok = (fresh(docs, x) for x in ("content", "gone_keys", "host_name", "kept"))
    found = found.select(F.col("content").alias(key), F.col("kept").alias(ok), F.col("gone_keys").alias(keys))
    joined = docs.withColumn(host_name, _host(docs)).withColumn(key, F.xxhash64("text", F.col(host_name))).join(small(found, SMALL_TABLE, 1 + F.coalesce(F.size(keys), F.lit(0))), key, "left").where(F.coalesce(F.col(ok), F.lit(True)))

    @F.arrow_udf("string")
    def cut(text: pa.Array, host: pa.Array, gone: pa.Array) -> pa.Array:
        rows = zip(text.cast(pa.binary()).to_pylist(), host.cast(pa.binary()).to_pylist(), gone.to_pylist(), strict=True)
        return pa.array([None if t is None else _cut(t, h, set(g)).decode() for t, h, g in rows], pa.string())

    changed = F.col(keys).isNotNull()
    out = joined.withColumn("text", F.when(changed, cut(F.when(changed, F.col("text")), F.col(host_name), F.col(keys))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
