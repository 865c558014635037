"""Quality classifier: a sparse rule ensemble (after Friedman and Popescu, 2008) compiled into Spark columns.

Shallow gradient-boosted and random trees are grown over text statistics of a bounded sample of labelled rows; every path from a
root to a node is a conjunctive rule. A logistic regression with an L1 penalty weighs the rules, and those with a weight become one Spark
expression over the statistics.

Defined cases: a null text counts as empty and is scored; a document with several labels counts once per label; null labels are not learned
from; without labels of both kinds the score is the share of ones (0.5 without any); repeated rows are each scored; empty tables give
empty results. Only doc_id and text of documents are read, and doc_id, quality of labels for training.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, ready_python, slices, uniform

STATS = (
    "n_words", "n_chars", "n_lines", "mean_word", "unique_words", "dup_lines", "alpha", "digits", "upper", "punctuation",
    "symbols", "spaces", "wide", "top_word", "words_per_line", "short_words", "long_words", "ends_sentence", "commas", "brackets",
)
Rule = tuple[tuple[int, str, float], ...]
_CLASS = {
    "digits": b"0123456789",
    "upper": bytes(range(65, 91)),
    "alpha": bytes(range(65, 91)) + bytes(range(97, 123)),
    "punctuation": b".,;:!?'\"-()",
    "symbols": b"#*$%&|<>@^_~=+\\/{}",
    "spaces": b" \t\n\v\f\r",
    "commas": b",",
    "brackets": b"[](){}<>",
}
_rows = np.zeros((256, len(_CLASS) + 2))
for _i, _chars in enumerate(_CLASS.values()):
    _rows[list(_chars), _i] = 1
_rows[0x80:, -2] = 1  # bytes of wide characters
_rows[0xC0:, -1] = 1  # of which first bytes
_AT = {name: i for i, name in enumerate([*_CLASS, "wide"])}


def statistics(text: bytes | None) -> list[float]:
    """The STATS of a whole text; shares are of its bytes, words or lines."""
    text = text or b""
    words, lines = text.split(), [x.strip() for x in text.split(b"\n") if x.strip()]
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _rows
    n, w, k = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    share = {name: float(counts[i]) / n for name, i in _AT.items()}
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    own = {
        "n_words": float(len(words)),
        "n_chars": float(len(text) - counts[_AT["wide"]] + counts[-1]),
        "n_lines": float(len(lines)),
        "mean_word": float(lengths.sum()) / w,
        "unique_words": len(seen) / w,
        "dup_lines": 1 - len(set(lines)) / k if lines else 0.0,
        "top_word": max(seen.values(), default=0) / w,
        "words_per_line": len(words) / k,
        "short_words": float((lengths <= 3).sum()) / w,
        "long_words": float((lengths >= 12).sum()) / w,
        "ends_sentence": sum(x[-1:] in b".!?" for x in lines) / k,
    }
    return [own.get(name, share.get(name, 0.0)) for name in STATS]


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and one double column per statistic, named s0, s1, ..."""
    ready_python(docs.sparkSession)
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), *(f"s{i} double" for i in range(len(STATS)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(fields)):
            stats = np.array([statistics(t) for t in batch.column(len(fields)).cast(pa.binary()).to_pylist()]).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], *(pa.array(stats[:, i]) for i in range(len(STATS)))], [*keep, *(f"s{i}" for i in range(len(STATS)))])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def paths(tree: str) -> list[Rule]:
    """The rules of a tree, read from its debug string: every conjunction of conditions from the root to a node."""
    found, open_ = [], []
    for line in tree.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(m[1])
            while open_ and open_[-1][0] >= depth:
                open_.pop()
            open_.append((depth, (int(m[2]), m[3], float(m[4]))))
            found.append(tuple(sorted({c for _, c in open_})))
    return found


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for i, op, at in rule:
        out = out & ((F.col(f"s{i}") <= at) if op == "<=" else (F.col(f"s{i}") > at))
    return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        """The compiled model: a number from 0 to 1 over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, w in self.weights.items():
            total = total + F.when(holds(rule), w).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        named = lambda rule: " and ".join(f"{STATS[i]} {op} {at:.4g}" for i, op, at in rule)
        return [f"{w:+.3f} {named(r)}" for r, w in sorted(self.weights.items(), key=lambda x: -abs(x[1]))]


def training_rows(docs: DataFrame, labels: DataFrame, most: int = 12_000, seed: int = 11) -> DataFrame:
    """label and statistics of about `most` labelled rows at most, chosen by a hash of their id; held-out ids are left out."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = rows.count()
    picked = rows.where(uniform("doc_id", seed=seed) < min(1.0, most / max(n, 1)))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # bounded by `most`
    return materialize(with_statistics(texts.select("label", "text"), ("label",)), "quality")


def fit(rows: DataFrame, penalty: float = 0.002, seed: int = 11) -> RuleModel:
    """Grow trees, collect their rules, weigh them by a lasso logistic regression."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    n, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or ones in (0, n):
        share = (ones + 0.5) / (n + 1) if n else 0.5
        return RuleModel(float(np.log(share / (1 - share))), {})
    rows = rows.coalesce(4)
    stats = VectorAssembler(inputCols=[f"s{i}" for i in range(len(STATS))], outputCol="features").transform(rows).select("label", "features", *[f"s{i}" for i in range(len(STATS))]).persist()
    trees = RandomForestClassifier(numTrees=12, maxDepth=4, subsamplingRate=0.7, seed=seed).fit(stats).toDebugString + GBTClassifier(maxIter=8, maxDepth=3, seed=seed).fit(stats).toDebugString
    rules = sorted(set(paths(trees)))
    tested = stats.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("v")).persist()
    model = LogisticRegression(featuresCol="v", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(tested)
    weights = {r: float(w) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w}
    for held in (stats, tested):
        held.unpersist()
    return RuleModel(float(model.intercept), weights)


def score(docs: DataFrame, model: RuleModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every row; the scores are written to the shared folder."""
    scored = materialize(with_statistics(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select("doc_id", model.score().alias("score")), "scores")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
