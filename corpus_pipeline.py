"""From raw documents to training ids in five stages, each written as Parquet and read again by the next.

1. quality rules: documents that the per-document or the line-frequency rules reject go, the others lose the frequent lines;
2. SimHash near-dedup: of the documents whose five-word shingles have a similarity of 0.8 or more, one of each group stays;
3. secret scans: every secret span is replaced by a mark;
4. mixing: documents are taken as often as their source's target asks for;
5. SentencePiece: doc_id, n_pieces and ids of every document taken.

All but the last return the columns of documents. Stages follow their operators in what they do with nulls, empty texts and repeats.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.llm import lines, mixing, pieces, secrets, simhash
from crosspanel.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_dissimilar(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("piece_encoding", piece_encoding),
]

#: SQL can't express these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
