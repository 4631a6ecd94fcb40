"""A corpus from raw documents: quality, near copies, benchmark leaks, secrets, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomkb.llm import decontaminate, near_dedup, pieces, quality, secrets
from fathomkb.llm.common import scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. A document without an id is scored by its text like any other."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; rows without an id, and without words, stay."""
    return near_dedup.keep_representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each row judged by its own text."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets replaced in their texts."""
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as tokens: doc_id, ids, n_tokens, score, nbest, nbest_scores, restored."""
    return pieces.token_rows(pieces.encode(docs))


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_copy),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("pieces", encode_pieces),
]
#: The classifier, the forest and the lattice are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := scratch(spark, f"stage-{name}"))
        docs = spark.read.parquet(path)
    return docs
