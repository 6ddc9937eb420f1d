"""A training corpus from ``documents``: five stages, each an operator over all rows that the one before kept.

Every stage but the last returns the columns of ``documents``; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import decontam, linededup, minhash, packing, toxicity
from tokenloom.llm._store import written


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows whose ``doc_id`` is not in ``rejected``; a null id is in nothing."""
    gone = f"_gone_{uuid.uuid4().hex}"
    ids = rejected.select(F.col("doc_id").cast("long").alias(gone)).where(F.col(gone).isNotNull()).distinct()
    return docs.join(ids, F.col("doc_id").cast("long") == F.col(gone), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. Documents that the model calls toxic go; it learns from all labelled documents here."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. Lines that repeat an earlier line go, and ``n_chars`` follows; every document stays, if empty."""
    done = linededup.dedup_lines(docs).select(*docs.columns)
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else done


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of least id stays.

    Rows of one id are one document, and stay or go together.
    """
    return _without(docs, minhash.near_duplicates(docs).where(~F.col("kept")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. Documents of which windows of benchmark items cover a twentieth or more go."""
    return _without(docs, decontam.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1. Every kept document in sequences of 2048 tokens, with the pieces' ids."""
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")), with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Stages train a model and tokenise, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written as Parquet to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
