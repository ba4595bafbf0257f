"""Corpus pipeline over `documents`: five stages of the training-data operators.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of `documents`; `run` writes each
result as Parquet in the shared folder and gives it to the next stage.

Rows without a doc_id go through all stages (they are never held to be copies),
repeated rows of one doc_id are one document and stay or go together, empty
and null texts are kept and packed as a lone end token, and empty tables come
out empty.

Every stage first lets go of what the one before left on the driver (models,
plans, broadcasts).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbus.llm import ngram_jaccard, packing, secret_scan, substring_dedup, toxicity
from nimbus.session import release_driver, unique_scratch

TOXIC = 0.3
# of the near-duplicate stage; the thin query of op8 has its own
SHINGLE_WORDS, NEAR_PERCENT = 5, 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    release_driver(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    name = toxicity.free_name(docs.columns)
    return toxicity.score(docs, model, name).where(F.col(name) < TOXIC).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (Jaccard 0.8 of 5-word shingles) the document with the smallest id stays."""
    release_driver(spark)
    found = ngram_jaccard.self_join(docs, n=SHINGLE_WORDS, percent=NEAR_PERCENT)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a smaller document holds in the same 13-word window are cut."""
    release_driver(spark)
    return substring_dedup.dedup(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    release_driver(spark)
    return secret_scan.redact(docs, secret_scan.train(secret_scan.labelled_findings(spark)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences for training."""
    release_driver(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

# a trained classifier, a graph search and a tokenizer have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the `documents` of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = unique_scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
