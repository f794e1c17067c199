"""A corpus pipeline of five operators: judge, filter, deduplicate, decontaminate, pack."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vouchsafe.llm import packing, probminhash, toxicity, weak_rules, winnowing
from vouchsafe.llm.common import crc32_of
from vouchsafe.session import checkpoint_root, prepare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, weighed by their estimated accuracies, take to be good."""
    prepare(spark)
    return weak_rules.keep_good(docs.select(*COLUMNS)).select(*COLUMNS)


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model learns from labelled ones."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, labels, crc32_of("doc_id") % 5 != 0)
    return toxicity.scored(docs, model, "toxicity").where("toxicity < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    prepare(spark)
    return probminhash.deduplicated(docs.select(*COLUMNS)).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    items = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return winnowing.clean(docs.select(*COLUMNS), items).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences of at most 4096 tokens."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_texts),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", packed),
]

#: No SQL: the toxicity model is trained, and tokenizing is outside SQL. tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
