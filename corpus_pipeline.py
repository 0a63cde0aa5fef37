"""The corpus pipeline: five stages, each over all that its predecessor kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicade.llm import dartminhash, decontaminate, packing, pii, toxicity
from lexicade.llm.queries import tokenizer_file
from lexicade.llm.stage import Stage, shared_folder

StageFn = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learnt from the labels outside the held-out fifth, scores below one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, toxicity.training_labels(labels))
    scores = toxicity.scores(docs.select(F.struct(*docs.columns).alias("doc"), "text"), model)
    return scores.where("toxicity < 0.5").select("doc.*")


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates."""
    return dartminhash.one_of_each(docs, Stage(spark))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_documents(docs, benchmark, Stage(spark))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked in their texts."""
    return pii.mask(docs, Stage(spark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 1024 tokens."""
    return packing.pack(docs, Stage(spark), tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, StageFn]] = [
    ("toxicity", reject_toxic),
    ("near_dedup", one_per_group),
    ("decontamination", without_benchmark),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

# no stage but the decontamination can be stated in SQL; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        result = stage(spark, docs, sf_dir)
        result.write.parquet(out)
        docs = spark.read.schema(result.schema).parquet(out)
    return docs
